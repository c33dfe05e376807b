"""Binary confusion classes, their counts, and the ratios built on them.

Positive is 1, negative is 0. A row whose label or prediction is anything else,
null included, belongs to no cell of the matrix. Conditions are written as SQL
text over column names: one expression per result, however many terms it has.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowscore.functions.names import quoted

# Actual and predicted class of each cell.
CELLS = {"tp": (1, 1), "tn": (0, 0), "fp": (0, 1), "fn": (1, 0)}


def _condition(cell: str, label: str, prediction: str) -> str:
    actual, predicted = CELLS[cell]
    return f"{quoted(label)} = {actual} AND {quoted(prediction)} = {predicted}"


def confusion_class(label: str, prediction: str) -> Column:
    """``TP``, ``TN``, ``FP``, ``FN`` or ``Unknown``."""
    branches = " ".join(
        f"WHEN {_condition(cell, label, prediction)} THEN '{cell.upper()}'" for cell in CELLS
    )
    return F.expr(f"CASE {branches} ELSE 'Unknown' END")


def cell_counts(label: str, prediction: str) -> list[Column]:
    """Four aggregates ``tp tn fp fn``; an absent cell counts 0."""
    return [
        F.expr(f"count_if({_condition(cell, label, prediction)}) AS {cell}") for cell in CELLS
    ]


def share(part: str, whole: str, empty: str = "0D") -> str:
    """``part / whole`` as SQL, or ``empty`` where ``whole`` is 0."""
    return f"CASE WHEN ({whole}) <> 0 THEN ({part}) / ({whole}) ELSE {empty} END"


# Over columns tp, tn, fp, fn. Accuracy of no known row is null.
ACCURACY = share("tp + tn", "tp + tn + fp + fn", empty="NULL")
PRECISION = share("tp", "tp + fp")
RECALL = share("tp", "tp + fn")
# Over columns Precision and Recall.
F_ONE = share("2 * (Precision * Recall)", "Precision + Recall")
