"""Tallying the votes of several models, one array element per class.

Votes are columns of one row, so a tally is plain arithmetic on scalars and
stays inside whole-stage codegen; higher-order functions (interpreted) are used
only when the unrolled expression would grow too large to be compiled well.
All functions take the names of the vote columns, in member order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowscore.functions.names import quote_all

UNROLL_LIMIT = 128


def _ballot(votes: Sequence[str]) -> str:
    return f"array({', '.join(f'CAST({vote} AS DOUBLE)' for vote in quote_all(votes))})"


def _counts(votes: Sequence[str], num_classes: int) -> str:
    if len(votes) * num_classes > UNROLL_LIMIT:
        return (
            f"transform(sequence(0, {num_classes - 1}), class -> "
            f"CAST(size(filter({_ballot(votes)}, vote -> vote = class)) AS DOUBLE))"
        )
    tallies = (
        " + ".join(f"IF({vote} = {number}, 1D, 0D)" for vote in quote_all(votes))
        for number in range(num_classes)
    )
    return f"array({', '.join(tallies)})"


def ballot(votes: Sequence[str]) -> Column:
    """All votes as ``array<double>``."""
    return F.expr(_ballot(votes))


def vote_counts(votes: Sequence[str], num_classes: int) -> Column:
    """Votes per class; null votes and votes outside the classes count nowhere."""
    return F.expr(_counts(votes, num_classes))


def vote_shares(votes: Sequence[str], num_classes: int) -> Column:
    """Votes per class over the number of members."""
    counts, members = _counts(votes, num_classes), len(votes)
    if members * num_classes > UNROLL_LIMIT:
        return F.expr(f"transform({counts}, tally -> tally / {members})")
    shares = ", ".join(f"({counts})[{number}] / {members}" for number in range(num_classes))
    return F.expr(f"array({shares})")


def majority_vote(votes: Sequence[str], num_classes: int) -> Column:
    """Class with most votes; a tie goes to the lowest class."""
    counts = _counts(votes, num_classes)
    return F.expr(f"CAST(array_position({counts}, array_max({counts})) - 1 AS DOUBLE)")


def _any_vote(votes: Sequence[str], number: int) -> str:
    """Three-valued: true if one vote is ``number``, else null if one is null."""
    return " OR ".join(f"{vote} = {number}" for vote in quote_all(votes))


def attack_vote(votes: Sequence[str]) -> Column:
    """1 when any member votes 1."""
    return F.expr(f"CAST(({_any_vote(votes, 1)}) AS DOUBLE)")


def normal_vote(votes: Sequence[str]) -> Column:
    """0 when any member votes 0, else 1."""
    return F.expr(f"CAST(NOT ({_any_vote(votes, 0)}) AS DOUBLE)")
