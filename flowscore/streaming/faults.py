"""Ending a streaming query between a batch's output and its commit, and starting it again."""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

Handler = Callable[[DataFrame, int], None]


class InjectedFault(RuntimeError):
    """Raised on purpose, after a batch's output is complete."""


def fail_once(handler: Handler, batches: Collection[int]) -> Handler:
    """``handler``, but the first attempt of each of ``batches`` fails after its output.

    The query ends then without committing the batch; the next start runs it again.
    """
    left = set(batches)

    def handle(batch: DataFrame, batch_id: int) -> None:
        handler(batch, batch_id)
        if batch_id in left:
            left.discard(batch_id)
            raise InjectedFault(f"batch {batch_id} is not committed")

    return handle


def run_with_restarts(start: Callable[[], StreamingQuery], most: int = 10) -> int:
    """Start a query until it ends by itself; how often an injected fault ended it before.

    Any other failure, or more than ``most`` faults, is raised.
    """
    for faults in range(most + 1):
        try:
            start().awaitTermination()
            return faults
        except StreamingQueryException as error:
            if InjectedFault.__name__ not in str(error) or faults == most:
                raise
    return most
