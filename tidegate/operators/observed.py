"""What runs are counted by: totals on the way, and streams that start, go on, end or fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql.streaming import StreamingQueryListener


def observed(df: DataFrame, name: str, **totals: Column) -> tuple[DataFrame, Observation]:
    """The rows, and totals that are known when they have been run through once, without a pass of their own."""
    seen = Observation(name)
    return df.observe(seen, *[c.alias(k) for k, c in totals.items()]), seen


class StreamCounts(StreamingQueryListener):
    """Streams started, ended and failed, and rows taken, over a session. Add with ``spark.streams.addListener``."""

    def __init__(self):
        self.started = self.ended = self.failed = self.rows = 0

    def onQueryStarted(self, event) -> None:
        self.started += 1

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended += 1
        self.failed += event.exception is not None
