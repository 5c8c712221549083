"""Figures of a run, gathered by its own passes: rows and sums that ride along with an action, and seconds of steps."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Runtime:
    """Collects (step, metric, value) rows; nothing is computed twice for them."""

    def __init__(self) -> None:
        self._seen: list[tuple[str, Observation]] = []
        self._seconds: list[tuple[str, float]] = []

    def watched(self, step: str, df: DataFrame, **metrics: Column) -> DataFrame:
        """``df`` whose next action also gives its number of rows and the given aggregates."""
        seen = Observation(f"{step}-{len(self._seen)}")
        self._seen.append((step, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in metrics.items()])

    @contextmanager
    def timed(self, step: str) -> Iterator[None]:
        began = time.monotonic()
        try:
            yield
        finally:
            self._seconds.append((step, time.monotonic() - began))

    def rows(self, spark: SparkSession) -> DataFrame:
        """step, metric, value of all that was watched and timed; waits for the actions that carry the figures."""
        found = [(step, k, float(v)) for step, seen in self._seen for k, v in seen.get.items() if v is not None]
        return spark.createDataFrame(found + [(step, "seconds", s) for step, s in self._seconds], "step string, metric string, value double")
