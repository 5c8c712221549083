"""Loops over DataFrames: state is written and read back, so plans stay short."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the cluster; a temporary one only where none is set and all runs on one machine."""
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", "")
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or "/tmp/checkpoints")
    return jsc.getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def iterate(
    state: dict[str, DataFrame],
    step: Callable[[dict[str, DataFrame], int], dict[str, DataFrame]],
    rounds: int,
    stop: Callable[[dict[str, DataFrame], dict[str, DataFrame]], bool] | None = None,
    every: int = 1,
    settled: frozenset[str] = frozenset(),
) -> dict[str, DataFrame]:
    """Apply ``step`` ``rounds`` times; settle the state each ``every`` rounds; leave early if ``stop`` says so.

    Tables named in ``settled`` are constant or settled by the step itself.
    """
    for n in range(rounds):
        new = step(state, n)
        if (n + 1) % every == 0 or stop is not None:
            new = {k: v if k in settled else settle(v) for k, v in new.items()}
        if stop is not None and stop(state, new):
            return new
        state = new
    return state
