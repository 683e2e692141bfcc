"""State between runs: late events, supersession, and the last outcome of every pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


def late_by_stream(events: DataFrame, window_end: str | None) -> DataFrame:
    """(stream, late): events not later than the end of the last assessed window, compared as text."""
    stream = F.concat_ws("|", "source", "subject")
    return events.where(F.lit(window_end is not None) & (F.col("time") <= F.lit(window_end))).groupBy(stream.alias("stream")).agg(F.count("*").alias("late"))


def read_state(spark: SparkSession, path: str, run: int | None = None) -> DataFrame:
    """Last outcomes (subject, catalog, control, outcome), of the newest run or of the one given; refuses a state of another version."""
    rows = spark.read.parquet(f"{path}/outcomes")
    at = rows.agg(F.max("run").alias("r")).first()["r"] if run is None else run
    rows = rows.where(F.col("run") == at)
    other = rows.where(F.col("version") != VERSION).limit(1).collect()
    if other:
        raise ValueError(f"state has version {other[0]['version']}, this code reads {VERSION}")
    return rows.drop("version", "run")


def merged(state: DataFrame | None, now: DataFrame) -> DataFrame:
    """The new state: this run's outcomes, and earlier ones of pairs that this run did not assess."""
    keys = ["subject", "catalog", "control"]
    now = now.select(*keys, "outcome")
    return now if state is None else now.unionByName(state.select(*keys, "outcome").join(now, keys, "left_anti"))


def write_state(state: DataFrame, path: str, run: int = 0) -> None:
    """Writes the state of a run beside those of earlier ones; it shows when its files are committed, and none is written over."""
    state.withColumn("version", F.lit(VERSION)).write.mode("errorifexists").parquet(f"{path}/outcomes/run={run}")


def supersedes(runs: DataFrame, digest: str) -> str | None:
    """Digest of the report that a run over ``digest`` replaces; none where the input was seen before."""
    seen = runs.where(F.col("input_digest") == digest).limit(1).count()
    last = runs.agg(F.max_by("report_digest", "run")).first()[0]
    return None if seen else last
