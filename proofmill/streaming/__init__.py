"""The incremental side with Structured Streaming: dedup, chain continuity, live spans, versioned results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.integrity import GENESIS
from ..sources.adapters import spans_to_events, unnest_spans
from ..sources.binding import DEALT


def deduplicated(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """First copy of each id.  Unlike the batch form it forgets an id once the watermark has passed it."""
    return events.withColumn("at", F.to_timestamp("time")).withWatermark("at", delay).dropDuplicatesWithinWatermark(["id"]).drop("at")


def _judged(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Judges the new rows of a stream, in their order, against its last hash and latest time."""
    before, newest, idx = state.get if state.exists else (GENESIS, "", 0)
    columns = ("ordinal", "id", "hash", "content_hash", "prev", "time")
    rows = sorted((row for f in frames for row in zip(*(f[c] for c in columns), strict=True)), key=lambda row: row[0])
    out = []
    for _, name, own, content, prev, time in rows:
        finding = "broken" if own != content else "unlinked" if prev != before else "time_order" if time < newest else None
        out.append((key[0], name, idx, finding))
        before, newest, idx = own, max(newest, time), idx + 1
    state.update((before, newest, idx))
    yield pd.DataFrame(out, columns=["stream", "id", "idx", "finding"])


def chain_continuity(rows: DataFrame) -> DataFrame:
    """(stream, id, idx, finding) of every arriving row; state is three values a stream.

    The state of many streams travels to Python with their rows, in one batch.
    """
    own = rows.select("stream", "ordinal", "id", "hash", "content_hash", "prev", "time").groupBy("stream")
    return own.applyInPandasWithState(_judged, "stream string, id string, idx long, finding string", "hash string, time string, idx long", "append", GroupStateTimeout.NoTimeout)


def live_spans(spark: SparkSession, folder: str, subject: str, source_class: str, source: str) -> DataFrame:
    """Events of span documents as they land in a folder, one JSON document a line."""
    lines = spark.readStream.text(folder).select(F.col("value").alias("doc"))
    return spans_to_events(unnest_spans(lines), subject, source_class, source)


def counts_by_window(events: DataFrame, every: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Events per type and window; a window is final once the watermark has passed it."""
    at = events.withColumn("at", F.to_timestamp("time")).withWatermark("at", delay)
    return at.groupBy(F.window("at", every), "etype").agg(F.count("*").alias("events")).select("window.start", "window.end", "etype", "events")


#: Folders over which the events and outcomes of ``reassess`` are dealt by subject.
BUCKETS = 64
#: Subjects at most that are sent to all executors; where a batch touches more, events are dealt by subject instead.
FEW = 20_000
_KEYS = ["subject", "catalog", "control"]


def _committed(spark: SparkSession, folder: str, name: str) -> list[int]:
    """Numbers n of the subfolders ``name=n`` whose writes are complete."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}=*/_SUCCESS")) or []
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


def _written(spark: SparkSession, path: str, upto: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """(subject, catalog, control, outcome, batch): the changes up to a batch since the newest compaction, and what that holds."""
    schema = "subject string, catalog string, control string, outcome string, batch int, bucket int"
    fits = lambda n: upto is None or n <= upto
    base = [n for n in _committed(spark, f"{path}/compacted", "upto") if fits(n)][-1:]
    later = [n for n in _committed(spark, f"{path}/changes", "batch") if fits(n) and n > max(base, default=-1)]
    parts = [spark.read.schema(schema.replace(", batch int", "")).parquet(f"{path}/compacted/upto={n}").withColumn("batch", F.lit(n)) for n in base]
    if later:
        parts.append(spark.read.option("basePath", f"{path}/changes").schema(schema).parquet(*[f"{path}/changes/batch={n}" for n in later]))
    if not parts:
        return spark.createDataFrame([], schema).drop("bucket")
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
    return rows.select(*_KEYS, "outcome", "batch")


def outcomes(spark: SparkSession, path: str, upto: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """(subject, catalog, control, outcome) after batch ``upto``, or after all: of each pair the newest change
    since the newest compaction, else what that holds.  With ``buckets``, only of subjects in these."""
    return _written(spark, path, upto, buckets).groupBy(*_KEYS).agg(F.max_by("outcome", "batch").alias("outcome"))


def compact(spark: SparkSession, path: str, upto: int) -> None:
    """Write the outcomes after batch ``upto`` in one place, by bucket; readers use it once it is complete."""
    bucket = F.pmod(F.xxhash64("subject"), F.lit(BUCKETS)).cast("int")
    outcomes(spark, path, upto).withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/compacted/upto={upto}")


def reassess(assess: Callable[[DataFrame], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: assesses the subjects that a batch touches, over all their events so far,
    and writes the outcomes that changed, and the drift, under the batch's number.

    Events and outcomes lie in folders by a hash of their subject, and only folders of touched subjects
    are read; ``outcomes`` reads the newest of each.  A batch that runs again writes the same folders
    anew from the batches before it; a changed outcome makes a new row that names the batch it
    supersedes, so no late event closes silently.

    Outcomes of before and now are grouped, not joined: their files are so small for their rows that the
    planner would gather one side in the driver and send it to all executors.
    """
    bucket = F.pmod(F.xxhash64("subject"), F.lit(BUCKETS)).cast("int")

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/events/batch={number}")
        touched = spark.read.parquet(f"{path}/events/batch={number}").select("subject", bucket.alias("bucket")).distinct()
        counts = touched.groupBy("bucket").count().collect()  # BUCKETS rows at most
        buckets = [r["bucket"] for r in counts]
        events = spark.read.option("basePath", f"{path}/events").parquet(f"{path}/events").where((F.col("batch") <= number) & F.col("bucket").isin(buckets))
        if sum(r["count"] for r in counts) <= FEW:
            names = F.broadcast(touched.select("subject"))
        else:
            parts = -(-events.count() // DEALT)  # Parquet has this number in its footers
            events = events.repartition(max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))), "subject")
            names = touched.select("subject").hint("merge")
        own = events.join(names, "subject", "left_semi").select(batch.columns)
        assess(own).write.mode("overwrite").parquet(f"{path}/assessed/batch={number}")
        now = spark.read.parquet(f"{path}/assessed/batch={number}").select(*_KEYS, "outcome", F.lit(number).alias("batch"))
        at = F.col("batch")
        both = _written(spark, path, number - 1, buckets).unionByName(now).groupBy(*_KEYS)
        both = both.agg(F.max_by("outcome", F.when(at < number, at)).alias("previous"), F.max(F.when(at == number, F.col("outcome"))).alias("outcome"), F.count_if(at == number).alias("_now"))
        changed = both.where("_now > 0 and (previous is null or previous <> outcome)").drop("_now").withColumn("bucket", bucket)
        changed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/changes/batch={number}")
        if number:
            again = spark.read.schema(changed.schema).parquet(f"{path}/changes/batch={number}").where("previous is not null")
            again.select(*_KEYS, "previous", "outcome", F.lit(number - 1).alias("supersedes")).write.mode("overwrite").parquet(f"{path}/drift/batch={number}")

    return run


#: Fixed value: the state store that operators of a user's own state need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def replay(rows: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, arrivals: int = 4, order: str = "ordinal", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """What a streaming operator says of a table that arrives in several parts, in the order of a number.

    Each part is added to a folder, and the query runs until it has seen it all, from the checkpoint of
    the run before; so state is carried over through the store, as on a restart.  With ``each``, that
    function takes the micro-batches, and nothing is returned.
    """
    spark, kind = rows.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(kind)
    spark.conf.set(kind, ROCKS)
    try:
        low, high = rows.agg(F.min(order), F.max(order)).first()
        part = F.least(F.floor((F.col(order) - F.lit(low or 0)) * arrivals / F.lit((high or 0) - (low or 0) + 1)), F.lit(arrivals - 1))
        for n in range(arrivals):
            rows.where(part == n).write.mode("append").parquet(f"{path}/in")
            said = operator(spark.readStream.schema(rows.schema).parquet(f"{path}/in"))
            sink = said.writeStream.foreachBatch(each) if each else said.writeStream.format("parquet").option("path", f"{path}/out")
            sink.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return None if each else spark.read.schema(said.schema).parquet(f"{path}/out")
    finally:
        spark.conf.set(kind, was)
