"""Two batches through the streaming side."""

import json

import pytest
from pyspark.sql import functions as F

from proofmill import streaming
from proofmill.operators.integrity import GENESIS


def test_live_spans_and_dedup(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    span = {"traceId": "t", "spanId": "s", "name": "chat m", "startTimeUnixNano": "1700000000123999999", "attributes": [{"key": "gen_ai.request.model", "value": {"stringValue": "m"}}]}
    (src / "a.json").write_text(json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [span]}]}]}) + "\n")
    events = streaming.deduplicated(streaming.live_spans(spark, str(src), "x", "self_report", "otel"))
    q = events.writeStream.format("memory").queryName("spans").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    (src / "b.json").write_text((src / "a.json").read_text())
    q.processAllAvailable()
    q.stop()
    got = spark.table("spans").collect()
    assert [(r.id, r.etype, r.time, r.detail) for r in got] == [("otel:t/s#event", "ModelCall", "2023-11-14T22:13:20.123Z", "m")]


def test_reassess_writes_drift(spark, tmp_path):
    schema = "subject string, catalog string, control string, outcome string"
    last = lambda df: df.groupBy("subject", "catalog", "control").agg({"outcome": "max"}).withColumnRenamed("max(outcome)", "outcome")
    run = streaming.reassess(last, str(tmp_path / "r"))
    run(spark.createDataFrame([("s", "k", "A", "conformant")], schema), 0)
    run(spark.createDataFrame([("s", "k", "A", "non-conformant")], schema), 1)
    got = spark.read.parquet(str(tmp_path / "r/drift/batch=1")).collect()
    assert [(r.control, r.previous, r.outcome, r.supersedes) for r in got] == [("A", "conformant", "non-conformant", 0)]


def test_reassess_keeps_untouched_subjects(spark, tmp_path):
    schema = "subject string, catalog string, control string, outcome string"
    last = lambda df: df.groupBy("subject", "catalog", "control").agg({"outcome": "max"}).withColumnRenamed("max(outcome)", "outcome")
    run = streaming.reassess(last, str(tmp_path / "r"))
    run(spark.createDataFrame([("s", "k", "A", "conformant"), ("t", "k", "A", "conformant")], schema), 0)
    run(spark.createDataFrame([("t", "k", "A", "a late event")], schema), 1)
    got = streaming.outcomes(spark, str(tmp_path / "r")).collect()
    assert {(r.subject, r.outcome) for r in got} == {("s", "conformant"), ("t", "conformant")}


def test_reassess_writes_what_changed(spark, tmp_path):
    """A batch writes only outcomes that it changed; the same batch again changes nothing; a compaction holds them all."""
    schema = "subject string, catalog string, control string, outcome string"
    last = lambda df: df.groupBy("subject", "catalog", "control").agg({"outcome": "max"}).withColumnRenamed("max(outcome)", "outcome")
    path = str(tmp_path / "r")
    run, rows = streaming.reassess(last, path), lambda *xs: spark.createDataFrame([(s, "k", c, o) for s, c, o in xs], schema)
    changes = lambda n: {(r.subject, r.control, r.outcome) for r in spark.read.parquet(f"{path}/changes/batch={n}").collect()} if list((tmp_path / f"r/changes/batch={n}").glob("bucket=*")) else set()
    now = lambda n=None: {(r.subject, r.control, r.outcome) for r in streaming.outcomes(spark, path, n).collect()}
    assert now() == set()
    run(rows(("s", "A", "a"), ("s", "B", "a"), ("t", "A", "a"), ("u", "A", "z")), 0)
    run(rows(("s", "A", "b"), ("t", "A", "a")), 1)
    assert changes(1) == {("s", "A", "b")} and now() == {("s", "A", "b"), ("s", "B", "a"), ("t", "A", "a"), ("u", "A", "z")}
    run(rows(("s", "A", "b"), ("t", "A", "a")), 1)
    assert changes(1) == {("s", "A", "b")} and now(0) == {("s", "A", "a"), ("s", "B", "a"), ("t", "A", "a"), ("u", "A", "z")}
    streaming.compact(spark, path, 1)
    run(rows(("u", "A", "a"), ("t", "A", "c")), 2)
    assert changes(2) == {("t", "A", "c")} and now() == {("s", "A", "b"), ("s", "B", "a"), ("t", "A", "c"), ("u", "A", "z")}
    assert now(1) == {("s", "A", "b"), ("s", "B", "a"), ("t", "A", "a"), ("u", "A", "z")}


@pytest.mark.parametrize("few", [0, streaming.FEW])
def test_reassess_gathers_no_outcomes(spark, tmp_path, monkeypatch, few):
    """Many outcomes lie in small files; a table of them that is gathered to be sent to all executors is refused here."""
    monkeypatch.setattr(streaming, "FEW", few)
    each = F.explode(F.sequence(F.lit(1), F.lit(300))).alias("control")
    count = lambda ev: ev.groupBy("subject").count().select("subject", F.lit("k").alias("catalog"), each, F.concat(F.lit("seen "), "count").alias("outcome"))
    run = streaming.reassess(lambda ev: count(ev).withColumn("control", F.concat(F.lit("C" * 200), "control")), str(tmp_path / "r"))
    limit, was = "spark.sql.maxBroadcastTableSize", spark.conf.get("spark.sql.maxBroadcastTableSize")
    spark.conf.set(limit, "48m")  # the first page of any such table takes 32 MB of a driver of 3 GB and four cores
    try:
        run(spark.range(1000).select(F.concat(F.lit("s"), "id").alias("subject")), 0)
        run(spark.range(0, 1500, 2).select(F.concat(F.lit("s"), "id").alias("subject")), 1)
    finally:
        spark.conf.set(limit, was)
    drift = spark.read.parquet(str(tmp_path / "r/drift/batch=1"))
    assert [tuple(r) for r in drift.groupBy("previous", "outcome", "supersedes").count().collect()] == [("seen 1", "seen 2", 0, 150_000)]
    got = streaming.outcomes(spark, str(tmp_path / "r")).groupBy("outcome").agg(F.count("*").alias("n"), F.countDistinct("subject").alias("s"))
    assert {tuple(r) for r in got.collect()} == {("seen 1", 225_000, 750), ("seen 2", 150_000, 500)}


def test_counts_by_window(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [("2024-01-01T00:10:00Z", "ToolCall"), ("2024-01-01T00:50:00Z", "ToolCall"), ("2024-01-01T05:00:00Z", "Notice"), ("2024-01-01T09:00:00Z", "Notice")]
    spark.createDataFrame(rows, "time string, etype string").coalesce(1).write.parquet(str(src / "a"))
    q = streaming.counts_by_window(spark.readStream.schema("time string, etype string").parquet(str(src / "*")))
    q = q.writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.etype, r.events) for r in spark.table("windows").collect()} == {("ToolCall", 2), ("Notice", 1)}


def test_chain_continues_over_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "stream string, id string, ordinal long, time string, content_hash string, hash string, prev string"
    batches = [[("s", "a", 0, "1", "A", "A", GENESIS), ("s", "b", 1, "2", "B", "B", "A")], [("s", "c", 2, "1", "C", "C", "B"), ("s", "d", 3, "3", "D", "X", "C"), ("s", "e", 4, "4", "E", "E", "D")]]
    src = tmp_path / "in"
    rows = streaming.chain_continuity(spark.readStream.schema(schema).parquet(str(src / "*"))) if src.mkdir() is None else None
    for n, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(str(src / str(n)))
        q = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = {r["id"]: (r["idx"], r["finding"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": (0, None), "b": (1, None), "c": (2, "time_order"), "d": (3, "broken"), "e": (4, "unlinked")}


def test_chain_sorts_a_batch_of_many_rows_whole(spark, tmp_path):
    schema = "stream string, id string, ordinal long, time string, content_hash string, hash string, prev string"
    n = 25_000  # more than an Arrow batch holds, and none of them in order
    rows = [("s", f"e{i}", i, f"{i:06d}", f"h{i}", f"h{i}", f"h{i - 1}" if i else GENESIS) for i in range(n)][::-1]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    said = streaming.chain_continuity(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = said.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == n and got.where("finding is not null or id <> concat('e', idx)").isEmpty()
