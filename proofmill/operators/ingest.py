"""Validation of arriving events: one reason for each reject, first come first served for ids, time order.

Row-local reasons come from one ``when`` chain.  The two that depend on other rows need care: an id
is taken only by an accepted event, so a copy of an event that was rejected for its time gets a
fresh chance, and a duplicate never raises the time that later events are held against.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import once
from ..sources.scratch import written

#: The 24 event types, and the longest line in UTF-8 bytes.
EVENT_TYPES = (
    "SessionStart SessionEnd BundleLoaded Attestation ModelCall ToolCall ResourceAccess MemoryWrite MemoryRead Instruction Refusal PolicyDecision AuthzCheck "
    "DelegationIssued Decision ApprovalRequested ApprovalDecided Override Interrupt Outcome Incident Notice Disclosure IntegrityResult"
).split()
MAX_OCTETS = 1_048_576
#: Ordinals of one source that are sorted together.
BLOCK = 65_536
REQUIRED = ["id", "source", "subject", "time", "etype"]


def type_name(column: str | Column) -> Column:
    """Event type from its dotted name, null where the name has another form."""
    return F.nullif(F.regexp_extract(column, r"\.evidence\.([A-Za-z]+)\.v1$", 1), F.lit(""))


def parse_lines(lines: DataFrame, class_member: str = "sourceclass") -> DataFrame:
    """Raw JSON lines (file, ordinal, line) to envelope columns and ``parse_reason``.

    parse_reason is oversize, schema_invalid, or null; the payload stays JSON text in ``data``.
    ``class_member`` is the envelope's member with the source class, as the feed at hand names it.
    """
    body, members = F.col("_body"), ["id", "source", "subject", "time", "type", class_member, "data"]
    whole = F.coalesce(F.schema_of_variant(F.try_parse_json(body)).startswith("OBJECT"), F.lit(False))
    out = lines.select("file", "ordinal", F.trim("line").alias("_body")).where(F.length(body) > 0)
    # one parse for all members; what is no whole object, or names a member twice, goes by single paths
    out = out.select("*", once(whole).alias("_whole")).select("*", F.json_tuple(body, *members).alias(*[f"_{i}" for i in range(len(members))]))
    get = {k: F.when(F.col("_whole"), F.col(f"_{i}")).otherwise(F.get_json_object(body, f"$.{k}")) for i, k in enumerate(members)}
    bad = F.when(F.octet_length(body) > MAX_OCTETS, "oversize").when(~F.col("_whole"), "schema_invalid")
    return out.select("file", "ordinal", *[get[k].alias(k) for k in ("id", "source", "subject", "time")], F.coalesce(type_name(get["type"]), get["type"]).alias("etype"), get[class_member].alias("source_class"), get["data"].alias("data"), bad.alias("parse_reason"))


def row_reason(rows: DataFrame, sources: DataFrame | None) -> DataFrame:
    """Adds ``reason`` from what the row alone shows, in order of precedence; null where it passes.

    Rows that carry ``errors``, as ``schema.payload_errors`` leaves them, are invalid where it holds any.
    """
    missing = F.lit(False)
    for c in REQUIRED:
        missing = missing | F.col(c).isNull()
    if "errors" in rows.columns:
        missing = missing | (F.size("errors") > 0)
    first = F.col("parse_reason") if "parse_reason" in rows.columns else F.lit(None).cast("string")
    reason = F.when(first.isNotNull(), first).when(missing, "schema_invalid").when(~F.col("etype").isin(EVENT_TYPES), "unknown_type")
    if sources is None:  # no declared list: any source will do
        return rows.withColumn("reason", reason)
    known = sources.select("source", F.lit(True).alias("_known"), "declared_class")
    out = rows.join(known, "source", "left")
    reason = reason.when(F.col("_known").isNull(), "unknown_source").when(F.col("declared_class").isNotNull() & ~F.col("declared_class").eqNullSafe(F.col("source_class")), "class_mismatch")
    return out.withColumn("reason", reason).drop("_known", "declared_class")


def latest_before(rows: DataFrame, value: Column) -> DataFrame:
    """Adds _before: the largest ``value`` of the rows of the stream with a lower ordinal.

    The sort stays inside a block of ordinals; over blocks only their maxima are ordered.
    """
    rows = rows.withColumns({"_block": F.floor(F.col("ordinal") / BLOCK), "_value": value})
    most = rows.groupBy("stream", "_block").agg(F.max("_value").alias("_most"))
    above = F.max("_most").over(Window.partitionBy("stream").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    most = most.select("stream", "_block", above.alias("_above"))
    inside = F.max("_value").over(Window.partitionBy("stream", "_block").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_inside", inside).join(most, ["stream", "_block"]).withColumn("_before", F.greatest("_inside", "_above")).drop("_block", "_value", "_inside", "_above")


def order_and_identity(rows: DataFrame) -> DataFrame:
    """Adds duplicate_id and time_order to rows without a reason.

    Each round judges one copy of every id, the first one at the start: a copy is late when a judged
    event of its stream (its ``stream`` where the rows have one, else its source) stands before it with
    a later time (as text).  Where the judged copy is late,
    the next one that is not enters; those passed over stay late, as times to be held against only
    grow.  Rounds go on until no copy enters, whatever their number.  The rows are written first, as
    each is read three times and may be dear to make.
    """
    rows = written(rows, "arrived")
    good, bad = rows.where("reason is null"), rows.where("reason is not null")
    stream = F.coalesce("stream", "source") if "stream" in rows.columns else F.col("source")
    slim = written(good.select("id", stream.alias("stream"), "ordinal", "time"), "order")
    now = written(slim.groupBy("id").agg(F.min("ordinal").alias("_at")), "order-ids")
    while True:
        held = latest_before(slim.join(now, "id"), F.when(F.col("ordinal") == F.col("_at"), F.col("time")))
        fits = (F.col("ordinal") >= F.col("_at")) & ~F.coalesce(F.col("time") < F.col("_before"), F.lit(False))
        step = held.groupBy("id").agg(F.first("_at").alias("_was"), F.min(F.when(fits, F.col("ordinal"))).alias("_at"))
        step = written(step, "order-ids")
        now = step.select("id", "_at")
        if step.where(~F.col("_at").eqNullSafe(F.col("_was"))).isEmpty():
            break
    # before the accepted copy all are late, after it all are duplicates; an id may have none
    reason = F.when(F.col("_at").isNull() | (F.col("ordinal") < F.col("_at")), "time_order").when(F.col("ordinal") > F.col("_at"), "duplicate_id")
    judged = good.join(now, "id").withColumn("reason", reason).select(rows.columns)
    return judged.unionByName(bad)


def ingest(rows: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """All rows with ``reason``: null for accepted ones."""
    return order_and_identity(row_reason(rows, sources))
