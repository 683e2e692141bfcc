"""Driver tables read as audit evidence.

One wide row per event: an envelope (id, subject, ordinal, etype, source, source_class, time) and the
typed payload members that rules read.  References hold event ids of the same subject.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Events of a partition that makes many rows of each.
DEALT = 32_768


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chosen(pairs: list[tuple[Column, str]], other: str | None = None) -> Column:
    out = None
    for test, value in pairs:
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(F.lit(other)) if other is not None else out


def event_types(events: DataFrame) -> DataFrame:
    """Adds k, etype and subject to the raw ``events`` table."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = F.col("event_type")
    etype = (
        F.when(e == "purchase", "Decision")
        .when(e == "click", "ToolCall")
        .when(e == "signup", chosen([(F.col("k") % 4 == 0, "Notice"), (F.col("k") % 4 == 1, "Outcome")], "ApprovalDecided"))
        .when(e == "view", chosen([(F.col("k") % 4 == 0, "Instruction"), (F.col("k") % 4 == 1, "DelegationIssued"), (F.col("k") % 4 == 2, "ResourceAccess")], "ModelCall"))
        .when(e == "error", chosen([(F.col("k") % 3 == 0, "Incident"), (F.col("k") % 3 == 1, "PolicyDecision")], "Refusal"))
    )
    return events.withColumn("k", k).withColumn("etype", etype).withColumn("subject", F.concat(F.lit("agent-"), F.col("user_id")))


def evidence(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """The ``events`` table as evidence; one window per subject finds each event's predecessors.

    With ``dealt``, subjects are dealt over partitions of about DEALT events, and no fewer than the shuffle
    partitions, for what makes many rows of each event: as many partitions for any number of events, or such
    as are put together by the size of their events, would be too large for it.
    """
    rows = event_types(table(spark, sf_dir, "events"))
    if dealt:
        parts = -(-table(spark, sf_dir, "events").count() // DEALT)  # Parquet has this number in its footers
        rows = rows.repartition(max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))), "subject")
    # by subject, which names the user: so the rows stay dealt by it
    before = Window.partitionBy("subject").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    prev = lambda t: F.max(F.when(F.col("etype") == t, F.col("event_id"))).over(before)
    for name, t in (("pd", "Decision"), ("pg", "DelegationIssued"), ("pi", "Instruction"), ("pt", "ToolCall"), ("pp", "PolicyDecision")):
        rows = rows.withColumn(name, prev(t))
    k, etype = F.col("k"), F.col("etype")
    iri = lambda c: F.concat(F.lit("e"), c)
    source_class = (
        F.when(etype == "ToolCall", F.when(k % 4 == 0, "self_report").otherwise("enforcement_point"))
        .when(etype.isin("Decision", "ModelCall"), "self_report")
        .when(etype.isin("Incident", "ApprovalDecided", "Notice", "Outcome"), "independent_system")
        .otherwise("enforcement_point")
    )
    return rows.select(
        iri(F.col("event_id")).alias("id"),
        "subject",
        (2 * F.col("event_id")).alias("ordinal"),
        "etype",
        F.concat(F.lit("src:"), source_class).alias("source"),
        source_class.alias("source_class"),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z")).alias("time"),
        F.when(k % 11 != 0, F.col("subject")).alias("agent"),
        F.when(k % 7 != 0, F.array(F.concat(F.lit("ctx-"), k))).otherwise(F.array().cast("array<string>")).alias("used"),
        F.when(etype == "Decision", chosen([(k % 3 == 0, "dom:Credit"), (k % 3 == 1, "dom:Hiring")], "dom:Minor")).alias("decision_type"),
        F.when(etype == "Decision", F.when(k % 5 == 0, "review_after").otherwise("review_before")).alias("oversight_modality"),
        F.when(etype.isin("ToolCall", "ApprovalDecided", "Notice", "Outcome"), F.when(k % 10 == 7, iri(F.col("event_id") + 100000000)).otherwise(iri(F.col("pd")))).alias("ref_decision"),
        F.when(etype == "ToolCall", iri(F.col("pg"))).alias("ref_delegation"),
        F.when(etype.isin("ToolCall", "Decision", "Refusal"), iri(F.col("pi"))).alias("ref_instruction"),
        F.when(etype.isin("PolicyDecision", "Refusal"), iri(F.col("pt"))).alias("ref_request"),
        F.when(etype == "Decision", iri(F.col("pp"))).alias("ref_authorization"),
        F.when(etype == "DelegationIssued", k % 6 != 0).alias("chain_verified"),
        F.when(etype == "Instruction", F.when(k % 3 == 0, "tool_output").otherwise("user")).alias("instruction_class"),
        F.when(etype == "PolicyDecision", F.when(k % 2 == 0, "deny").otherwise("allow")).alias("policy_decision"),
        F.when(etype == "Refusal", F.when(k % 2 == 0, "budget_exceeded").otherwise("scope_exceeded")).alias("reason_class"),
        F.when(etype == "ToolCall", F.when(k % 8 == 0, F.array(F.lit("svc-1"))).otherwise(F.array(F.concat(F.lit("human-"), k % 5)))).otherwise(F.array().cast("array<string>")).alias("acted_for"),
        F.when(etype == "ApprovalDecided", F.round(F.col("value") * 1000).cast("long")).alias("latency_ms"),
        F.when(etype == "ApprovalDecided", k % 2 == 0).alias("viewed"),
        F.when(etype == "Incident", F.concat(F.lit("inc-"), k % 7)).alias("incident_id"),
        "k",
    )


def domain(spark: SparkSession) -> DataFrame:
    """Decision types: parent class, the consequential flag, required oversight."""
    rows = [("dom:Credit", "ConsequentialDecision", True, "review_before"), ("dom:Hiring", "Decision", True, None), ("dom:Minor", "Decision", False, None)]
    return spark.createDataFrame(rows, "decision_type string, parent string, consequential boolean, required_modality string")


def principals(ev: DataFrame) -> DataFrame:
    """Classes of the principals that the binding names: svc-* are services, human-* humans."""
    return ev.select("subject", F.explode_outer("acted_for").alias("principal")).where("principal is not null").distinct().withColumn("class", F.when(F.col("principal").startswith("human-"), "HumanPrincipal").otherwise("ServicePrincipal"))


def raw_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence as it would arrive: with copies, late clocks, unknown types and unknown sources."""
    ev = evidence(spark, sf_dir).withColumn("n", F.expr("ordinal div 2"))
    late = F.concat(F.date_format(F.to_timestamp_ntz(F.substring("time", 1, 23), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS")) - F.expr("interval 1 day"), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    feed = ev.select(
        "id", "subject", "ordinal", F.when(F.col("n") % 211 == 6, "Heartbeat").otherwise(F.col("etype")).alias("etype"), F.when(F.col("n") % 199 == 7, "src:unknown").otherwise(F.col("source")).alias("source"),
        "source_class", F.when(F.col("n") % 83 == 4, late).otherwise(F.col("time")).alias("time"), "n",
    )
    return feed.union(feed.where("n % 50 = 0").withColumn("ordinal", F.col("ordinal") + 1)).drop("n")


def sources(spark: SparkSession) -> DataFrame:
    """Declared sources and their class."""
    return spark.createDataFrame([(f"src:{c}", c) for c in ("enforcement_point", "independent_system", "self_report")], "source string, declared_class string")


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash-chained rows per stream (source and subject), with the binding's planted faults."""
    ev = evidence(spark, sf_dir).withColumn("n", F.expr("ordinal div 2")).withColumn("stream", F.concat_ws("|", "source", "subject"))
    true = F.sha2(F.concat_ws("|", "id", "subject", "etype", "k"), 256)
    rows = ev.select("stream", "id", "ordinal", "time", "n", true.alias("content_hash")).withColumn("hash", F.when(F.col("n") % 997 == 3, F.sha2(F.lit("tampered"), 256)).otherwise(F.col("content_hash")))
    back = F.lag("hash", 1, "0" * 64).over(Window.partitionBy("stream").orderBy("ordinal"))
    return rows.withColumn("prev", F.when(F.col("n") % 1009 == 5, F.sha2(F.lit("gap"), 256)).otherwise(back)).drop("n")
