"""Queries that start from events as JSON lines: files to outcomes, odd payloads, typed principals."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import assess as az
from ..operators import catalog as cat
from ..operators import facts as fx
from ..operators import ingest as ing
from ..operators import integrity as it
from ..sources import binding as bd
from ..sources import logs as lg
from ..sources import payload as pl
from ..sources import spans as sp
from ..sources.scratch import shared_dir
from .. import functions as fn
from .. import streaming
from . import sql
from .evidence import CHAIN, subjects
from .evidence import ORACLE as EVIDENCE
from .sql import with_

QUERIES, ORACLE = {}, {}


def query(text: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, text
        return f

    return add


def own_folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def as_named(x):
    """The kind that the binding's names of principals tell."""
    return F.when(x.startswith("human-"), "human").otherwise("service")


@query(EVIDENCE["control_outcomes"])
def outcomes_from_lines(spark, d):
    """Outcome of each control for each subject, from lines alone: the events are written as files of JSON
    lines, scanned, ingested, shredded and assessed."""
    path = own_folder(spark, "lines")
    pl.write_lines(pl.event_lines(bd.evidence(spark, d), as_named), path)
    ev = pl.evidence_of(spark, path, bd.sources(spark))
    out = az.assess(ev, fx.facts(ev, bd.domain(spark), pl.principal_classes(ev)), cat.controls(spark), subjects(spark, d))
    return out.select("subject", "catalog", "control", "outcome", "applicable", "failed", F.array_join("missing", ",").alias("missing"))


ODD = """,
odd AS (SELECT id, subject, etype, k, '{"@type": ' || CASE WHEN k % 37 = 0 THEN '7' WHEN k % 31 = 0 THEN '"Notice"' ELSE '"' || etype || '"' END || ', "agent": ' || CASE WHEN k % 7 = 0 THEN '"a"' WHEN k % 7 = 1 THEN '{"id": 7}' WHEN k % 7 = 2 THEN '{"id": null}' ELSE '{"id": "a' || (k % 3) || '"}' END
    || ', "used": ' || CASE WHEN k % 5 = 0 THEN '"ctx"' WHEN k % 5 = 1 THEN '[1, "ctx-1", null, "event:' || id || '"]' ELSE '["ctx-' || k || '"]' END
    || ', "acted_for": ' || CASE WHEN k % 6 = 0 THEN '["p1", "p2"]' WHEN k % 6 = 1 THEN '[{"id": "p3", "kind": "human"}]' WHEN k % 6 = 2 THEN '["p1", {"kind": "human"}]' WHEN k % 6 = 3 THEN '[]' ELSE '"p4"' END
    || ', "refs": ' || CASE WHEN k % 8 = 0 THEN '["event:e1"]' WHEN k % 8 = 1 THEN '{"decision": 5, "request": "event:e2", "basis": "event:gone"}' ELSE '{"decision": "event:' || id || '", "other": "not an event"}' END
    || ', "chain_verified": ' || CASE k % 9 WHEN 0 THEN 'null' WHEN 1 THEN '0' WHEN 2 THEN '""' WHEN 3 THEN '[]' WHEN 4 THEN '"no"' WHEN 5 THEN '[0]' WHEN 6 THEN '1' WHEN 7 THEN '{}' ELSE 'true' END
    || ', "latency_ms": ' || CASE k % 4 WHEN 0 THEN '1.5' WHEN 1 THEN '"7"' ELSE k::VARCHAR END || ', "explanation_viewed": ' || CASE k % 3 WHEN 0 THEN '"yes"' WHEN 1 THEN 'false' ELSE 'true' END || '}' AS data FROM ev)"""


def odd_payloads(spark, d):
    """The evidence with payloads whose members are often of another kind than their columns."""
    k, s = F.col("k"), lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    pick = lambda n, *cases: bd.chosen([(k % n == i, F.lit(c) if isinstance(c, str) else c) for i, c in enumerate(cases[:-1])]).otherwise(F.lit(cases[-1]) if isinstance(cases[-1], str) else cases[-1])
    data = s(
        '{"@type": ', F.when(k % 37 == 0, "7").when(k % 31 == 0, '"Notice"').otherwise(s('"', F.col("etype"), '"')), ', "agent": ', pick(7, '"a"', '{"id": 7}', '{"id": null}', s('{"id": "a', (k % 3).cast("string"), '"}')),
        ', "used": ', pick(5, '"ctx"', s('[1, "ctx-1", null, "event:', F.col("id"), '"]'), s('["ctx-', k.cast("string"), '"]')), ', "acted_for": ', pick(6, '["p1", "p2"]', '[{"id": "p3", "kind": "human"}]', '["p1", {"kind": "human"}]', "[]", '"p4"'),
        ', "refs": ', pick(8, '["event:e1"]', '{"decision": 5, "request": "event:e2", "basis": "event:gone"}', s('{"decision": "event:', F.col("id"), '", "other": "not an event"}')),
        ', "chain_verified": ', pick(9, "null", "0", '""', "[]", '"no"', "[0]", "1", "{}", "true"), ', "latency_ms": ', pick(4, "1.5", '"7"', k.cast("string")), ', "explanation_viewed": ', pick(3, '"yes"', "false", "true"), "}",
    )
    return bd.evidence(spark, d).select("id", "subject", "etype", data.alias("data"))


def _text(path: str) -> str:
    return f"CASE WHEN json_type(data, '{path}') = 'VARCHAR' THEN data ->> '{path}' END"


@query(
    with_(sql.EV)
    + ODD
    + f""", t AS (SELECT *, CASE WHEN k % 37 = 0 THEN etype WHEN k % 31 = 0 THEN 'Notice' ELSE etype END AS own FROM odd)
SELECT 'event:' || id AS id, own AS etype, {_text("$.agent.id")} AS agent, CASE WHEN k % 5 = 0 THEN 0 WHEN k % 5 = 1 THEN 2 ELSE 1 END AS n_used, CASE k % 6 WHEN 0 THEN 'p2' WHEN 1 THEN 'p3' END AS terminus,
  {_text("$.refs.decision")} AS ref_decision, {_text("$.refs.request")} AS ref_request, CASE WHEN own = 'DelegationIssued' THEN k % 9 IN (4, 5, 6, 8) END AS chain_verified,
  CASE WHEN own = 'ApprovalDecided' AND json_type(data, '$.latency_ms') IN ('UBIGINT', 'BIGINT') THEN (data ->> '$.latency_ms')::BIGINT END AS latency_ms, CASE WHEN own = 'ApprovalDecided' AND k % 3 > 0 THEN k % 3 = 2 END AS viewed,
  array_to_string(list_sort(list_distinct(list_concat(CASE WHEN k % 8 = 0 THEN [] WHEN k % 8 = 1 THEN ['event:e2', 'event:gone'] ELSE ['event:' || id] END, CASE WHEN k % 5 = 1 THEN ['event:' || id] ELSE [] END))), ',') AS linked FROM t"""
)
def payload_columns(spark, d):
    """The columns of each event whose payload has members of other kinds, objects for texts and texts for lists."""
    ev = pl.shredded(odd_payloads(spark, d))
    return ev.select("id", "etype", "agent", F.size("used").alias("n_used"), F.try_element_at("acted_for", F.lit(-1)).alias("terminus"), "ref_decision", "ref_request", "chain_verified", "latency_ms", "viewed", F.array_join(F.array_sort("linked"), ",").alias("linked"))


@query(
    with_(sql.EV)
    + """, named AS (SELECT subject, terminus AS p, CASE k % 5 WHEN 0 THEN 'ServicePrincipal' WHEN 1 THEN 'HumanPrincipal' ELSE 'Principal' END AS c FROM ev WHERE terminus IS NOT NULL
    UNION ALL SELECT subject, 'human-' || (k % 5), CASE WHEN k % 3 = 0 THEN 'HumanPrincipal' ELSE 'ServicePrincipal' END FROM ev WHERE etype = 'DelegationIssued')
SELECT DISTINCT subject, p AS principal, unnest(CASE c WHEN 'Principal' THEN ['Principal', 'Agent'] ELSE [c, 'Principal', 'Agent'] END) AS class FROM named"""
)
def principal_classes(spark, d):
    """Classes of each subject's principals, as chains of its calls and delegations give them; some give one two kinds."""
    ev, k = bd.evidence(spark, d), F.col("k")
    chain = F.when(F.col("etype") == "DelegationIssued", F.array(F.struct(F.concat(F.lit("human-"), k % 5).alias("id"), F.when(k % 3 == 0, "human").otherwise("service").alias("kind"))))
    lines = pl.event_lines(ev.withColumn("chain", chain), lambda x: F.when(k % 5 == 0, "service").when(k % 5 == 1, "human"))
    path = own_folder(spark, "lines")
    pl.write_lines(lines, path)
    return pl.principal_classes(pl.evidence_of(spark, path))


# -- spans ------------------------------------------------------------------------------------------


def span_documents(spark, d):
    """A span document for each turn, of both conventions, with attributes that are missing or of another kind here and there."""
    t = bd.table(spark, d, "conversations").where("conv_id is not null and turn is not null").withColumn("j", (F.col("conv_id") + F.col("turn")) % 9)
    c, n, second = F.col("conv_id"), F.col("turn"), F.col("conv_id") % 2 == 1
    text = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct((F.lit(v) if isinstance(v, str) else v.cast("string")).alias("stringValue"), F.lit(None).cast("string").alias("intValue")).alias("value"))
    whole = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(F.lit(None).cast("string").alias("stringValue"), v.cast("string").alias("intValue")).alias("value"))
    named = lambda *names: bd.chosen([(F.col("j") == i, F.lit(x)) for i, x in enumerate(names) if x])
    op = named("chat", "execute_tool", "invoke_agent", "retrieval", "memory.write", "memory.read", "dance", None, "embeddings")
    kind = named("LLM", "TOOL", "AGENT", "RETRIEVER", "CHAIN", "EMBEDDING", "RERANKER", None, "LLM")
    either = lambda k1, k2, f, v: F.when(second, f(k2, v)).otherwise(f(k1, v))
    attributes = F.array_compact(
        F.array(
            F.when(~second & op.isNotNull(), text("gen_ai.operation.name", op)), F.when(second & kind.isNotNull(), text("openinference.span.kind", kind)), F.when(c % 5 == 3, whole("gen_ai.agent.id", c)).otherwise(text("gen_ai.agent.id", F.concat(F.lit("agent-"), c % 5))),
            either("gen_ai.conversation.id", "session.id", text, F.concat(F.lit("c"), c)), either("gen_ai.system", "llm.provider", text, F.lit("sys")), either("gen_ai.request.model", "llm.model_name", text, F.concat(F.lit("m"), n % 3)),
            either("gen_ai.usage.prompt_tokens", "llm.token_count.prompt", whole, n), F.when(n % 4 == 0, text("gen_ai.usage.output_tokens", "many")).otherwise(text("gen_ai.usage.output_tokens", n * 2)), F.when(n % 2 == 0, either("gen_ai.tool.name", "tool.name", text, F.concat(F.lit("tool-"), n))),
            F.when(c % 3 < 2, text("gen_ai.tool.protocol", F.when(c % 3 == 0, "mcp").otherwise("smoke"))), F.when(n % 3 > 0, text("retrieval.source", F.concat(F.lit("db"), n))), whole("retrieval.documents.count", n + 1), text("gen_ai.memory.store", "st"),
            text("gen_ai.memory.trust", F.when(n % 2 == 0, "trusted").otherwise("maybe")), F.when(c % 4 == 0, text("gen_ai.task.id", F.concat(F.lit("task-"), c))), F.when(n % 2 == 1, text("input.value", "secret")),
        )
    )
    ns = ((F.lit(1_700_000_000_000) + c * 60_000 + n * 1_001) * 1_000_000 + 999_999).cast("string")
    span = F.struct(F.concat(F.lit("t"), c).alias("traceId"), F.concat(F.lit("s"), n).alias("spanId"), F.when(n > 0, F.concat(F.lit("s"), n - 1)).alias("parentSpanId"), F.concat(F.lit("span-"), n).alias("name"), F.when((n % 6 != 5) & (c % 7 != 6), ns).alias("startTimeUnixNano"), F.when(c % 7 != 6, ns).alias("endTimeUnixNano"), attributes.alias("attributes"), F.when(n % 5 == 0, F.struct(F.lit(2).alias("code"), F.when(c % 3 == 0, "broken").alias("message"))).alias("status"))
    scope = F.struct(F.struct(F.when(second, "openinference.x").otherwise("demo").alias("name"), F.when(c % 3 > 0, "0.1").alias("version")).alias("scope"), F.when(c % 3 == 0, "https://example.com/schemas/1.30.0/").alias("schemaUrl"), F.array(span).alias("spans"))
    resource = F.struct(F.struct(F.array(text("service.name", F.concat(F.lit("svc-"), c % 2)), text("gen_ai.tool.protocol", "http")).alias("attributes")).alias("resource"), F.lit("https://example.com/schemas/1.27").alias("schemaUrl"), F.array(scope).alias("scopeSpans"))
    return t.select(F.to_json(F.struct(F.array(resource).alias("resourceSpans"))).alias("doc"))


@query(
    """WITH t AS (SELECT conv_id AS c, turn AS n, (conv_id + turn) % 9 AS j, conv_id % 2 = 1 AS second FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
o AS (SELECT *, CASE WHEN j = 7 THEN NULL WHEN second THEN CASE j WHEN 0 THEN 'ModelCall' WHEN 8 THEN 'ModelCall' WHEN 5 THEN 'ModelCall' WHEN 1 THEN 'ToolCall' WHEN 2 THEN 'Session' WHEN 3 THEN 'ResourceAccess' ELSE 'none' END
    ELSE CASE j WHEN 0 THEN 'ModelCall' WHEN 8 THEN 'ModelCall' WHEN 1 THEN 'ToolCall' WHEN 2 THEN 'Session' WHEN 3 THEN 'ResourceAccess' WHEN 4 THEN 'MemoryWrite' WHEN 5 THEN 'MemoryRead' ELSE 'none' END END AS op,
    strftime(make_timestamp((1700000000000 + c * 60000 + n * 1001) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS tm FROM t),
r AS (SELECT *, CASE WHEN op IS NULL THEN 'missing_operation' WHEN op = 'none' THEN 'unrecognised_operation' WHEN c % 7 = 6 THEN 'no_time' END AS reason FROM o),
e AS (SELECT *, unnest(CASE WHEN reason IS NOT NULL THEN [NULL] WHEN op = 'Session' THEN ['SessionStart', 'SessionEnd'] ELSE [op] END) AS etype FROM r)
SELECT CASE WHEN reason IS NULL THEN 'otel:t' || c || '/s' || n || CASE etype WHEN 'SessionStart' THEN '#session-start' WHEN 'SessionEnd' THEN '#session-end' ELSE '' END END AS id, etype, CASE WHEN reason IS NULL THEN tm END AS time, 'urn:otel:svc-' || (c % 2) AS source,
  CASE WHEN second THEN 'openinference' || CASE WHEN c % 3 > 0 THEN ':0.1' ELSE '' END ELSE CASE WHEN c % 3 = 0 THEN 'genai:1.30' ELSE 'genai:1.27' END END AS convention, CASE WHEN n > 0 THEN 's' || (n - 1) END AS parent_id, CASE WHEN c % 4 = 0 THEN 'task-' || c END AS task,
  CASE WHEN reason IS NULL AND c % 5 <> 3 THEN 'agent-' || (c % 5) END AS agent, CASE WHEN reason IS NULL THEN 'c' || c END AS session_id, CASE WHEN etype = 'ModelCall' THEN CASE WHEN (second AND j = 5) OR (NOT second AND j = 8) THEN 'embeddings' ELSE 'chat' END WHEN etype = 'ResourceAccess' THEN 'read' END AS operation,
  CASE WHEN etype = 'ModelCall' THEN 'sys/m' || (n % 3) END AS model, CASE WHEN etype = 'ModelCall' THEN n END AS input_tokens, CASE WHEN etype = 'ModelCall' AND n % 4 > 0 THEN n * 2 END AS output_tokens,
  CASE WHEN etype = 'ToolCall' THEN CASE WHEN n % 2 = 0 THEN 'tool-' || n ELSE 'span-' || n END END AS tool, CASE WHEN etype = 'ToolCall' THEN CASE c % 3 WHEN 0 THEN 'mcp' WHEN 2 THEN 'http' END END AS protocol,
  CASE WHEN etype = 'ToolCall' AND n % 2 = 1 THEN 'otel:t' || c || '/s' || n || '#args' END AS args_ref, CASE WHEN etype = 'ResourceAccess' THEN CASE WHEN n % 3 > 0 THEN 'db' || n ELSE 'span-' || n END END AS uri, CASE WHEN etype = 'ResourceAccess' THEN n + 1 END AS docs,
  CASE WHEN etype IN ('MemoryWrite', 'MemoryRead') THEN 'st' END AS store, CASE WHEN etype = 'MemoryWrite' AND n % 2 = 0 THEN 'trusted' END AS trust, CASE WHEN etype IN ('ModelCall', 'ToolCall') AND n % 5 = 0 THEN CASE WHEN c % 3 = 0 THEN 'broken' ELSE 'error' END END AS error,
  CASE WHEN etype = 'SessionEnd' THEN CASE WHEN n % 5 = 0 THEN 'error' ELSE 'completed' END END AS end_reason, reason FROM e"""
)
def span_payloads(spark, d):
    """Each span's event with the members of its payload, or why it gives none."""
    ev = sp.span_events(sp.spans_of(span_documents(spark, d)), "agent-otel", "self_report")
    part = lambda c, name: F.col(c).alias(name)
    return ev.select(
        "id", "etype", "time", "source", "convention", "parent_id", "task", part("agent.id", "agent"), "session_id", "operation", F.when(F.col("model").isNotNull(), F.concat_ws("/", "model.provider", "model.name")).alias("model"), part("usage.input_tokens", "input_tokens"), part("usage.output_tokens", "output_tokens"),
        part("tool.name", "tool"), part("tool.protocol", "protocol"), "args_ref", part("resource.uri", "uri"), part("count", "docs"), "store", "trust", "error", "end_reason", "reason",
    )


# -- streams ----------------------------------------------------------------------------------------


@query(with_(sql.EV) + CHAIN + """ SELECT stream, id, idx, CASE WHEN broken THEN 'broken' WHEN unlinked THEN 'unlinked' WHEN time < max(time) OVER (PARTITION BY stream ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'time_order' END AS finding FROM m""")
def chain_stream(spark, d):
    """Each event's place in its hash chain and what is wrong with it, judged as events arrive in four parts."""
    return streaming.replay(bd.chain(spark, d), streaming.chain_continuity, own_folder(spark, "chain-stream"))


@query(with_(sql.EV) + "SELECT id, etype, subject FROM ev")
def deduplicated_stream(spark, d):
    """Events as they arrive in four parts, some again in the next part, each id once."""
    ev = bd.evidence(spark, d).select("id", "etype", "subject", "time", "ordinal")
    again = ev.where(F.expr("ordinal div 2") % 5 == 0)
    twice = ev.union(again.withColumn("ordinal", F.col("ordinal") + 1)).union(again.withColumn("ordinal", F.col("ordinal") + 501))
    return streaming.replay(twice, streaming.deduplicated, own_folder(spark, "deduplicated")).select("id", "etype", "subject")


@query("SELECT subject, catalog, control, outcome FROM (" + EVIDENCE["control_outcomes"] + ")")
def incremental_outcomes(spark, d):
    """Outcomes of all pairs after the events arrived in three parts, each of which assessed the subjects that
    it touched and wrote the outcomes that it changed; compacted after the second."""
    path = own_folder(spark, "incremental")

    def assess(ev):
        # subjects and people are as many as the evidence has: neither is gathered in the driver, however small its files
        roles = subjects(spark, d).hint("merge")
        return az.assess(ev, fx.facts(ev, bd.domain(spark), bd.principals(ev).hint("merge")), cat.controls(spark), ev.select("subject").distinct().join(roles, "subject"))

    step = streaming.reassess(assess, path)

    def each(batch, number):
        step(batch, number)
        if number == 1:
            streaming.compact(batch.sparkSession, path, number)

    streaming.replay(bd.evidence(spark, d), lambda rows: rows, path + "-stream", 3, each=each)
    return streaming.outcomes(spark, path)


# -- canonical hashes -------------------------------------------------------------------------------

HASHED = """,
cl AS (SELECT id, subject, ordinal, time, ordinal // 2 AS n, CASE WHEN k % 13 = 0 THEN 'number is not an integer' WHEN k % 17 = 0 THEN 'integer out of range' WHEN k % 19 = 0 THEN 'duplicate key' END AS error,
    '{"data":{"k":' || k || ',"name":"' AS head, '","z":[1,null,true,"' || chr(10) || '"]},"id":"' AS mid, id || '","time":"' || time || '","type":"' || etype || '"}' AS tail FROM ev),
ch AS (SELECT *, CASE WHEN error IS NULL THEN sha256(head || CASE WHEN n % 97 = 3 THEN 'Eve' ELSE 'Amélie' END || replace(mid, chr(10), '\\n') || tail) END AS found, CASE WHEN error IS NULL THEN sha256(head || 'Amélie' || replace(mid, chr(10), '\\n') || tail) ELSE sha256(id) END AS claimed FROM cl)"""


def hashed_lines(spark, d):
    """Events as lines in no canonical form: keys in another order, letters with their marks apart, spaces,
    an integrity block that is no part of the hash, and here and there what no hash can be taken of.  One
    line in 97 was changed after its hash was claimed."""
    k, n = F.col("k"), F.expr("ordinal div 2")
    number = F.when(k % 13 == 0, "1.5").when(k % 17 == 0, "9007199254740993").when(k % 19 == 0, '1, "k": 2').otherwise(k.cast("string"))
    line = lambda name: F.concat(F.lit('{"type": "'), "etype", F.lit('", "id": "'), "id", F.lit('", "data": {"z": [1, null,true, "\\n"], "integrity": {"hash": "h"}, "name": "'), name, F.lit('", "k": '), number, F.lit('}, "time": "'), "time", F.lit('"}'))
    own = F.lit("Amélie")
    rows = bd.evidence(spark, d).select("id", "subject", "ordinal", "time", line(F.when(n % 97 == 3, "Eve").otherwise(own)).alias("line"), F.when(n % 97 == 3, line(own)).alias("first"))
    # a line that was not changed is hashed once
    rows = rows.select("*", fn.canonical_hash("line").alias("now"), fn.canonical_hash("first").alias("then"))
    return rows.select("id", F.col("subject").alias("stream"), "ordinal", "time", F.col("now.hash").alias("content_hash"), F.col("now.error").alias("error"), F.coalesce(F.when(F.col("first").isNull(), F.col("now.hash")).otherwise(F.col("then.hash")), F.sha2("id", 256)).alias("hash"))


@query(with_(sql.EV) + HASHED + " SELECT id, found AS content_hash, error FROM ch")
def canonical_hashes(spark, d):
    """Hash of each event's canonical text, or why it has none."""
    return hashed_lines(spark, d).select("id", "content_hash", "error")


@query(
    with_(sql.EV)
    + HASHED
    + """, w AS (SELECT subject AS stream, row_number() OVER (PARTITION BY subject ORDER BY ordinal) - 1 AS idx, found IS NULL OR found <> claimed AS bad FROM ch)
SELECT stream, 'export_chained' AS strength, CASE WHEN bool_or(bad) THEN 'failed' ELSE 'verified_weak' END AS status, min(idx) FILTER (bad) AS first_bad_index, count(*) AS n_events FROM w GROUP BY stream"""
)
def tampered_streams(spark, d):
    """Status of each subject's chain whose links hold, from what its lines contain: tampering shows in the content alone."""
    rows = hashed_lines(spark, d)
    back = F.lag("hash", 1, it.GENESIS).over(Window.partitionBy("stream").orderBy("ordinal"))
    return it.stream_status(rows.withColumn("prev", back))


# -- gateway and identity logs ----------------------------------------------------------------------

LOGGED = """,
lg AS (SELECT id, subject, k, time, CASE WHEN k % 41 = 0 THEN 'malformed' WHEN k % 43 = 0 THEN 'missing_member' END AS bad, CASE k % 3 WHEN 0 THEN 'ToolCall' WHEN 1 THEN 'ResourceAccess' END AS method, k % 4 < 3 AS pol, k % 4 = 1 AS deny, k % 5 = 0 AS del FROM ev)"""


def log_lines(spark, d):
    """A gateway line for each event: calls, reads and neither, with and without a decision and a delegation, some malformed."""
    k = F.col("k")
    s = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    request = bd.chosen([(k % 3 == 0, s('{"method": "tools/call", "params": {"name": "tool-', k, '", "arguments": {"a": 1}}}')), (k % 3 == 1, s('{"method": "resources/read", "params": {"uri": "db-', k, '", "kind": 5}}'))], '{"method": "ping"}')
    policy = F.when(k % 4 < 3, s('{"engine": "', F.when(k % 2 == 0, "opa").otherwise("own"), '", "policy_id": "p', k % 6, '", "decision": "', F.when(k % 4 == 1, "deny").otherwise("allow"), '", "reasons": ["r1", 2, "r3"], "principal": {"id": "u", "kind": "human", "org": "o"}}')).otherwise("{}")
    chain = s('[{"id": "h', k % 7, '", "kind": "human", "role": "owner"}, {"id": "x", "kind": "robot"}, {"id": "s", "kind": "service"}]')
    delegation = F.when(k % 5 == 0, s('{"token_ref": "tk', k, '", "issuer": "idp", "chain": ', chain, ', "scope_granted": ["a", "b"], "scope_parent": [], "expires": "2030", "verification": {"status": "', F.when(k % 2 == 0, "verified").otherwise("so-so"), '", "method": "sig"}}')).otherwise("null")
    body = s('"timestamp": "', F.col("time"), '", "trace_id": "', F.col("subject"), '", "span_id": "', F.col("id"), '", "request": ', request, ', "policy": ', policy, ', "delegation": ', delegation, ', "effect": {"side_effect": "write", "effect_class": "', F.when(k % 2 == 0, "spend").otherwise("fun"), '"}, "response": {"outcome": "', F.when(k % 6 == 0, "error").otherwise("ok"), '", "result_ref": "r', k, '"}')
    line = F.when(k % 41 == 0, "{").otherwise(s("{", body, F.when(k % 43 == 0, "").otherwise(', "gateway": "g1"'), "}"))
    own = s('{"timestamp": "', F.col("time"), '", "id": "', F.col("id"), '", "format": "jwt"', F.when(k % 2 == 0, ', "convention_version": "2"').otherwise(""), F.when(k % 9 == 0, "").otherwise(s(', "token_ref": "tk', k, '"')), ', "issuer": "idp", "chain": ', chain, ', "scope_granted": ["a", "b"], "expires": "2030", "acted_for": ["u1", 7]}')
    return bd.evidence(spark, d).select(line.alias("line"), own.alias("identity"))


@query(
    with_(sql.EV)
    + LOGGED
    + """, ran AS (SELECT *, method IS NOT NULL AND NOT (pol AND deny) AS ran FROM lg),
n AS (SELECT *, bad IS NULL AND NOT pol AND NOT ran AND NOT del AS empty FROM ran),
e AS (SELECT *, unnest(CASE WHEN bad IS NOT NULL OR empty THEN [NULL] ELSE list_concat(list_concat(CASE WHEN pol THEN ['PolicyDecision'] ELSE [] END, CASE WHEN ran THEN [method] ELSE [] END), CASE WHEN del THEN ['DelegationIssued'] ELSE [] END) END) AS etype FROM n)
SELECT CASE WHEN etype IS NOT NULL THEN 'gw:' || subject || '/' || id || CASE etype WHEN 'PolicyDecision' THEN '#policy' WHEN 'DelegationIssued' THEN '#delegation' ELSE '' END END AS id, etype, CASE WHEN bad = 'malformed' THEN NULL ELSE time END AS time, coalesce(bad, CASE WHEN empty THEN 'nothing_to_report' END) AS reason,
  CASE WHEN etype = 'PolicyDecision' AND k % 2 = 0 THEN 'opa' END AS engine, CASE WHEN etype = 'PolicyDecision' THEN CASE WHEN deny THEN 'deny' ELSE 'allow' END END AS decision, CASE WHEN etype = 'PolicyDecision' THEN '["r1","r3"]' END AS reasons, CASE WHEN etype = 'PolicyDecision' AND ran THEN 'event:gw:' || subject || '/' || id END AS request,
  CASE WHEN etype = 'ToolCall' THEN 'tool-' || k END AS tool, CASE WHEN etype = 'ToolCall' THEN 'gw:' || subject || '/' || id || '#args' END AS args_ref, CASE WHEN etype = 'ToolCall' THEN 'r' || k END AS result_ref, CASE WHEN etype = 'ToolCall' AND k % 2 = 0 THEN 'spend' END AS effect_class, CASE WHEN etype = 'ToolCall' AND k % 6 = 0 THEN 'error' END AS error,
  CASE WHEN etype = 'ResourceAccess' THEN 'db-' || k END AS uri, CASE WHEN etype IN ('ToolCall', 'ResourceAccess') AND pol THEN 'event:gw:' || subject || '/' || id || '#policy' END AS authorization_ref,
  CASE WHEN etype = 'DelegationIssued' THEN '[{"id":"h' || (k % 7) || '","kind":"human","role":"owner"},{"id":"s","kind":"service"}]' END AS chain, CASE WHEN etype = 'DelegationIssued' THEN '2030' END AS expires, CASE WHEN etype = 'DelegationIssued' THEN '["a","b"]' END AS scope, CASE WHEN etype = 'DelegationIssued' AND k % 2 = 0 THEN 'verified' END AS status FROM e"""
)
def gateway_payloads(spark, d):
    """Each gateway event with the members of its payload, or why a line gives none."""
    ev = lg.gateway_events(log_lines(spark, d), "me", "enforcement_point")
    m = lambda path, name: F.get_json_object("data", f"$.{path}").alias(name)
    return ev.select(
        "id", "etype", "time", "reason", m("engine", "engine"), m("decision", "decision"), m("reasons", "reasons"), m("refs.request", "request"), m("tool.name", "tool"), m("args_ref", "args_ref"), m("result_ref", "result_ref"), m("effect_class", "effect_class"), m("error", "error"),
        m("resource.uri", "uri"), m("refs.authorization", "authorization_ref"), m("chain", "chain"), m("expires", "expires"), m("scope_granted", "scope"), m("verification.status", "status"),
    )


@query(
    with_(sql.EV)
    + """ SELECT CASE WHEN k % 9 > 0 THEN 'id:' || id END AS id, CASE WHEN k % 9 > 0 THEN 'DelegationIssued' END AS etype, time, 'jwt' || CASE WHEN k % 2 = 0 THEN ':2' ELSE '' END AS convention, 'urn:identity:idp' AS source, CASE WHEN k % 9 = 0 THEN 'missing_member' END AS reason,
  CASE WHEN k % 9 > 0 THEN '[{"id":"h' || (k % 7) || '","kind":"human","role":"owner"},{"id":"s","kind":"service"}]' END AS chain, CASE WHEN k % 9 > 0 THEN '["u1"]' END AS acted_for, CASE WHEN k % 9 > 0 THEN '2030' END AS expires, CASE WHEN k % 9 > 0 THEN '["a","b"]' END AS scope FROM ev"""
)
def identity_payloads(spark, d):
    """Each delegation of the identity log with its chain, scope and expiry, or why a line gives none."""
    ev = lg.identity_events(log_lines(spark, d).select(F.col("identity").alias("line")), "me", "independent_system")
    m = lambda path, name: F.get_json_object("data", f"$.{path}").alias(name)
    return ev.select("id", "etype", "time", "convention", "source", "reason", m("chain", "chain"), m("acted_for", "acted_for"), m("expires", "expires"), m("scope_granted", "scope"))


@query(
    with_(sql.EV)
    + """, o AS (SELECT id, k, time, CASE k % 7 WHEN 0 THEN 'ApprovalRequested' WHEN 1 THEN 'ApprovalDecided' WHEN 2 THEN 'Override' WHEN 3 THEN 'Interrupt' WHEN 4 THEN 'Notice' WHEN 5 THEN 'ApprovalDecided' END AS kind, k % 11 > 0 AND k % 12 > 0 AS known FROM ev),
r AS (SELECT *, CASE WHEN kind IS NULL THEN 'unknown_kind' WHEN kind IN ('ApprovalDecided', 'Override', 'Interrupt') AND NOT known OR kind = 'ApprovalDecided' AND k % 5 = 0 THEN 'incomplete_record' END AS reason FROM o),
e AS (SELECT *, CASE WHEN reason IS NULL THEN kind END AS etype FROM r)
SELECT CASE WHEN reason IS NULL THEN 'ov:' || id END AS id, etype, time, reason, CASE WHEN etype IN ('ApprovalDecided', 'Override', 'Interrupt') THEN 'human/owner/au' || (k % 4) END AS actor, CASE WHEN etype = 'ApprovalDecided' THEN 'ss' END AS session_ref,
  CASE WHEN etype = 'ApprovalDecided' AND k % 2 = 0 THEN 'approve' END AS outcome, CASE WHEN etype = 'ApprovalDecided' AND k % 3 > 0 THEN k::VARCHAR END AS latency_ms, CASE WHEN etype = 'ApprovalDecided' AND k % 4 > 0 THEN 'true' END AS viewed, CASE WHEN etype = 'Override' THEN 'was' END AS original,
  CASE WHEN etype = 'Interrupt' AND k % 2 = 0 THEN 'kill_switch' END AS mechanism, CASE WHEN etype = 'Notice' AND k % 2 = 1 THEN 'explanation' END AS notice_type, CASE WHEN etype IS NOT NULL THEN 'event:' || id END AS decision FROM e"""
)
def oversight_payloads(spark, d):
    """Each oversight event with its actor and the members of its payload, or why a line gives none."""
    k = F.col("k")
    s = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    kind = bd.chosen([(k % 7 == i, F.lit(x)) for i, x in enumerate(("approval_requested", "approval_decided", "override", "interrupt", "notice", "approval_decided"))], "gossip")
    actor = s('{"id": ', F.when(k % 11 == 0, "7").otherwise('"ann"'), ', "role": "owner"', F.when(k % 12 == 0, "").otherwise(s(', "authority_ref": "au', k % 4, '"')), "}")
    line = s(
        '{"timestamp": "', F.col("time"), '", "id": "', F.col("id"), '", "source_format": "desk", "kind": "', kind, '", "actor": ', actor, F.when(k % 5 == 0, "").otherwise(', "session_ref": "ss"'), ', "outcome": "', F.when(k % 2 == 0, "approve").otherwise("shrug"),
        '", "latency_ms": ', F.when(k % 3 == 0, '"7"').otherwise(k.cast("string")), ', "explanation_viewed": ', F.when(k % 4 == 0, '"yes"').otherwise("true"), ', "original": "was", "mechanism": "', F.when(k % 2 == 0, "kill_switch").otherwise("wish"), '", "notice_type": "', F.when(k % 2 == 1, "explanation").otherwise("rumour"), '", "refs": {"decision": "event:', F.col("id"), '"}}',
    )
    ev = lg.oversight_events(bd.evidence(spark, d).select(line.alias("line")), "me", "independent_system")
    m = lambda path, name: F.get_json_object("data", f"$.{path}").alias(name)
    actor = F.when(F.get_json_object("data", "$.actor").isNotNull(), F.concat_ws("/", *[F.get_json_object("data", f"$.actor.{x}") for x in ("kind", "role", "authority_ref")])).alias("actor")
    return ev.select("id", "etype", "time", "reason", actor, *[m(x, x) for x in ("session_ref", "outcome", "latency_ms")], m("explanation_viewed", "viewed"), *[m(x, x) for x in ("original", "mechanism", "notice_type")], m("refs.decision", "decision"))
