"""Trace spans of two conventions to events with their whole payloads.

A span's convention follows from its own attributes, its scope and the schema addresses; it decides
where the operation is read.  The operation decides the event type and which attributes make the
payload, each looked up under all the names that versions of the conventions give it.  Content is
never copied: a payload names where in the span it stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nanoseconds_to_time, once

_PLAIN = "stringValue:string,intValue:string,boolValue:boolean,doubleValue:double"
_PAIRS = f"array<struct<key:string,value:struct<{_PLAIN},arrayValue:struct<values:array<struct<stringValue:string>>>>>>"
_SPAN = f"traceId:string,spanId:string,parentSpanId:string,name:string,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_PAIRS},status:struct<code:int,message:string>"
DOCUMENT = f"resourceSpans array<struct<resource:struct<attributes:{_PAIRS}>,schemaUrl:string,scopeSpans:array<struct<scope:struct<name:string,version:string>,schemaUrl:string,spans:array<struct<{_SPAN}>>>>>>"
_MAP = "map<string,struct<text:string,number:bigint,texts:array<string>>>"

#: Event types by operation, and the operation of each span kind of the second convention.
OPERATIONS = {
    **dict.fromkeys(("chat", "text_completion", "generate_content", "embeddings"), "ModelCall"),
    "execute_tool": "ToolCall",
    **dict.fromkeys(("retrieve", "retrieval"), "ResourceAccess"),
    "memory.write": "MemoryWrite",
    "memory.read": "MemoryRead",
    **dict.fromkeys(("invoke_agent", "invoke_workflow"), "SessionStart"),
}
KINDS = {"LLM": "chat", "EMBEDDING": "embeddings", "TOOL": "execute_tool", "AGENT": "invoke_agent", "RETRIEVER": "retrieve"}
PROTOCOLS, TRUST = ["mcp", "a2a", "http", "native"], ["trusted", "untrusted", "quarantined"]
#: Names of attributes, the first that is present holds.
NAMES = {
    "agent": ("gen_ai.agent.id",),
    "agent_name": ("gen_ai.agent.name",),
    "session": ("gen_ai.conversation.id", "session.id"),
    "provider": ("gen_ai.system", "gen_ai.provider.name", "llm.provider"),
    "model": ("gen_ai.request.model", "llm.model_name"),
    "resolved": ("gen_ai.response.model",),
    "input_tokens": ("gen_ai.usage.input_tokens", "gen_ai.usage.prompt_tokens", "llm.token_count.prompt"),
    "output_tokens": ("gen_ai.usage.output_tokens", "gen_ai.usage.completion_tokens", "llm.token_count.completion"),
    "input": ("gen_ai.input.messages", "gen_ai.prompt", "input.value"),
    "output": ("gen_ai.output.messages", "gen_ai.completion", "output.value"),
    "tool": ("gen_ai.tool.name", "tool.name"),
    "server": ("gen_ai.tool.server", "server.address"),
    "protocol": ("gen_ai.tool.protocol",),
    "args": ("gen_ai.tool.call.arguments", "tool.parameters", "input.value"),
    "result": ("gen_ai.tool.call.result", "output.value"),
    "uri": ("gen_ai.data_source.id", "retrieval.source", "db.collection.name"),
    "uri_kind": ("gen_ai.data_source.kind",),
    "count": ("gen_ai.retrieval.document.count", "retrieval.documents.count"),
    "store": ("gen_ai.memory.store",),
    "record": ("gen_ai.memory.record.id",),
    "records": ("gen_ai.memory.record.ids",),
    "trust": ("gen_ai.memory.trust",),
    "trust_min": ("gen_ai.memory.trust_min",),
    "environment": ("deployment.environment.name", "deployment.environment"),
    "task": ("a2a.task.id", "gen_ai.task.id"),
    "service": ("service.name",),
}


def typed_attributes(pairs: Column) -> Column:
    """Attributes by key with the value as a text, a whole number and a list of texts, each null where it
    is none; a text of digits counts as a number.  The last of equal keys holds."""
    pairs = F.filter(F.coalesce(pairs, F.array().cast(_PAIRS)), lambda a: a["key"].isNotNull())
    last = F.filter(pairs, lambda a, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda b: b["key"] == a["key"]))
    number = lambda v: F.coalesce(v["intValue"], F.when(v["stringValue"].rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(v["stringValue"]))).try_cast("bigint")
    texts = lambda v: F.array_compact(F.transform(v["arrayValue"]["values"], lambda x: x["stringValue"]))
    entry = lambda a: F.struct(a["key"], F.struct(F.nullif(a["value"]["stringValue"], F.lit("")).alias("text"), number(a["value"]).alias("number"), texts(a["value"]).alias("texts")))
    return F.map_from_entries(F.transform(last, entry))


def version_of(*addresses: Column) -> Column:
    """major.minor at the end of the first schema address that has one."""
    return F.coalesce(*[F.nullif(F.regexp_extract(a, r"(?:^|/)([0-9]+\.[0-9]+)(?:\.[^/]*)?/*$", 1), F.lit("")) for a in addresses])


def spans_of(documents: DataFrame) -> DataFrame:
    """Span documents (``doc`` JSON text) to one row a span, its attributes over the resource's, with its convention."""
    one = documents.select(F.explode(F.from_json("doc", DOCUMENT)["resourceSpans"]).alias("r"))
    two = one.select(F.col("r.schemaUrl").alias("outer"), F.col("r.resource.attributes").alias("shared"), F.explode("r.scopeSpans").alias("s"))
    three = two.select("outer", "shared", F.col("s.scope").alias("scope"), F.col("s.schemaUrl").alias("inner"), F.explode("s.spans").alias("x"))
    none = F.array().cast(_PAIRS)
    own = F.coalesce(F.col("x.attributes"), none)
    second = F.exists(own, lambda a: a["key"] == "openinference.span.kind") | F.coalesce(F.col("scope.name").startswith("openinference"), F.lit(False))
    release = F.nullif(F.col("scope.version"), F.lit(""))
    convention = F.when(second, F.concat_ws(":", F.lit("openinference"), release)).otherwise(F.concat_ws(":", F.lit("genai"), version_of(F.col("inner"), F.col("outer"))))
    time = lambda c: nanoseconds_to_time(F.col(f"x.{c}").try_cast("long"))
    return three.select(
        F.coalesce("x.traceId", F.lit("")).alias("trace_id"), F.coalesce("x.spanId", F.lit("")).alias("span_id"), F.nullif(F.col("x.parentSpanId"), F.lit("")).alias("parent_id"), F.coalesce("x.name", F.lit("")).alias("name"),
        time("startTimeUnixNano").alias("start"), time("endTimeUnixNano").alias("end"), F.col("x.status").alias("status"), convention.alias("convention"), once(typed_attributes(F.concat(F.coalesce("shared", none), own))).alias("a"),
    )


def some(*members: Column) -> Column:
    """A struct of named members, or null where all are."""
    return F.when(F.exists(F.array(*[m.isNotNull() for m in members]), lambda there: there), F.struct(*members))


def span_events(spans: DataFrame, subject: str, source_class: str, source: str | None = None) -> DataFrame:
    """Events of ``spans_of`` rows: envelope columns, the payload's members as typed columns, the payload
    as JSON text in ``data``, and ``reason``.

    A session span gives its start and its end; a span without a start uses its end.  A row with a
    reason (missing_operation, unrecognised_operation, no_time) is a span that gives no event.
    """
    a = F.col("a")
    text = lambda k: F.coalesce(*[a[n]["text"] for n in NAMES[k]])
    number = lambda k: F.coalesce(*[a[n]["number"] for n in NAMES[k]])
    present = lambda k: F.array_contains(F.map_keys(a), NAMES[k][0]) if len(NAMES[k]) == 1 else F.arrays_overlap(F.map_keys(a), F.array(*map(F.lit, NAMES[k])))
    one_of = lambda k, allowed: F.when(text(k).isin(allowed), text(k))
    kind = a["openinference.span.kind"]["text"]
    mapped = F.coalesce(*[F.when(kind == k, op) for k, op in KINDS.items()], kind)
    operation = F.when(F.col("convention").startswith("openinference"), mapped).otherwise(a["gen_ai.operation.name"]["text"])
    etype = F.coalesce(*[F.when(operation == k, v) for k, v in OPERATIONS.items()])
    base = F.concat(F.lit("otel:"), F.col("trace_id"), F.lit("/"), F.col("span_id"))
    at, until = F.coalesce("start", "end"), F.coalesce("end", "start")
    event = lambda t, ident, time: F.struct(t.alias("etype"), ident.alias("id"), time.alias("time"))
    both = F.array(event(F.lit("SessionStart"), F.concat(base, F.lit("#session-start")), at), event(F.lit("SessionEnd"), F.concat(base, F.lit("#session-end")), until))
    reason = F.when(operation.isNull(), "missing_operation").when(etype.isNull(), "unrecognised_operation").when(at.isNull(), "no_time")
    nothing = F.lit(None).cast("string")
    events = F.when(reason.isNotNull(), F.array(event(nothing, nothing, nothing))).when(etype == "SessionStart", both).otherwise(F.array(event(etype, base, at)))
    rows = spans.select("*", operation.alias("operation"), reason.alias("reason"), F.explode(events).alias("e"))
    when = lambda t, c: F.when(F.col("e.etype").isin(t.split()), c)
    place = lambda t, k, name: when(t, F.when(present(k), F.concat(base, F.lit(f"#{name}"))))
    failed = F.col("status.code") == 2
    call = "ModelCall ToolCall"
    members = {
        "agent": F.when(text("agent").isNotNull(), F.struct(text("agent").alias("id"), text("agent_name").alias("name"))),
        "session_id": text("session"),
        "operation": F.coalesce(when("ModelCall", F.when(F.col("operation") == "embeddings", "embeddings").otherwise("chat")), when("ResourceAccess", F.lit("read"))),
        "model": when("ModelCall", some(text("provider").alias("provider"), text("model").alias("name"), text("resolved").alias("version_or_digest"))),
        "usage": when("ModelCall", some(number("input_tokens").alias("input_tokens"), number("output_tokens").alias("output_tokens"))),
        "input_ref": place("ModelCall", "input", "input"),
        "output_ref": place("ModelCall", "output", "output"),
        "tool": when("ToolCall", F.struct(F.coalesce(text("tool"), "name").alias("name"), text("server").alias("server"), one_of("protocol", PROTOCOLS).alias("protocol"))),
        "args_ref": place("ToolCall", "args", "args"),
        "result_ref": place("ToolCall", "result", "result"),
        "error": when(call, F.when(failed, F.coalesce(F.nullif(F.col("status.message"), F.lit("")), F.lit("error")))),
        "resource": when("ResourceAccess", F.struct(F.coalesce(text("uri"), "name").alias("uri"), text("uri_kind").alias("kind"))),
        "count": when("ResourceAccess", number("count")),
        "store": when("MemoryWrite MemoryRead", text("store")),
        "record_ref": when("MemoryWrite", text("record")),
        "record_refs": when("MemoryRead", F.when(F.size(a[NAMES["records"][0]]["texts"]) > 0, a[NAMES["records"][0]]["texts"])),
        "trust": when("MemoryWrite", one_of("trust", TRUST)),
        "trust_min": when("MemoryRead", one_of("trust_min", TRUST)),
        "environment": when("SessionStart", text("environment")),
        "end_reason": when("SessionEnd", F.when(failed, "error").otherwise("completed")),
    }
    own = F.lit(source) if source else F.concat(F.lit("urn:otel:"), F.coalesce(text("service"), F.lit("unknown")))
    envelope = ["id", "source", "subject", "time", "etype", "source_class", "convention", "trace_id", "span_id", "parent_id", "task", "reason"]
    about = [F.col("e.id").alias("id"), own.alias("source"), F.lit(subject).alias("subject"), F.col("e.time").alias("time"), F.col("e.etype").alias("etype"), F.lit(source_class).alias("source_class"), "convention", "trace_id", "span_id", "parent_id", text("task").alias("task"), "reason"]
    named = F.struct(F.col("e.etype").alias("@type"), *[c.alias(name) for name, c in members.items()])
    out = rows.select(*about, once(F.when(F.col("reason").isNull(), named)).alias("p"))
    return out.select(*envelope, *[F.col(f"p.{m}").alias(m) for m in members], F.to_json("p").alias("data"))
