"""Spans of both conventions: attributes of several kinds, reasons, and payloads that can be assessed."""

import json

from proofmill.sources import payload, spans


def document(attributes, scope=None, **span):
    own = [{"key": k, "value": v} for k, v in attributes]
    return json.dumps({"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "svc"}}]}, "scopeSpans": [{"scope": scope or {}, "spans": [{"traceId": "t", "spanId": "s", "startTimeUnixNano": "1700000000123999999", "attributes": own, **span}]}]}]})


def events(spark, *docs):
    return spans.span_events(spans.spans_of(spark.createDataFrame([(d,) for d in docs], "doc string")), "me", "self_report")


def test_attributes(spark):
    """The last of equal keys holds, digits as text count as a number, lists keep their texts, other kinds are missing."""
    got = events(
        spark,
        document([("gen_ai.operation.name", {"stringValue": "chat"}), ("gen_ai.operation.name", {"stringValue": "memory.read"}), ("gen_ai.memory.record.ids", {"arrayValue": {"values": [{"stringValue": "r1"}, {"intValue": "2"}, {"stringValue": "r3"}]}}), ("gen_ai.memory.trust_min", {"stringValue": "quarantined"})]),
        document([("openinference.span.kind", {"stringValue": "LLM"}), ("llm.token_count.prompt", {"stringValue": " 12 "}), ("llm.token_count.completion", {"boolValue": True}), ("gen_ai.agent.id", {"intValue": "7"}), ("gen_ai.response.model", {"stringValue": "v9"}), ("input.value", {"intValue": "1"})]),
    ).orderBy("etype").collect()
    assert [r["etype"] for r in got] == ["MemoryRead", "ModelCall"]
    assert got[0]["record_refs"] == ["r1", "r3"] and got[0]["trust_min"] == "quarantined" and got[0]["time"] == "2023-11-14T22:13:20.123Z" and got[0]["source"] == "urn:otel:svc"
    assert got[1]["usage"].asDict() == {"input_tokens": 12, "output_tokens": None} and got[1]["agent"] is None and got[1]["input_ref"] == "otel:t/s#input" and got[1]["model"]["version_or_digest"] == "v9"
    assert got[1]["convention"] == "openinference" and json.loads(got[1]["data"])["usage"] == {"input_tokens": 12}


def test_reasons(spark):
    op = lambda name: [("gen_ai.operation.name", {"stringValue": name})]
    got = events(spark, document([]), document(op("dance")), document(op("chat"), startTimeUnixNano="-5"), document(op("chat"), startTimeUnixNano="x", endTimeUnixNano="5"), document(op("invoke_agent"), status={"code": 2}), "no json", "{}").collect()
    assert sorted((str(r["etype"]), str(r["reason"])) for r in got) == [("ModelCall", "None"), ("None", "missing_operation"), ("None", "no_time"), ("None", "unrecognised_operation"), ("SessionEnd", "None"), ("SessionStart", "None")]
    end = next(r for r in got if r["etype"] == "SessionEnd")
    assert end["end_reason"] == "error" and end["id"] == "otel:t/s#session-end"


def test_spans_are_shredded(spark):
    """What the adapter gives can be assessed: its payload makes the evidence columns."""
    ev = events(spark, document([("gen_ai.operation.name", {"stringValue": "execute_tool"}), ("gen_ai.agent.id", {"stringValue": "bot"})], name="run it"))
    row = payload.shredded(ev.select("id", "etype", "subject", "source_class", "data"), payload.COLUMNS + "tool_name ToolCall tool.name text\n").first()
    assert (row["id"], row["etype"], row["agent"], row["tool_name"]) == ("event:otel:t/s", "ToolCall", "bot", "run it")


def test_logs_type_principals(spark):
    """A delegation of the identity log types the principals of the gateway's calls; odd lines have their reasons."""
    from proofmill.sources import logs

    own = {"timestamp": "t", "trace_id": "t", "span_id": "s", "format": "jwt", "token_ref": "k", "chain": [{"id": "ann", "kind": "human"}, {"id": "r", "kind": "robot"}, "x"], "verification": {"status": "verified"}}
    call = {"timestamp": "t", "trace_id": "t", "span_id": "s", "gateway": "g", "acted_for": ["ann"], "request": {"method": "tools/call"}}
    frame = lambda *rows: spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in rows], "line string")
    first = logs.identity_events(frame(own, {**own, "span_id": 5}, "[]", "{"), "me", "independent_system")
    assert sorted(str(r["reason"]) for r in first.collect()) == ["None", "malformed", "missing_member", "not_an_object"]
    second = logs.gateway_events(frame(call, {**call, "request": {}, "policy": {}}, {**call, "span_id": "u", "policy": {"decision": "deny"}}), "me", "enforcement_point")
    assert sorted((str(r["id"]), str(r["reason"])) for r in second.collect()) == [("None", "nothing_to_report"), ("gw:t/s", "None"), ("gw:t/u#policy", "None")]
    ev = payload.shredded(first.union(second).where("reason is null").select("id", "etype", "subject", "source_class", "data"))
    assert {(r["principal"], r["class"]) for r in payload.principal_classes(ev).collect()} == {("ann", "HumanPrincipal"), ("ann", "Principal"), ("ann", "Agent")}
    assert {r["id"]: r["verification_status"] for r in ev.where("etype = 'DelegationIssued'").collect()} == {"event:id:t/s": "verified"}


def test_members_of_log_lines_are_read_once(spark):
    """Each member is read from the parsed line in one place of the plan, however many columns it makes; odd values count as missing."""
    from proofmill.sources import logs

    line = {"timestamp": "t", "trace_id": "1", "span_id": "2", "gateway": "g", "request": {"method": "tools/call", "params": {"name": ""}}, "policy": {"decision": 7, "reasons": ["", 5]}, "delegation": []}
    lines = spark.createDataFrame([(json.dumps(line),), ("[1]",), ("{",)], "line string")
    got = logs.gateway_events(lines, "me", "enforcement_point")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("$.trace_id") == plan.count("$.policy.decision") == 1
    rows = got.collect()
    assert sorted((r.etype or "", r.reason or "") for r in rows) == [("", "malformed"), ("", "not_an_object"), ("PolicyDecision", ""), ("ToolCall", "")]
    data = {r.etype: json.loads(r.data) for r in rows if r.etype}
    assert data["PolicyDecision"] == {"@type": "PolicyDecision", "refs": {"request": "event:gw:1/2"}} and data["ToolCall"]["tool"] == {"name": "unknown", "protocol": "mcp"}
