"""Operators on tiny frames, with results worked out by hand."""

import hashlib
import hmac
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from proofmill import functions as fn, plans
from proofmill.operators import assess, catalog, coverage, governance, ingest, integrity, loading, metrics, narrative, reports, rules, schema, state, summary
from proofmill.operators import facts as fx
from proofmill.sources import adapters, binding, bundle

HASH = lambda s: hashlib.sha256(s.encode()).hexdigest()


def chain(spark, names, **fault):
    rows, back = [], integrity.GENESIS
    for i, n in enumerate(names):
        content = HASH(n)
        stored = HASH("other") if fault.get("tampered") == i else content
        prev = HASH("lost") if fault.get("gap") == i else back
        rows.append(("s", n, i, f"2024-01-01T00:00:0{i}.000Z", content, stored, prev))
        back = stored
    return spark.createDataFrame(rows, "stream string, id string, ordinal long, time string, content_hash string, hash string, prev string")


@pytest.mark.parametrize("fault,status,first", [({}, "verified_weak", None), ({"tampered": 1}, "failed", 1), ({"gap": 2}, "gap", 2)])
def test_chain(spark, fault, status, first):
    r = integrity.stream_status(chain(spark, ["a", "b", "c"], **fault)).first()
    assert (r.status, r.first_bad_index, r.n_events) == (status, first, 3)


def test_chain_reordered_late_signed(spark):
    rows = chain(spark, ["a", "b", "c"])
    swapped = rows.withColumn("ordinal", F.when(F.col("id") == "b", 2).when(F.col("id") == "c", 1).otherwise(0))
    assert integrity.stream_status(swapped).first().status == "reordered"
    anchors = spark.createDataFrame([("s", "2024-01-01T00:00:01.000Z")], "stream string, anchor_time string")
    late = integrity.stream_status(rows, anchors).first()
    assert (late.status, late.first_bad_index) == ("time_suspect", 2)
    signed = rows.withColumn("strength", F.lit("source_signed")).withColumn("signed", F.col("id") != "b")
    assert integrity.stream_status(signed).first().status == "unsigned"
    assert integrity.stream_status(rows.limit(0)).count() == 0


def test_chain_rows_are_made_once(spark):
    """The status reads its rows once, so that a content hash, dear to make, is made once a row."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def content(x):
        made.add(1)
        return x

    rows = chain(spark, ["a", "b", "c"]).withColumn("content_hash", content("content_hash"))
    assert integrity.stream_status(rows).first().status == "verified_weak"
    assert made.value == 3


def test_chain_over_many_blocks(spark, monkeypatch):
    """Status and first bad index where a stream spans blocks, against one pass in order."""
    monkeypatch.setattr(integrity, "BLOCK", 3)
    r = random.Random(5)
    rows, want = [], {}
    for s in range(40):
        back, seen, links = integrity.GENESIS, [], []
        for i in range(r.randint(1, 11)):
            stored = HASH(f"{s}/{i}")
            prev = back if r.random() > 0.1 else r.choice([HASH("lost"), integrity.GENESIS, None, *seen[:-1]])
            broken = r.random() < 0.03
            rows.append((f"s{s}", str(i), 2 * i + s % 2, "t", HASH("x") if broken else stored, stored, prev))
            links.append((i, broken, prev != back, prev not in (None, integrity.GENESIS) and prev))
            seen.append(stored)
            back = stored
        f = next((i for i, broken, _, _ in links if broken), None)
        l, prev = next(((i, p) for i, _, unlinked, p in links if unlinked), (None, None))
        status = "failed" if f is not None else "verified_weak" if l is None else "gap" if prev and prev not in seen else "reordered"
        want[f"s{s}"] = (status, l if f is None else f, len(links))
    frame = spark.createDataFrame(rows, "stream string, id string, ordinal long, time string, content_hash string, hash string, prev string")
    assert {x.stream: (x.status, x.first_bad_index, x.n_events) for x in integrity.stream_status(frame).collect()} == want
    assert {w[0] for w in want.values()} == {"failed", "gap", "reordered", "verified_weak"}


def feed(spark, rows):
    return spark.createDataFrame([(i, s, "x", o, "Decision", "c", t) for i, s, o, t in rows], "id string, source string, subject string, ordinal long, etype string, source_class string, time string")


def test_duplicate_does_not_raise_time(spark):
    got = ingest.ingest(feed(spark, [("a", "s", 0, "1"), ("a", "s", 1, "9"), ("b", "s", 2, "2")])).collect()
    assert {(r.id, r.ordinal): r.reason for r in got} == {("a", 0): None, ("a", 1): "duplicate_id", ("b", 2): None}


def test_many_copies_of_one_id(spark, monkeypatch):
    """Any number of late copies, blocks smaller than a source, against one pass in order."""
    monkeypatch.setattr(ingest, "BLOCK", 4)
    rows = [("x", "s", 0, "5"), *[("a", "s", i, "3") for i in range(1, 15)], ("a", "s", 15, "6"), ("b", "s", 16, "5"), ("a", "s", 17, "9"), ("b", "t", 18, "1"), ("c", "t", 19, "0"), ("c", "s", 20, "1")]
    want, taken, last = {}, set(), {}
    for i, s, o, t in rows:
        want[o] = "duplicate_id" if i in taken else "time_order" if t < last.get(s, "") else None
        if want[o] is None:
            taken.add(i)
            last[s] = t
    assert {r.ordinal: r.reason for r in ingest.ingest(feed(spark, rows)).collect()} == want
    assert want[14] == "time_order" and want[15] is None and want[17] == "duplicate_id"


def test_copy_of_a_late_event_gets_a_chance(spark):
    got = ingest.ingest(feed(spark, [("x", "s", 0, "5"), ("a", "s", 1, "3"), ("a", "s", 2, "6")])).collect()
    assert {(r.id, r.ordinal): r.reason for r in got} == {("x", 0): None, ("a", 1): "time_order", ("a", 2): None}


def test_row_reasons(spark):
    rows = feed(spark, [("a", "s", 0, "1"), ("b", "t", 1, "1"), (None, "s", 2, "1")]).union(feed(spark, [("h", "s", 3, "1")]).withColumn("etype", F.lit("Heartbeat")))
    sources = spark.createDataFrame([("s", "c")], "source string, declared_class string")
    got = {r.ordinal: r.reason for r in ingest.ingest(rows, sources).collect()}
    assert got == {0: None, 1: "unknown_source", 2: "schema_invalid", 3: "unknown_type"}


def test_parse_lines(spark):
    good = json.dumps({"id": "1", "source": "s", "subject": "x", "time": "t", "type": "org.demo.evidence.Decision.v1", "data": {"k": 1}})
    rows = spark.createDataFrame([("f", 0, good), ("f", 1, "{"), ("f", 2, "[1]"), ("f", 3, "  ")], "file string, ordinal long, line string")
    got = {r.ordinal: (r.parse_reason, r.etype) for r in ingest.parse_lines(rows).collect()}
    assert got == {0: (None, "Decision"), 1: ("schema_invalid", None), 2: ("schema_invalid", None)}


def test_quantile_is_nearest_rank(spark):
    rows = spark.range(1, 101).withColumnRenamed("id", "v").withColumn("g", F.lit("x"))
    for q, want in (((7, 100), 7), ((55, 100), 55), ((56, 100), 56), ((1, 1), 100), ((0, 1), 1)):
        assert metrics.by_rank(rows, ["g"], "v", *q).first().numerator == want


def test_half_even(spark):
    rows = spark.createDataFrame([(1, 20000), (3, 20000), (1, 3), (5, 0)], "a long, b long")
    got = [r[0] for r in rows.select(fn.half_even_ratio(F.col("a"), F.col("b"))).collect()]
    assert got == ["0.0000", "0.0002", "0.3333", None]


def test_interval():
    assert fn.clopper_pearson(0, 10) == ("0.0000", "0.3085")
    assert fn.clopper_pearson(10, 10) == ("0.6915", "1.0000")
    assert fn.clopper_pearson(1, 1) == ("0.0250", "1.0000")
    assert fn.clopper_pearson(2, 10) == ("0.0252", "0.5561")
    for k, n in [(0, 1), (3, 7), (50, 100), (199, 200), (1, 1500), (700, 1500)]:
        assert fn.exact_interval(k, n) == fn.decimal_interval(k, n)
    assert fn.exact_interval(0, 0) == ("0.0000", "1.0000")


def test_interval_of_many_trials():
    import time

    began = time.process_time()
    for n in (300_000, 40_000_000):
        for k in (7, n // 3, n // 2, n - 1):
            low, high = (float(x) for x in fn.decimal_interval(k, n))
            p = k / n
            assert low - 5e-5 <= p <= high + 5e-5
            if k == n // 3 or k == n // 2:  # so many trials are normal
                step = 1.959964 * (p * (1 - p) / n) ** 0.5
                assert abs(low - (p - step)) < 6e-5 and abs(high - (p + step)) < 6e-5
    assert fn.decimal_interval(0, 300_000) == ("0.0000", "0.0000")
    assert time.process_time() - began < 60
    for k, n in [(1, 2001), (1000, 2001), (1999, 2001), (299, 2300), (301, 2600)]:
        assert fn.decimal_interval(k, n) == fn.exact_interval(k, n)


def test_pseudonym_and_sql_functions(spark):
    fn.register(spark)
    want = "principal:" + hmac.new(bytes(32), "ä-1".encode(), hashlib.sha256).hexdigest()
    one = spark.createDataFrame([("ä-1",)], "id string")
    assert one.select(fn.pseudonym(F.col("id"))).first()[0] == want
    assert one.selectExpr("principal_pseudonym(id)").first()[0] == want
    assert spark.sql("SELECT clopper_pearson(2, 10).high AS h").first().h == "0.5561"


@pytest.mark.parametrize("value,text", [({"b": 1, "a": [True, None, "é"]}, '{"a":[true,null,"é"],"b":1}'), ({"\U00010000": 1, "￿": 2}, '{"𐀀":1,"￿":2}')])
def test_canonical(value, text):
    assert fn.canonical(value) == text


@pytest.mark.parametrize("line", ["1.0", '{"a":1.0}', '{"a":9007199254740992}', '{"a":NaN}', '{"a":1,"a":2}', "x", None])
def test_canonical_refuses(line):
    assert fn.content_hash(line)[0] is None and fn.content_hash(line)[1]


def test_closure(spark):
    up = spark.createDataFrame([("a", "b"), ("b", "c")], "child string, parent string")
    got = {tuple(r) for r in fx.class_closure(up).collect()}
    assert got == {("a", "a"), ("b", "b"), ("c", "c"), ("a", "b"), ("b", "c"), ("a", "c")}
    with pytest.raises(ValueError):
        fx.class_closure(up.union(spark.createDataFrame([("c", "a")], up.schema)), depth=4)


def test_verification_status_of_a_chain(spark):
    """The status of a verification counts where a delegation says nothing itself."""
    d = "/root/testdata/sf0.001"
    ev = binding.evidence(spark, d).withColumn("verification_status", F.when(F.col("k") % 2 == 0, "verified").otherwise("failed")).withColumn("chain_verified", F.when(F.col("k") % 3 == 0, False))
    got = fx.facts(ev, binding.domain(spark), binding.principals(ev)).where("target = 'DelegationIssued'").join(ev.select("subject", "id", "k"), ["subject", "id"]).collect()
    assert got and all(r["chain_verified"] == (r["k"] % 3 != 0 and r["k"] % 2 == 0) for r in got)


def test_drift_and_state(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame([("s", "k", c, o) for c, o in x], "subject string, catalog string, control string, outcome string")
    old, new = rows(("A-1", "conformant"), ("B-1", "conformant")), rows(("A-1", "non-conformant"), ("C-1", "conformant"))
    assert [(r.control, r.previous, r.outcome) for r in summary.drift(old, new).collect()] == [("A-1", "conformant", "non-conformant")]
    state.write_state(state.merged(old, new), str(tmp_path / "s"))
    back = {r.control: r.outcome for r in state.read_state(spark, str(tmp_path / "s")).collect()}
    assert back == {"A-1": "non-conformant", "B-1": "conformant", "C-1": "conformant"}
    state.write_state(new, str(tmp_path / "s"), 1)
    assert state.read_state(spark, str(tmp_path / "s")).count() == 2 and state.read_state(spark, str(tmp_path / "s"), 0).count() == 3
    new.withColumn("version", F.lit(9)).write.parquet(str(tmp_path / "s/outcomes/run=2"))
    with pytest.raises(ValueError):
        state.read_state(spark, str(tmp_path / "s"))
    runs = spark.createDataFrame([(1, "d1", "r1")], "run long, input_digest string, report_digest string")
    assert state.supersedes(runs, "d2") == "r1" and state.supersedes(runs, "d1") is None


def lines(spark, *rows):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in rows], "line string")


def test_gateway(spark):
    base = {"timestamp": "t", "trace_id": "1", "span_id": "2", "gateway": "g", "request": {"method": "tools/call", "params": {"name": "x"}}}
    got = adapters.gateway_to_events(lines(spark, {**base, "policy": {"decision": "deny"}}, {**base, "policy": {"decision": "allow"}}, {"timestamp": "t"}, "{")).collect()
    kinds = sorted((r.etype or r.reason, r.detail) for r in got if r.etype) + sorted((r.reason,) for r in got if r.reason)
    assert kinds == [("PolicyDecision", "allow"), ("PolicyDecision", "deny"), ("ToolCall", "x"), ("malformed",), ("missing_member",)]


def test_other_adapters(spark):
    got = adapters.identity_to_events(lines(spark, {"token_ref": "r", "timestamp": "t", "chain": [{"id": "a", "kind": "human"}, {"id": "b", "kind": "?"}]}, {"timestamp": "t"})).collect()
    assert sorted((r.etype, r.detail, r.reason) for r in got if r.etype) == [("DelegationIssued", "a", None)] and [r.reason for r in got if r.reason] == ["missing_member"]
    got = adapters.oversight_to_events(lines(spark, {"timestamp": "t", "id": "1", "source_format": "f", "kind": "override"}, {"timestamp": "t", "id": "2", "source_format": "f", "kind": "outcome"})).collect()
    assert sorted((r.etype or "", r.reason or "") for r in got) == [("", "unattributed"), ("Outcome", "")]
    got = adapters.policy_to_events(lines(spark, {"timestamp": "t", "allowed": False, "tuple_key": {"user": "u"}}, {"timestamp": "t", "result": "PERMIT"}, {"timestamp": "t", "result": "?"})).collect()
    assert sorted((r.etype or "", r.detail or "", r.reason or "") for r in got) == [("", "", "unknown_decision"), ("AuthzCheck", "deny", ""), ("PolicyDecision", "allow", "")]
    rows = [{"timestamp": "t", "kind": "attestation", "signature": {"key_id": k} if k else {}, "subject_digests": ["a", "b"], "observed_digests": o} for k, o in (("k", ["b", "a"]), ("k", ["a"]), ("z", ["a", "b"]), (None, []))]
    got = adapters.supply_to_events(lines(spark, *rows), ["k"]).collect()
    assert sorted(r.detail for r in got) == ["failed", "failed", "unverified", "verified"]
    assert {r.reason: r.rows for r in adapters.report(adapters.supply_to_events(lines(spark, "x"), [])).collect()} == {"malformed": 1}


def test_bundle(spark, tmp_path):
    p = tmp_path / "b"
    (p / "events").mkdir(parents=True)
    (p / "events" / "a.jsonl").write_text("x\n\nyy\n")
    found = bundle.file_digests(spark, str(p)).cache()
    digest = hashlib.sha256(b"x\n\nyy\n").hexdigest()
    want = spark.createDataFrame([("events/a.jsonl", "sha256:" + digest.upper()), ("events/b.jsonl", "0")], "path string, sha256 string")
    assert [tuple(r) for r in bundle.verify_files(found, want).collect()] == [("events/b.jsonl", "missing")]
    assert bundle.dataset_digest(found) == HASH(f"events/a.jsonl {digest}")
    assert [(r.ordinal, r.line) for r in bundle.scan_lines(spark, str(p / "events")).orderBy("ordinal").collect()] == [(0, "x"), (2, "yy")]


def test_deviations(spark):
    dev = spark.createDataFrame([(1, "INT-01", "r", "m", "a", "a", "2024-01-01", "2025-01-01"), (2, "X-1", "r", "m", "a", "b", "2024-01-01", "2024-02-01")], "deviation_id long, control string, reason string, compensating_measure string, owner string, approver string, granted string, expiry string")
    known = spark.createDataFrame([("INT-01",)], "control string")
    out = spark.createDataFrame([("INT-01", "conformant")], "control string, outcome string")
    got = {(r.deviation_id, r.problem) for r in governance.deviation_lint(dev, known, out).collect()}
    assert got == {(1, "family cannot be deviated"), (1, "outcome is not non-conformant"), (1, "approver is the owner"), (1, "lifetime too long"), (2, "unknown control")}


def test_other_governance(spark):
    rec = spark.createDataFrame([("A-1", {"x": "1", "y": "2"})], "control string, digests map<string,string>")
    now = spark.createDataFrame([("x", "1")], "artifact string, digest string")
    assert [r.artifact for r in governance.stale_checklists(rec, now).collect()] == ["y"]
    src = spark.createDataFrame([("s", "a", "gateway", "enforcement_point", "j", None, 30)], "subject string, source string, kind string, class string, justification string, manifest string, window_days int")
    assert {r.problem for r in governance.profile_lint(src).collect()} == {"enforcement point without manifest", "window too short"}
    a = spark.createDataFrame([("k", "1"), ("k", "2")], "kind string, ref string")
    assert [tuple(r) for r in governance.set_differences(a, a.limit(0).union(a.where("ref = '1'"))).collect()] == [("k", "2", "declared")]


def test_probe_cases(spark):
    rows = spark.createDataFrame([("c", "hi", HASH("hi"), "me")], "case_id string, prompt string, prompt_sha256 string, signed_off_by string")
    assert metrics.checked_cases(rows).count() == 1
    with pytest.raises(ValueError):
        metrics.checked_cases(rows.withColumn("prompt", F.lit("ho")))


def test_gate_refuses_unknown_field(spark):
    with pytest.raises(ValueError):
        summary.gate(spark.createDataFrame([("a",)], "outcome string"), [[("text", "x")]])


def test_late_copies_in_any_order(spark):
    """The sequential rule on the five rows that a round-by-round reading loses, and on random feeds in two streams."""
    five = [("A", "s", 0, "10"), ("B", "s", 1, "05"), ("B", "s", 2, "20"), ("C", "s", 3, "15"), ("C", "s", 4, "25")]
    pick = random.Random(11)
    feeds = [five] + [[(f"{n}:{pick.choice('abcdef')}", f"{n}:{pick.choice('st')}", 100 * n + o, f"{pick.randint(0, 30):02}") for o in range(pick.randint(1, 14))] for n in range(1, 400)]
    want = {}
    for rows in feeds:
        taken, last = set(), {}
        for i, s, o, t in rows:
            want[o] = "duplicate_id" if i in taken else "time_order" if t < last.get(s, "") else None
            if want[o] is None:
                taken.add(i)
                last[s] = t
    got = ingest.ingest(feed(spark, [r for rows in feeds for r in rows])).collect()
    assert {r.ordinal: r.reason for r in got} == want and [want[o] for o in range(5)] == [None, "time_order", None, "time_order", None]


def test_streams_and_invalid_payloads(spark):
    rows = feed(spark, [("a", "s", 0, "5"), ("b", "s", 1, "3"), ("c", "s", 2, "1")]).withColumn("data", F.when(F.col("id") == "b", '{"integrity": {"stream": "other", "hash": "h", "prev": "p", "strength": "export_chained"}}').when(F.col("id") == "c", '{"agent": {}}').otherwise("{}"))
    got = ingest.ingest(schema.with_stream(schema.payload_errors(rows))).collect()
    assert {(r.id, r.stream): r.reason for r in got} == {("a", "s"): None, ("b", "other"): None, ("c", "s"): "schema_invalid"}


def test_class_mismatch(spark):
    sources = spark.createDataFrame([("s", "other"), ("t", None)], "source string, declared_class string")
    got = ingest.ingest(feed(spark, [("a", "s", 0, "1"), ("b", "t", 1, "1")]), sources).collect()
    assert {r.id: r.reason for r in got} == {"a": "class_mismatch", "b": None}


@pytest.mark.parametrize(
    "etype,data,error",
    [
        ("ToolCall", {"tool": {"name": "x", "protocol": "mcp"}, "effect_class": "read", "used": ["c"]}, None),
        ("ToolCall", {"effect_class": "fly"}, "effect_class has no allowed value"),
        ("ToolCall", {"tool": {"server": "x"}}, "tool.name is missing"),
        ("ToolCall", {"used": "c"}, "used is not of kind list"),
        ("Notice", {"effect_class": "fly"}, None),
        ("ApprovalDecided", {"latency_ms": 1.5}, "latency_ms is not of kind integer"),
        ("ApprovalDecided", {"latency_ms": True}, "latency_ms is not of kind integer"),
        ("Outcome", {"adverse": "no"}, "adverse is not of kind boolean"),
        ("Decision", [1], "payload is no object"),
        ("Decision", None, "payload is no object"),
    ],
)
def test_payload_rules(spark, etype, data, error):
    rows = spark.createDataFrame([(etype, None if data is None else json.dumps(data))], "etype string, data string")
    errors = schema.payload_errors(rows).first()["errors"]
    assert (errors[0] if errors else None) == error


def test_own_payload_rules_and_paths(spark):
    rows = spark.createDataFrame([("X", '{"a": {"b": "v"}}'), ("X", '{"a": 1}')], "etype string, data string")
    own = [{"etype": "X", "path": "a.b", "kind": "text", "allowed": ["v"], "required": True}]
    assert [r["errors"] for r in schema.payload_errors(rows, own).collect()] == [[], ["a.b is missing"]]
    assert [r["b"] for r in schema.projected(rows, {"b": "a.b"}).collect()] == ["v", None]


def test_controls_of_a_file(spark, tmp_path):
    one = {"catalog": "mine", "control": "X-1", "mode": "automated", "rung": 2, "severity": "high", "roles": ["deployer"], "checks": "Q01+Q02", "need": ["Decision:any", "Notice:independent_system"], "tolerance": {"kind": "ratio", "max": "0.1"}}
    (tmp_path / "c.json").write_text(json.dumps([one]))
    got = loading.read_controls(spark, str(tmp_path / "c.json")).first()
    assert got["need"] == ["Decision", "Notice:independent_system"] and got["tolerance"]["kind"] == "ratio"
    for change in ({"severity": "grave"}, {"checks": "Q99"}, {"roles": []}, {"control": None}, {"mode": "by hand"}):
        (tmp_path / "d.json").write_text(json.dumps([{**one, **change}]))
        with pytest.raises(ValueError):
            loading.read_controls(spark, str(tmp_path / "d.json"))
    (tmp_path / "e.json").write_text('{"id": "x:A", "consequential": true}\n{"id": "x:B", "subclass_of": "x:A"}\n')
    assert [tuple(r)[:3] for r in loading.read_domain(spark, str(tmp_path / "e.json")).orderBy("decision_type").collect()] == [("x:A", "Decision", True), ("x:B", "x:A", False)]


@pytest.mark.parametrize("kind,most,applicable,failed,within", [("count", "1", 10, 1, True), ("count", "1", 10, 2, False), ("ratio", "0.1", 30, 3, True), ("ratio", "0.1", 29, 3, False), ("ratio", "1.5", 0, 1, True), ("ratio", "0.5", 0, 1, False), (None, None, 3, 0, True), (None, None, 3, 1, False)])
def test_tolerances(spark, kind, most, applicable, failed, within):
    rows = spark.createDataFrame([((kind, most) if kind else None, applicable, failed)], "tolerance struct<kind:string,max:string>, applicable long, failed long")
    assert loading.with_tolerance(rows).first()["within"] == within


def test_profiles(spark):
    profile = spark.createDataFrame([("s", "2024-01-01T00:00:00Z", "2024-02-01T00:00:00Z", ""), ("t", None, None, "me"), ("u", "2024-01-01", "2024-12-31", "me")], "subject string, start string, end string, confirmed_by string")
    parts = spark.createDataFrame([("u", "bot", None), ("u", "aid", "mail")], "subject string, name string, task_scope string")
    got = {tuple(r) for r in loading.profile_problems(profile, parts).collect()}
    assert got == {("s", "window under 90 days"), ("s", "not confirmed"), ("t", "no observation window"), ("u", "bot: no task scope")}
    events = spark.createDataFrame([("t", "2"), ("t", "1")], "subject string, time string")
    got = {r.subject: (r.start, r.end) for r in loading.observation_window(events, profile.where("subject <> 's'")).collect()}
    assert got == {"t": ("1", "2"), "u": ("2024-01-01", "2024-12-31")}


def test_verdicts_must_cite(spark):
    rows = spark.createDataFrame([("s", "k", "A-1", "conformant", "Q01"), ("s", "k", "B-1", "not_assessed", None)], "subject string, catalog string, control string, outcome string, checks string")
    cited = spark.createDataFrame([("s", "Q01", "e1")], "subject string, checks string, focus string")
    assert assess.require_evidence(rows, cited).count() == 2
    with pytest.raises(ValueError, match="A-1"):
        assess.require_evidence(rows, cited.limit(0))


def test_signatures(spark):
    rows = chain(spark, ["a", "b"]).withColumn("sig_ref", F.when(F.col("id") == "a", "sig/a").otherwise("")).withColumn("strength", F.lit("source_signed"))
    files = spark.createDataFrame([("sig/b",)], "path string")
    assert sorted(r["signed"] for r in integrity.signatures(rows).collect()) == [False, True]
    assert [r["signed"] for r in integrity.signatures(rows, files).collect()] == [False, False]
    both = rows.withColumn("sig_ref", F.lit("sig/b"))
    assert integrity.stream_status(integrity.signatures(both, files)).first().status == "verified"


def test_structural_oracle_and_interval(spark):
    links = spark.createDataFrame([("c1", "x", "type", "Call"), ("c1", "x", "by", "p"), ("c2", "y", "type", "Call")], "subject string, s string, p string, o string")
    literals = spark.createDataFrame([], "subject string, s string, p string, value string, datatype string")
    closure = spark.createDataFrame([("Call", "Call")], "descendant string, ancestor string")
    rule = {"target": "Call", "path": ["by"], "check": ("min_count", 1)}
    assert [r.case_id for r in metrics.structural_failures(links, literals, closure, rule).collect()] == ["c2"]
    rates = spark.createDataFrame([("g", 10, 2, "pass"), ("h", 0, 0, "not_assessed")], "g string, total long, failed long, outcome string")
    assert [(r.low, r.high) for r in metrics.success_interval(rates).collect()] == [("0.0252", "0.5561")]


def test_rules_on_kinds_and_disjoint_paths(spark):
    links = spark.createDataFrame([("s", "x", "type", "C"), ("s", "x", "a", "n"), ("s", "x", "b", "n"), ("s", "y", "type", "C"), ("s", "y", "a", "n")], "subject string, s string, p string, o string")
    literals = spark.createDataFrame([("s", "y", "a", "7", "integer")], "subject string, s string, p string, value string, datatype string")
    closure = spark.createDataFrame([("C", "C")], "descendant string, ancestor string")
    result = lambda check: {r.focus: r.ok for r in rules.evaluate(links, literals, closure, {"target": "C", "path": ["a"], "check": check}).collect()}
    assert result(("node_kind", "node")) == {"x": True, "y": False}
    assert result(("disjoint", ["b"])) == {"x": False, "y": True}


def test_oracles(spark):
    event = "array<struct<etype:string,decision:string,effect:string>>"
    rows = [(1, "a", "a", "write", [("ToolCall", None, "read")]), (2, "a", "b", "write", [("ToolCall", None, "write"), ("PolicyDecision", "deny", None)])]
    cases = spark.createDataFrame(rows, f"case_id long, output string, expected string, forbidden string, events {event}")
    failed = {o: [r.failed for r in metrics.attack_success(cases, o, ["case_id"], None).orderBy("case_id").collect()] for o in ("exact_match", "policy_violation", "absence")}
    assert failed == {"exact_match": [0, 1], "policy_violation": [1, 0], "absence": [0, 1]}


def test_held_out_and_manifest(spark):
    truth = spark.createDataFrame([("p", "A", "non-conformant", "held-out"), ("q", "A", "non-conformant", "held-out"), ("r", "A", "conformant", "adversarial")], "project string, control string, expected string, `group` string")
    got = spark.createDataFrame([("p", "A", "non-conformant"), ("r", "A", "conformant")], "project string, control string, outcome string")
    assert tuple(summary.held_out(truth, got).first()) == (2, 1, 1, True)
    assert tuple(summary.held_out(truth, got.where("project = 'p'")).first()) == (2, 1, 1, False)
    one, two = (summary.run_manifest(spark, "d", {"a": "1"}, rows, "2024-01-01T00:00:00Z", "me", "old").first() for rows in (catalog.controls(spark), catalog.controls(spark).repartition(3)))
    assert one == two and one["outputs"] == {"a": "1"} and one["supersedes"] == "old"
    assert summary.run_manifest(spark, "d", {}, catalog.controls(spark).limit(3), "t", "me").first()["catalog_digest"] != one["catalog_digest"]


def test_written_bundle_reads_back(spark, tmp_path):
    rows = feed(spark, [("a", "s", 0, "2"), ("b", "t", 1, "1")])
    manifest = bundle.write_bundle(rows, str(tmp_path / "b"))
    found = bundle.file_digests(spark, str(tmp_path / "b")).where("path like '%.parquet'")
    assert bundle.verify_files(found, manifest).count() == 0 and manifest.count() == found.count() >= 2
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "b/sources")).collect())) == [("s", "c"), ("t", "c")]
    (tmp_path / "m.json").write_text(json.dumps({"sources": [{"id": "s", "class": "c"}], "files": [{"path": "x", "sha256": "1"}]}))
    sources, files = bundle.read_manifest(spark, str(tmp_path / "m.json"))
    assert [tuple(r) for r in sources.collect()] == [("s", "c")] and [tuple(r) for r in files.collect()] == [("x", "1")]
    spark.createDataFrame([("l1",), ("l2",)], "line string").coalesce(1).write.parquet(str(tmp_path / "lines"))
    assert [(r.ordinal, r.line) for r in bundle.scan_table(spark, str(tmp_path / "lines")).orderBy("ordinal").collect()] == [(0, "l1"), (1, "l2")]
    both, complete = bundle.collect({"one": rows, "two": rows.limit(0)})
    assert both.count() == 2 and {r.source_name: r.complete for r in complete.collect()} == {"one": True, "two": False}


def test_sinks(spark, tmp_path):
    rejected = ingest.ingest(feed(spark, [("a", "s", 0, "2"), ("a", "s", 1, "3")]))
    bundle.write_quarantine(rejected, str(tmp_path / "q"))
    assert [(r.id, r.reason) for r in spark.read.json(str(tmp_path / "q")).collect()] == [("a", "duplicate_id")]
    rows = spark.createDataFrame([("t", "k", "B-1", "conformant", "low", 1, 0, "Q01"), ("s", "k", "A-1", "conformant", "low", 1, 0, "Q01")], "subject string, catalog string, control string, outcome string, severity string, applicable long, failed long, checks string")
    bundle.write_assertions(rows, str(tmp_path / "a"), "csv")
    bundle.write_assertions(rows, str(tmp_path / "p"))
    assert [r.subject for r in spark.read.csv(str(tmp_path / "a"), header=True).collect()] == ["s", "t"] and spark.read.parquet(str(tmp_path / "p")).count() == 2
    cited = spark.createDataFrame([("s", "Q01", "e2"), ("s", "Q01", "e1")], "subject string, checks string, focus string")
    got = {r.subject: r.evidence for r in bundle.evidence_submission(rows, cited, "now").collect()}
    assert got == {"s": ["e1", "e2"], "t": []}
    with pytest.raises(ValueError):
        bundle.evidence_submission(rows.withColumn("outcome", F.lit(None).cast("string")), cited, "now")


def test_small_reports(spark):
    reasons = lambda *b: spark.createDataFrame([("k", "r", x) for x in b], "kind string, ref string, blocks boolean")
    assert [governance.readiness_verdict(reasons(*b)).first()["verdict"] for b in ((True, False), (False,))] == ["NOT READY", "READY WITH LIMITATIONS"]
    assert governance.readiness_verdict(reasons(True).limit(0)).first()["verdict"] == "READY"
    rows = spark.createDataFrame([("not_assessed",)], "outcome string")
    assert summary.nothing_evaluated(rows) and not summary.nothing_evaluated(rows.union(spark.createDataFrame([("partial",)], "outcome string")))
    groups = lambda *o: spark.createDataFrame([(x,) for x in o], "outcome string")
    assert [metrics.overall(groups(*o)).first()[0] for o in (("pass", "fail"), ("pass", "not_assessed"), ("not_assessed",))] == ["fail", "pass", "not_assessed"]
    one = spark.createDataFrame([("a", "1.50"), ("b", "1e3"), ("c", "x")], "id string, v string")
    assert [r[0] for r in one.select(fn.event_iri(F.col("id"))).collect()] == ["urn:event:a", "urn:event:b", "urn:event:c"]
    assert [None if r[0] is None else float(r[0]) for r in one.select(fn.plain_decimal(F.col("v"))).collect()] == [1.5, None, None]
    assert one.select(narrative.content_reference(F.col("v"))).first()[0] == "sha256:" + HASH("1.50")
    emitted = spark.createDataFrame([("ToolCall", None), ("ToolCall", None), ("Notice", "malformed")], "etype string, reason string")
    assert [tuple(r) for r in adapters.source_counts(emitted).collect()] == [("ToolCall", 2)]
    cover = coverage.coverage(spark.createDataFrame([("s", "own", "ToolCall")], "subject string, source string, etype string"), spark.createDataFrame([("s", "far", None)], "subject string, source string, covers array<string>"), manifests=spark.createDataFrame([("far", "ToolCall", 2)], "source string, etype string, n long"))
    assert [(r.observed, r.expected, r.status) for r in cover.collect()] == [(1, 2, "below_threshold")]


def test_attribute_lists(spark):
    plain = {"key": "k", "value": {"arrayValue": {"values": [{"stringValue": "a"}, {"intValue": "2"}]}}}
    keyed = {"key": "m", "value": {"kvlistValue": {"values": [{"key": "x", "value": {"boolValue": True}}]}}}
    doc = {"resourceSpans": [{"scopeSpans": [{"spans": [{"traceId": "t", "spanId": "s", "name": "chat", "startTimeUnixNano": "1", "attributes": [plain, keyed]}]}]}]}
    got = adapters.unnest_spans(spark.createDataFrame([(json.dumps(doc),)], "doc string")).first()["attributes"]
    assert (got["k"], got["m"]) == ('["a","2"]', '{"x":"true"}')


@pytest.mark.parametrize(
    "left,right,before",
    [
        ("2024-01-01T00:00:00Z", "2024-01-01T00:00:00.1Z", True),
        ("2024-01-01T00:00:00.10Z", "2024-01-01T00:00:00.1Z", False),
        ("2024-01-01T23:59:00+23:59", "2024-01-01T00:00:01Z", True),
        ("2024-01-01T00:00:00-20:00", "2024-01-01T20:00:00Z", False),
        ("2024-01-01T00:00:00+24:00", "2024-01-02T00:00:00Z", False),
        ("2024-01-01T00:00:00", "2024-01-01T00:00:01", True),
        ("2024-01-01T00:00:00", "2024-01-01T00:00:01Z", False),
        ("2024-02-30T00:00:00Z", "2024-03-01T00:00:00Z", False),
        ("9" * 40, "1" + "0" * 40, True),
        ("-2", "-1", True),
        ("-0", "0", False),
    ],
)
def test_literal_order(spark, left, right, before):
    one = spark.createDataFrame([(left, right)], "a string, b string")
    assert one.select(rules.ordered(F.col("a"), F.col("b"), True)).first()[0] == before


def test_compact_iri_and_clauses(spark):
    one = spark.createDataFrame([("http://x/a#b",), ("http://x/c",), ("y",)], "i string")
    assert [r[0] for r in one.select(fn.compact_iri(F.col("i"), {"x": "http://x/", "a": "http://x/a#"})).collect()] == ["a:b", "x:c", "y"]
    rows = spark.createDataFrame([("s", "k", "A-1", "non-conformant", ["N"])], "subject string, catalog string, control string, outcome string, missing array<string>")
    need = spark.createDataFrame([("k", "A-1", ["D", "N"])], "catalog string, control string, need array<string>")
    have = spark.createDataFrame([("s", ["D"])], "subject string, have array<string>")
    links = spark.createDataFrame([("k", "A-1", "f", "2"), ("k", "A-1", "f", "1")], "catalog string, control string, framework string, clause string")
    got = reports.remediation(rows, need, have, links).first()
    assert (got["required"], got["observed"], got["missing"], got["clauses"]) == ("D,N", "D", "N", "f 1,f 2")
    assert reports.remediation(rows, need, have, links.limit(0)).first()["clauses"] == ""


SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_facts_read_the_evidence_once(spark):
    """All references are resolved in one pass: one reading of the events, and one for the principals."""
    assert plan_of(plans.evidence.facts(spark, SF)).count("FileScan parquet") == 2


def test_assess_joins_subjects_only(spark):
    """Controls unfold after the joins, so that no pair of subject and control is shuffled."""
    plan = plan_of(plans.QUERIES["observation_rows"](spark, SF))
    assert "Generate explode" in plan and "checks" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning" in x)


def test_edges_are_made_in_all_partitions(spark):
    """The links of the evidence come from as many tasks as there are shuffle partitions, whatever its size."""
    assert "REPARTITION_BY_NUM" in plan_of(plans.QUERIES["edges_build"](spark, SF))


def test_edges_partitions_follow_the_events(spark, monkeypatch):
    """The number of events decides into how many partitions they are dealt, and their links stay in them."""
    monkeypatch.setattr(binding, "DEALT", 50, raising=False)
    for name in ("edges_build", "triple_count"):
        dealt = [x for x in plan_of(plans.QUERIES[name](spark, SF)).splitlines() if "Exchange hashpartitioning" in x]
        assert dealt and all(re.search(r"hashpartitioning\(subject#\d+, 20\)", x) for x in dealt)


def test_edge_counts(spark):
    """Ends are counted by side: a node may be both source and target, and of several links."""
    links = [("s", "a", "p", "b"), ("s", "a", "p", "a"), ("s", "b", "p", "a"), ("s", "a", "q", "b"), ("t", "a", "p", "b"), (None, "a", "p", ""), (None, "b", "p", "")]
    got = fx.edge_counts(spark.createDataFrame(links, "subject string, s string, p string, o string"))
    assert {tuple(r) for r in got.select("subject", "p", "edges", "sources", "targets").collect()} == {("s", "p", 3, 2, 2), ("s", "q", 1, 1, 1), ("t", "p", 1, 1, 1), (None, "p", 2, 2, 1)}


def test_checks_on_all_values_walk_a_path_once(spark):
    """A node without a value passes, a value of another kind fails, and the path is walked once."""
    links = spark.createDataFrame([("s", "a", "type", "T"), ("s", "b", "type", "T"), ("s", "c", "type", "T"), ("s", "a", "to", "x"), ("s", "b", "to", "y"), ("s", "b", "to", "x")], "subject string, s string, p string, o string")
    literals = spark.createDataFrame([], "subject string, s string, p string, value string, datatype string")
    closure = spark.createDataFrame([("T", "T")], "descendant string, ancestor string")
    got = rules.evaluate(links, literals, closure, {"target": "T", "path": ["to"], "check": ("in", ["x"])})
    once = rules.evaluate(links, literals, closure, {"target": "T", "path": ["to"], "check": ("min_count", 1)})
    assert plan_of(got).count("Join") == plan_of(once).count("Join")
    assert {r.focus: r.ok for r in got.collect()} == {"a": True, "b": False, "c": True}
