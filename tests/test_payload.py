"""From payloads to evidence columns, and from files of lines to outcomes."""

import json

from pyspark.sql import functions as F

from proofmill.operators import facts as fx
from proofmill.sources import binding as bd
from proofmill.sources import payload as pl


def line(i, etype, data, subject="s", source="src"):
    return json.dumps({"id": f"e{i}", "source": source, "subject": subject, "time": f"2024-01-01T00:00:{i:02d}Z", "type": f"com.example.evidence.{etype}.v1", "sourceclass": "enforcement_point", "data": {"@type": etype, **data}})


def evidence(spark, tmp_path, lines):
    (tmp_path / "a.jsonl").write_text("\n".join(lines[: len(lines) // 2]) + "\n")
    (tmp_path / "b.jsonl").write_text("\n".join(lines[len(lines) // 2 :]) + "\n")
    return pl.evidence_of(spark, str(tmp_path))


def test_a_bundle_of_lines(spark, tmp_path):
    """References, chains, consequential calls and untrusted instructions follow from the payloads alone."""
    lines = [
        line(1, "DelegationIssued", {"chain": [{"id": "ann", "kind": "human"}, {"id": "bot", "kind": "service"}, {"kind": "human"}, "plain"], "verification": {"status": "verified"}}),
        line(2, "DelegationIssued", {"chain": [{"id": "bot", "kind": "human"}], "verification": {"status": "verified"}, "chain_verified": ""}),
        line(3, "Instruction", {"source_class": "tool_output"}),
        line(4, "Decision", {"decision_type": "dom:Credit", "oversight_modality": "review_before", "agent": {"id": "a"}, "used": ["ctx", "event:gone", 5]}),
        line(5, "ToolCall", {"refs": {"decision": "event:e4", "delegation": "event:e1", "instruction": "event:e3", "basis": "event:e99"}, "acted_for": ["svc", "ann"], "agent": {"id": "a"}}),
        line(6, "ToolCall", {"refs": {"decision": "event:e4", "delegation": "event:e2"}, "acted_for": ["ann", {"kind": "human"}]}),
        line(7, "ApprovalDecided", {"refs": {"decision": "event:e4"}, "latency_ms": 12, "explanation_viewed": True}),
        line(8, "Refusal", {"refs": {"instruction": "event:e3", "request": "event:e5"}, "reason_class": "budget_exceeded"}),
        line(8, "Refusal", {"refs": {}}),
        "no json",
    ]
    ev = evidence(spark, tmp_path, lines)
    rows = {r["id"]: r for r in ev.collect()}
    assert set(rows) == {f"event:e{i}" for i in range(1, 9)}
    assert rows["event:e1"]["chain_verified"] is None and rows["event:e2"]["chain_verified"] is False
    assert rows["event:e4"]["used"] == ["ctx", "event:gone"] and rows["event:e4"]["linked"] == ["event:gone"]
    assert rows["event:e6"]["acted_for"] == ["ann", None] and rows["event:e7"]["latency_ms"] == 12
    classes = pl.principal_classes(ev)
    assert {(r["principal"], r["class"]) for r in classes.collect()} == {
        *[("ann", c) for c in ("HumanPrincipal", "Principal", "Agent")], *[("bot", c) for c in ("HumanPrincipal", "ServicePrincipal", "Principal", "Agent")], *[(p, c) for p in ("plain", "svc") for c in ("Principal", "Agent")]
    }
    got = {r["id"]: r for r in fx.facts(ev, bd.domain(spark), classes).collect()}
    assert got["event:e5"]["executes_consequential"] and got["event:e5"]["delegation_verified"] and got["event:e5"]["terminus_human"] and got["event:e5"]["acts_on_untrusted"] and not got["event:e5"]["within_budget"]
    assert got["event:e6"]["executes_consequential"] and not got["event:e6"]["delegation_verified"] and not got["event:e6"]["terminus_human"] and not got["event:e6"]["acts_on_untrusted"]
    assert got["event:e4"]["n_reviewed"] == 1 and got["event:e4"]["n_dangling"] == 1 and got["event:e5"]["n_dangling"] == 1 and got["event:e6"]["n_dangling"] == 0
    assert got["event:e3"]["instruction_untrusted"] and got["event:e3"]["n_refused"] == 1


def test_payloads_that_are_none(spark):
    rows = spark.createDataFrame([(str(i), "ToolCall", "s", d) for i, d in enumerate([None, "", "5", "[1]", "{", '{"refs": {"decision": {"x": 1}}, "agent": "a", "used": {"a": "b"}}'])], "id string, etype string, subject string, data string")
    got = pl.shredded(rows).collect()
    assert len(got) == 6 and all(r["agent"] is None and r["used"] == [] and r["acted_for"] == [] and r["linked"] == [] and r["ref_decision"] is None for r in got)
    assert pl.shredded(rows.limit(0)).count() == 0


def test_own_columns(spark):
    """A user's own rules make their columns."""
    rows = spark.createDataFrame([("1", "ToolCall", "s", '{"tool": {"name": "t", "cost": {"cents": 7}}}')], "id string, etype string, subject string, data string")
    got = pl.shredded(rows, pl.COLUMNS + "tool ToolCall tool.name text\ncents * tool.cost.cents integer\n").first()
    assert (got["tool"], got["cents"]) == ("t", 7)


def test_lines_in_order(spark, tmp_path):
    for name in ("b", "a", "c"):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(f'{{"n": "{name}{i}"}}' for i in range(3)))
    from proofmill.sources.bundle import scan_lines

    rows = pl.in_order(scan_lines(spark, str(tmp_path))).orderBy("ordinal").select(F.get_json_object("line", "$.n").alias("n")).collect()
    assert [r["n"] for r in rows] == [f"{x}{i}" for x in "abc" for i in range(3)]


def test_intermediate_tables_can_be_cleared(spark):
    from pathlib import Path

    from proofmill.sources.scratch import clear, shared_dir, written

    assert written(spark.range(3), "three").count() == 3
    at = Path(shared_dir(spark).removeprefix("file:"))
    assert at.name == spark.sparkContext.applicationId and any(at.iterdir())
    clear(spark)
    assert not at.exists()


def test_tree_digest(spark):
    """By hand over its three levels; the same in any order and any number of partitions; another for any change."""
    import hashlib

    from proofmill.sources.bundle import LEVELS, tree_digest

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    files = [(f"events/{i}.jsonl", sha(str(i))) for i in range(300)]
    rows = [(sha(p), f"{p} {d}") for p, d in files]
    for digits in LEVELS:
        groups = {}
        for at, line in rows:
            groups.setdefault(at[:digits], []).append(line)
        rows = [(at, f"{at} {sha(chr(10).join(sorted(lines)))}") for at, lines in groups.items()]
    found = spark.createDataFrame(files, "path string, sha256 string")
    assert tree_digest(found) == rows[0][1].strip() == tree_digest(found.orderBy("sha256").repartition(7))
    assert tree_digest(found.limit(299)) != tree_digest(found) and tree_digest(found.limit(0)) == sha("")


def test_places_over_ranges(spark):
    from proofmill.operators.reports import identical_rows, placed

    rows = spark.range(5000).selectExpr("id * 7919 % 5000 AS x", "cast(id % 3 AS string) AS s").repartition(9)
    assert all(r["place"] == r["x"] + 1 for r in placed(rows, ["x"]).collect())
    units = rows.selectExpr("if(x < 4000, 'big', 'small') AS unit", "x", "s")
    altered = units.selectExpr("unit", "x", "if(x % 100 = 0, 'other', s) AS s").where("x <> 4999")
    assert {tuple(r) for r in identical_rows(units, altered, ["x"]).collect()} == {("big", 4000, 3960), ("small", 1000, 0)}


def test_lines_are_parsed_once(spark):
    from proofmill.operators import ingest as ing

    odd = ['{"id": "a", "source": "s", "subject": "x", "time": "t", "type": "com.e.evidence.Decision.v1", "data": {"a": 1.50}}', '{"id": 7, "data": [1, {"z": null}]}', '{"id": 1.0e5, "time": {"a": true}}', "{", '{"id": "a", "id": "b"}', '[{"id": "a"}]', '{"id": "a"} x', '{"id": "a", "b": }', "null"]
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(odd)], "file string, ordinal long, line string")
    parsed = ing.parse_lines(lines)
    names = ["id", "source", "subject", "time", "data"]
    want = lines.select("ordinal", *[F.get_json_object("line", f"$.{c}").alias(c) for c in names])
    assert parsed.select("ordinal", *names).exceptAll(want).isEmpty() and want.count() == parsed.count()
    got = ing.ingest(parsed)
    assert {r.ordinal for r in got.where("reason is null").collect()} == {0}
    assert "parse_json" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
