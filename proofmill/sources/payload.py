"""Payloads of accepted events, shredded to the columns that rules read; and events as lines.

``COLUMNS`` says which member of which event type makes which column, so users add their own.  One
``from_json`` per event gives every named member as a variant; a value of another kind than the
column's counts as missing, as does a member of an object that is none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import once
from ..operators import ingest as ing
from ..operators.facts import class_closure
from .bundle import scan_lines
from .scratch import written

#: A line a column: its name, event type (* for all), path and kind.  event: a text that
#: may name an event; truth: whether a value counts as true where there is one, of whatever kind;
#: principals: texts, or objects with id and kind.
COLUMNS = """
agent * agent.id text
used * used texts
acted_for * acted_for principals
chain DelegationIssued chain principals
chain_verified DelegationIssued chain_verified truth
verification_status DelegationIssued verification.status text
decision_type Decision decision_type text
oversight_modality Decision oversight_modality text
instruction_class Instruction source_class text
policy_decision PolicyDecision decision text
reason_class Refusal reason_class text
latency_ms ApprovalDecided latency_ms integer
viewed ApprovalDecided explanation_viewed boolean
incident_id Incident incident_id text
ref_decision * refs.decision text
ref_delegation * refs.delegation text
ref_instruction * refs.instruction text
ref_request * refs.request text
ref_authorization * refs.authorization text
ref_parent * refs.parent text
ref_origin * refs.origin text
"""
#: Kinds of principals and their class; and the class above each.
CLASSES = {"human": "HumanPrincipal", "service": "ServicePrincipal"}
ABOVE = [("HumanPrincipal", "Principal"), ("ServicePrincipal", "Principal"), ("Principal", "Agent")]
#: What the name of an event begins with where it stands as a reference.
EVENT = "event:"
#: JSON texts of what counts as false.
_FALSE = ["null", "false", "0", "0.0", '""', "[]", "{}"]


def column_rules(text: str = COLUMNS) -> list[tuple[str, str, str, str]]:
    return [tuple(line.split()) for line in text.strip().splitlines()]


def members(paths: list[str]) -> str:
    """Schema of a payload with a variant, or a list of them, at each dotted path (``[]`` ends that of a list)."""
    tree: dict = {}
    for path in paths:
        reduce(lambda at, step: at.setdefault(step, {}), path.split("."), tree)
    kind = lambda name, below: f"`{name.removesuffix('[]')}`:" + (f"struct<{','.join(kind(n, b) for n, b in below.items())}>" if below else "array<variant>" if name.endswith("[]") else "variant")
    return f"struct<{','.join(kind(n, b) for n, b in tree.items())}>"


def text(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def principal(v: Column) -> Column:
    """(id, kind) of a bare text or an object; id is null where it names none."""
    own = F.try_variant_get(v, "$.id", "variant")
    kind = F.try_variant_get(v, "$.kind", "variant")
    return F.struct(F.coalesce(text(v), text(own)).alias("id"), F.when(text(v).isNull(), text(kind)).alias("kind"))


def value(v: Column, kind: str) -> Column:
    if kind == "text":
        return text(v)
    if kind == "texts":
        return F.array_compact(F.transform(v, text))
    if kind == "principals":
        return F.transform(v, principal)
    if kind == "truth":
        return F.when(v.isNotNull(), ~F.to_json(v).isin(_FALSE))
    if kind == "integer":
        return F.when(F.schema_of_variant(v).isin("BIGINT", "DECIMAL(38,0)"), F.try_variant_get(v, "$", "bigint"))
    return F.when(F.schema_of_variant(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))


def shredded(rows: DataFrame, rules: str = COLUMNS, data: str = "data", event: str = EVENT) -> DataFrame:
    """Evidence rows of accepted ``rows`` (envelope columns and the payload as JSON text).

    ``id`` becomes the name by which references call an event.  The payload's own type comes before
    the envelope's.  ``linked`` lists what may dangle: all references, and content used, that name an
    event.  ``acted_for`` keeps its places: an entry that names nobody is null.  Lists are empty where
    the payload has none.
    """
    table = column_rules(rules)
    listed = {"texts", "principals"}
    paths = [path + "[]" * (kind in listed) for _, _, path, kind in table]
    p = F.from_json(data, members([*paths, "@type"]))
    out = rows.select("*", once(p).alias("_p")).withColumn("etype", F.coalesce(text(F.col("_p.`@type`")), "etype")).withColumn("id", F.concat(F.lit(event), "id"))
    refs = F.map_values(F.from_json(F.get_json_object(data, "$.refs"), "map<string,variant>"))
    cols: dict[str, Column] = {}
    for name, etype, path, kind in table:
        got = value(F.col("_p." + ".".join(f"`{s}`" for s in path.split("."))), kind)
        cols[name] = got if etype == "*" else F.when(F.col("etype") == etype, got)
    none = F.array().cast("array<string>")
    named = lambda vs: F.filter(F.coalesce(vs, none), lambda x: x.startswith(event))
    links = F.array_distinct(F.concat(named(F.transform(refs, text)), named(cols["used"])))
    out = out.withColumns({**cols, "linked": links}).drop("_p", data)
    people = "array<struct<id:string,kind:string>>"
    chains = {"principals": F.concat(*[F.coalesce(c, F.array().cast(people)) for c in ("acted_for", "chain")])}
    return out.withColumns(chains).withColumns({"used": F.coalesce("used", none), "acted_for": F.coalesce(F.transform("acted_for", lambda x: x["id"]), none)}).drop("chain")


def principal_classes(ev: DataFrame) -> DataFrame:
    """(subject, principal, class): all classes that the chains of a subject's events give a principal,
    and those above them.  One named as human here and as service there has both."""
    kind = F.coalesce(*[F.when(F.col("p.kind") == k, c) for k, c in CLASSES.items()], F.lit("Principal"))
    own = ev.select("subject", F.explode("principals").alias("p")).where("p.id is not null").select("subject", F.col("p.id").alias("principal"), kind.alias("descendant")).distinct()
    above = class_closure(ev.sparkSession.createDataFrame(ABOVE, "child string, parent string"))
    return own.join(F.broadcast(above), "descendant").select("subject", "principal", F.col("ancestor").alias("class")).distinct()


def in_order(lines: DataFrame) -> DataFrame:
    """Lines with an ordinal that ascends through all files in the order of their names.

    Only the list of files, a row each, is put in order.
    """
    files = lines.select("file").distinct().withColumn("_nth", F.row_number().over(Window.orderBy("file")) - 1)
    return lines.join(F.broadcast(files), "file").withColumn("ordinal", F.shiftleft(F.col("_nth").cast("long"), 42) + F.col("ordinal")).drop("_nth")


def event_lines(ev: DataFrame, kinds: Column, event: str = EVENT) -> DataFrame:
    """Evidence rows as JSON lines (ordinal, line); ``kinds`` gives the kind of the principal x of acted_for.

    A column ``chain`` of (id, kind), where there is one, becomes that of a delegation.
    """
    to = lambda c: F.concat(F.lit(event), c)
    named = {c.removeprefix("ref_"): c for c in ev.columns if c.startswith("ref_")}
    refs = F.struct(*[to(F.col(c)).alias(name) for name, c in named.items()])
    for_whom = F.transform("acted_for", lambda x: F.struct(x.alias("id"), kinds(x).alias("kind")))
    own = {"decision_type": "decision_type", "oversight_modality": "oversight_modality", "source_class": "instruction_class", "decision": "policy_decision", "reason_class": "reason_class", "chain_verified": "chain_verified", "latency_ms": "latency_ms", "explanation_viewed": "viewed", "incident_id": "incident_id"}
    chain = [F.col("chain")] if "chain" in ev.columns else []
    body = F.struct(F.col("etype").alias("@type"), *chain, F.when(F.col("agent").isNotNull(), F.struct(F.col("agent").alias("id"))).alias("agent"), "used", for_whom.alias("acted_for"), refs.alias("refs"), *[F.col(c).alias(m) for m, c in own.items()])
    kind = F.concat(F.lit("com.example.evidence."), "etype", F.lit(".v1")).alias("type")
    return ev.select("ordinal", F.to_json(F.struct("id", "source", "subject", "time", kind, F.col("source_class").alias("sourceclass"), body.alias("data"))).alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Write (ordinal, line) as text files that stand, and whose lines stand, in the order of the ordinal."""
    lines.repartitionByRange("ordinal").sortWithinPartitions("ordinal").select("line").write.text(path)


def evidence_of(spark: SparkSession, path: str, sources: DataFrame | None = None) -> DataFrame:
    """The accepted events of the JSON lines below ``path`` as evidence rows, written once as they are read often."""
    rows = ing.ingest(ing.parse_lines(in_order(scan_lines(spark, path))), sources)
    return written(shredded(rows.where("reason is null").drop("file", "parse_reason", "reason")), "shredded")
