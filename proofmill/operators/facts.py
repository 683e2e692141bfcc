"""Facts about focus nodes, and the checks over them.

Every rule of the catalogue reduces to 22 yes/no checks over five kinds of event.  ``facts`` derives,
in one plan for all subjects, one row per focus event with the counts and flags those checks need;
references are resolved by joins on (subject, id), so a reference into another subject dangles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Instruction classes that count as trusted; a missing class does too.
TRUSTED = ["user", "operator", "service", "agent_identified", "memory_trusted"]
REFS = ["ref_decision", "ref_delegation", "ref_instruction", "ref_request", "ref_authorization"]

_DEC = "target = 'Decision' and class_consequential"
_CALL = "target = 'ToolCall'"
_EXEC = "target = 'ToolCall' and executes_consequential"
#: signature: (population, check), over the columns of ``facts``.
SIGNATURES = {
    "Q01": (_DEC, "n_reviewed >= 1"),
    "Q02": (_DEC, "n_agent >= 1"),
    "Q03": (_DEC, "n_used >= 1"),
    "Q04": (_DEC, "has_time"),
    "Q05": (_EXEC, "source_class = 'enforcement_point'"),
    "Q06": (_CALL, "n_dangling = 0"),
    "Q07": (_DEC, "n_notified >= 1"),
    "Q08": (_EXEC, "delegation_verified"),
    "Q09": (_DEC, "n_authorized >= 1"),
    "Q10": (_DEC, "n_resulted >= 1"),
    "Q11": ("target = 'Incident'", "n_agent >= 1"),
    "Q12": (_EXEC, "source_class in ('enforcement_point', 'independent_system')"),
    "Q13": (_EXEC, "source_class = 'enforcement_point' and source_class is not null"),
    "Q14": ("target = 'DelegationIssued'", "chain_verified"),
    "Q15": (_DEC, "modality_ok"),
    "Q16": (_EXEC, "terminus_human"),
    "Q17": (_EXEC, "executed_modality_ok"),
    "Q18": (_CALL, "within_scope"),
    "Q19": (_EXEC, "n_acts_on >= 1"),
    "Q20": (_CALL, "not acts_on_untrusted"),
    "Q21": ("target = 'Instruction' and instruction_untrusted", "n_refused >= 1"),
    "Q22": (_CALL, "within_budget"),
}


def untrusted(column: str = "instruction_class") -> Column:
    return F.coalesce(~F.col(column).isin(TRUSTED), F.lit(False))


def edges(ev: DataFrame) -> DataFrame:
    """Typed links (subject, s, p, o) as a set: one pass that explodes the links of each event."""
    link = lambda s, p, o: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    me, c = F.col("id"), F.col
    when = lambda kind, x: F.when(c("etype") == kind, x)
    out = [
        link(me, "type", c("etype")),
        link(me, "type", c("decision_type")),
        link(me, "sourceClass", c("source_class")),
        link(me, "wasAssociatedWith", c("agent")),
        link(me, "authorizedBy", c("ref_authorization")),
        link(me, "authorizedBy", c("ref_request")),
        link(me, "delegatedVia", c("ref_delegation")),
        link(me, "actsOn", c("ref_instruction")),
        link(me, "executes", when("ToolCall", c("ref_decision"))),
        link(when("Outcome", c("ref_decision")), "resultedIn", me),
        link(when("ApprovalDecided", c("ref_decision")), "reviewedBy", me),
        link(when("Notice", c("ref_decision")), "notifiedBy", me),
        link(when("Override", c("ref_decision")), "overriddenBy", me),
        link(when("Interrupt", c("ref_decision")), "interruptedBy", me),
        link(when("Refusal", c("ref_instruction")), "refusedBy", me),
        link(c("agent"), "type", F.lit("Agent")),
    ]
    # what only some feeds carry: parent and origin of content, and the request that an authority event decides
    more = {"ref_parent": "derivedFrom", "ref_origin": "derivedFrom"}
    out += [link(me, p, c(name)) for name, p in more.items() if name in ev.columns]
    used = F.flatten(F.transform("used", lambda u: F.array(link(me, "used", u), link(u, "type", F.lit("ContextItem")))))
    behalf = F.when(F.col("agent").isNotNull(), F.transform("acted_for", lambda a: link(c("agent"), "actedOnBehalfOf", a))).otherwise(F.array().cast("array<struct<s:string,p:string,o:string>>"))
    every = F.filter(F.concat(F.array(*out), used, behalf), lambda x: x["s"].isNotNull() & x["o"].isNotNull())
    return ev.select("subject", F.explode(every).alias("e")).select("subject", "e.*").distinct()


def edge_counts(links: DataFrame) -> DataFrame:
    """(subject, p, edges, sources, targets) of a set of links.

    Each end is named once with its number of links, and then counted: links that are dealt by subject stay where they
    are, while two distinct counts in one aggregate would shuffle every link three times over.
    """
    end = lambda side: F.struct(F.lit(side).alias("side"), F.col(side).alias("node"))
    ends = links.select("subject", "p", F.explode(F.array(end("s"), end("o"))).alias("end")).select("subject", "p", "end.*")
    each = ends.groupBy("subject", "p", "side", "node").agg(F.count("*").alias("n"))
    source = F.col("side") == "s"
    return each.groupBy("subject", "p").agg(F.sum(F.when(source, F.col("n"))).alias("edges"), F.count_if(source).alias("sources"), F.count_if(~source).alias("targets"))


def dangling(ev: DataFrame) -> DataFrame:
    """References whose event is not in the same subject: (subject, id, ref); those of ``linked`` where rows have it."""
    every = F.col("linked") if "linked" in ev.columns else F.array_distinct(F.array_compact(F.array(*REFS)))
    refs = ev.select("subject", "id", F.explode(every).alias("ref"))
    known = ev.select("subject", F.col("id").alias("ref"))
    return refs.join(known, ["subject", "ref"], "left_anti").select("subject", "id", "ref")


def class_closure(parents: DataFrame, depth: int = 16) -> DataFrame:
    """Reflexive-transitive closure (descendant, ancestor) of a small single-parent table.

    Each round climbs one level; it ends when nothing climbs further, and a cycle fails loudly.
    """
    base = parents.select("child", "parent").where("parent is not null and child <> parent").distinct()
    nodes = base.select("child").union(base.select("parent")).distinct()
    level = nodes.select(F.col("child").alias("descendant"), F.col("child").alias("ancestor"))
    out = level
    for _ in range(depth):
        level = level.join(base, level.ancestor == base.child).select("descendant", F.col("parent").alias("ancestor"))
        if level.isEmpty():
            return out.distinct()
        out = out.union(level)
    raise ValueError(f"class hierarchy deeper than {depth} levels, or cyclic")


def facts(ev: DataFrame, domain: DataFrame, principals: DataFrame) -> DataFrame:
    """One row per focus event; ``domain`` is a rule table and broadcast.

    The evidence is read once.  Each event becomes a row for itself and one for each event that it names;
    at the named event these meet (what is it, and who names it), and back at the naming event what was
    found is put together.  Rows that are dealt by subject already are not dealt again.
    """
    c = F.col
    is_ = lambda *kinds: c("etype").isin(*kinds)
    flag = lambda x: F.coalesce(x, F.lit(False))
    dom = domain.select("decision_type", (c("parent") == "ConsequentialDecision").alias("d_class"), c("consequential").alias("d_flag"), c("required_modality").alias("d_need"))
    ok = c("d_need").isNull() | (c("d_need") == c("oversight_modality"))
    # a delegation's own word on its chain comes before the status of its verification
    verified = F.coalesce("chain_verified", c("verification_status") == "verified") if "verification_status" in ev.columns else c("chain_verified")
    own = {
        "target": c("etype"),
        "class_consequential": flag(is_("Decision") & c("d_class")),
        "flag_consequential": flag(is_("Decision") & c("d_flag")),
        "source_class": c("source_class"),
        "n_agent": c("agent").isNotNull().cast("int"),
        "n_used": F.size("used"),
        "has_time": c("time").isNotNull(),
        "n_authorized": c("ref_authorization").isNotNull().cast("int"),
        "n_acts_on": (c("ref_instruction").isNotNull() & is_("ToolCall")).cast("int"),
        "modality_ok": flag(is_("Decision") & ok),
        "chain_verified": flag(verified),
        "instruction_untrusted": flag(is_("Instruction") & untrusted()),
        "principal": F.when(is_("ToolCall"), F.try_element_at("acted_for", F.lit(-1))),
    }
    # what a tool call points at: its decision, delegation and instruction; a decision, its instruction
    forward = {"decision": F.when(is_("ToolCall"), c("ref_decision")), "delegation": F.when(is_("ToolCall"), c("ref_delegation")), "instruction": F.when(is_("ToolCall", "Decision"), c("ref_instruction"))}
    # what counts at the event pointed at
    back = {
        "reviewed": F.when(is_("ApprovalDecided"), c("ref_decision")),
        "notified": F.when(is_("Notice"), c("ref_decision")),
        "resulted": F.when(is_("Outcome"), c("ref_decision")),
        "refused": F.when(is_("Refusal"), c("ref_instruction")),
        "denied": F.when(is_("PolicyDecision") & (c("policy_decision") == "deny"), c("ref_request")),
        "budget": F.when(is_("Refusal") & (c("reason_class") == "budget_exceeded"), c("ref_request")),
    }
    loose = F.coalesce("linked", F.array().cast("array<string>")) if "linked" in ev.columns else F.array(*REFS)
    keys = F.array_distinct(F.array_compact(F.concat(loose, F.array(*forward.values(), *back.values()))))
    at = lambda k: (F.struct(F.lit(False).alias("me"), k.alias("key"), F.array_contains(F.array_compact(loose), k).alias("loose"), *[flag(k == v).alias(n) for n, v in {**forward, **back}.items()]))
    none = [F.lit(False).alias(n) for n in ("loose", *forward, *back)]
    named = F.concat(F.array(F.struct(F.lit(True).alias("me"), c("id").alias("key"), *none)), F.transform(keys, at))
    said = F.struct(flag(c("d_flag")).alias("flag"), ok.alias("ok"), verified.alias("verified"), untrusted().alias("untrusted"), *[v.alias(n) for n, v in own.items()])
    # an event without an id is a row of its own
    rows = ev.join(F.broadcast(dom), "decision_type", "left").select("subject", "id", F.when(c("id").isNull(), F.monotonically_increasing_id()).alias("_row"), said.alias("own"), F.explode(named).alias("e"))
    rows = rows.select("subject", "id", "_row", F.when(c("e.me"), c("own")).alias("own"), "e.*")
    meet = Window.partitionBy("subject", "key")
    kind = lambda etype, x: F.max(F.when(c("me") & (c("own.target") == etype), c(f"own.{x}"))).over(meet)
    found = {
        "loose": c("loose") & ~F.max("me").over(meet),
        "x_flag": c("decision") & kind("Decision", "flag"),
        "x_ok": c("decision") & kind("Decision", "ok"),
        "x_verified": c("delegation") & kind("DelegationIssued", "verified"),
        "x_untrusted": c("instruction") & kind("Instruction", "untrusted"),
        **{f"n_{n}": F.when(c("me") & c("key").isNotNull(), F.count_if(n).over(meet)) for n in back},
    }
    rows = rows.select("subject", "id", "_row", "own", *[v.alias(n) for n, v in found.items()])
    rows = rows.groupBy("subject", "id", "_row").agg(F.first("own", ignorenulls=True).alias("own"), F.count_if("loose").alias("n_dangling"), *[F.max(n).alias(n) for n in found if n != "loose"])
    rows = rows.where(c("own.target").isin("Decision", "ToolCall", "DelegationIssued", "Incident", "Instruction")).select("*", c("own.principal").alias("principal"))
    people = principals.where("class = 'HumanPrincipal'").select("subject", "principal", F.lit(True).alias("x_human"))
    rows = rows.join(people, ["subject", "principal"], "left")
    no = lambda x: F.coalesce(c(x), F.lit(0).cast("long"))
    mine = lambda *names: [c(f"own.{n}").alias(n) for n in names]
    return rows.select(
        "subject",
        "id",
        *mine("target", "class_consequential", "flag_consequential", "source_class", "n_agent", "n_used", "has_time"),
        *[no(x).alias(x) for x in ("n_reviewed", "n_notified", "n_resulted", "n_refused", "n_dangling")],
        *mine("n_authorized", "n_acts_on", "modality_ok", "chain_verified"),
        flag(c("x_flag")).alias("executes_consequential"),
        flag(c("x_ok")).alias("executed_modality_ok"),
        flag(c("x_verified")).alias("delegation_verified"),
        flag(c("x_human")).alias("terminus_human"),
        (no("n_denied") == 0).alias("within_scope"),
        (no("n_budget") == 0).alias("within_budget"),
        flag(c("x_untrusted")).alias("acts_on_untrusted"),
        *mine("instruction_untrusted"),
    )


def signatures_of(checks: str) -> list[tuple[str, str]]:
    """(population, check) of a "+"-joined list; its signatures share their population."""
    return [SIGNATURES[s] for s in checks.split("+")]


def population_and_check(checks: str) -> tuple[Column, Column]:
    parts = signatures_of(checks)
    ok = F.lit(True)
    for _, test in parts:
        ok = ok & F.coalesce(F.expr(test), F.lit(False))
    return F.coalesce(F.expr(parts[0][0]), F.lit(False)), ok


def check_table(rows: DataFrame, all_checks: list[str]) -> DataFrame:
    """(subject, counts): of each check, in the order given, its name, applicable and failed; one conditional
    aggregate per check, one shuffle for all."""
    aggs = []
    for name in all_checks:
        where, ok = population_and_check(name)
        aggs += [F.struct(F.lit(name).alias("checks"), F.count_if(where).alias("applicable"), F.count_if(where & ~ok).alias("failed")).alias(name)]
    return rows.groupBy("subject").agg(*aggs).select("subject", F.array(*[F.col(f"`{n}`") for n in all_checks]).alias("counts"))


def check_counts(rows: DataFrame, all_checks: list[str]) -> DataFrame:
    """(subject, checks, applicable, failed) of each check."""
    return check_table(rows, all_checks).select("subject", F.explode("counts").alias("c")).select("subject", "c.*")
