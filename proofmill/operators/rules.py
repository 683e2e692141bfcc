"""User rules: any target, path and constraint, evaluated with joins and one aggregate per check.

A rule is a plain dict:
``target`` a class; ``where`` {predicate: value} (optional); ``path`` a list of steps, each a predicate
or ``^predicate`` for its inverse, or a list of alternatives; ``check`` (name, argument).
Values of a path form a bag: two routes to one value count twice.  ``links(subject, s, p, o)`` holds
edges, ``literals(subject, s, p, value, datatype)`` holds values that are no nodes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["subject", "focus"]


def values(links: DataFrame, literals: DataFrame) -> DataFrame:
    """Both kinds of value of a predicate: (subject, s, p, value, is_node, datatype)."""
    nodes = links.select("subject", "s", "p", F.col("o").alias("value"), F.lit(True).alias("is_node"), F.lit(None).cast("string").alias("datatype"))
    return nodes.unionByName(literals.select("subject", "s", "p", F.col("value").cast("string").alias("value"), F.lit(False).alias("is_node"), "datatype"))


def instances(links: DataFrame, closure: DataFrame, cls: str) -> DataFrame:
    """(subject, focus) of every node whose type is ``cls`` or below it; the closure is a small table."""
    below = closure.where(F.col("ancestor") == cls).select(F.col("descendant").alias("o"))
    typed = links.where("p = 'type'")
    return typed.join(below.union(below.sparkSession.createDataFrame([(cls,)], "o string")).distinct(), "o", "left_semi").select("subject", F.col("s").alias("focus")).distinct()


def targets(links: DataFrame, literals: DataFrame, closure: DataFrame, rule: dict) -> DataFrame:
    """Population of a rule: instances of its class that have every wanted value."""
    out = instances(links, closure, rule["target"])
    for p, v in rule.get("where", {}).items():
        has = values(links, literals).where((F.col("p") == p) & (F.col("value") == v)).select("subject", F.col("s").alias("focus"))
        out = out.join(has, KEYS, "left_semi")
    return out


def path_values(focus: DataFrame, links: DataFrame, literals: DataFrame, path: list) -> DataFrame:
    """(subject, focus, value, is_node, datatype): the bag of values at the end of a path."""
    every = values(links, literals)
    now = focus.select(*KEYS, F.col("focus").alias("value"))
    for step in path:
        routes = []
        for one in step if isinstance(step, list) else [step]:
            if one.startswith("^"):
                hop = links.where(F.col("p") == one[1:]).select("subject", F.col("o").alias("at"), F.col("s").alias("next"), F.lit(True).alias("is_node"), F.lit(None).cast("string").alias("datatype"))
            else:
                hop = every.where(F.col("p") == one).select("subject", F.col("s").alias("at"), F.col("value").alias("next"), "is_node", "datatype")
            routes.append(now.select(*KEYS, F.col("value").alias("at")).join(hop, ["subject", "at"]).select(*KEYS, F.col("next").alias("value"), "is_node", "datatype"))
        now = reduce(DataFrame.unionAll, routes)
    return now


def integer_key(text: Column) -> Column:
    """An order for whole numbers of any size: sign, digits, text; null for other text."""
    digits = F.regexp_replace(F.regexp_replace(text, "^[+-]", ""), "^0+(?=.)", "")
    negative = text.startswith("-") & (digits != "0")
    size = F.length(digits)
    flipped = F.translate(digits, "0123456789", "9876543210")
    return F.when(text.rlike(r"^[+-]?\d+$"), F.struct(F.when(negative, -1).otherwise(1).alias("sign"), F.when(negative, -size).otherwise(size).alias("size"), F.when(negative, flipped).otherwise(digits).alias("digits")))


def instant_key(text: Column) -> Column:
    """An order for date-times with any number of fraction digits: whether it has a zone, seconds, fraction text.

    Zones go to 23:59; a time without one is a time of its own kind.
    """
    shape = r"^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)(?:\.(\d+))?(Z|[+-](?:[01]\d|2[0-3]):[0-5]\d)?$"
    part = lambda i: F.regexp_extract(text, shape, i)
    whole = F.try_to_timestamp(F.concat(part(1), F.lit("Z")), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))
    zone = part(3)
    away = (F.substring(zone, 2, 2).try_cast("int") * 3600 + F.substring(zone, 5, 2).try_cast("int") * 60) * F.when(zone.startswith("-"), -1).otherwise(1)
    seconds = F.unix_seconds(whole) - F.coalesce(away, F.lit(0))
    return F.when(text.rlike(shape) & whole.isNotNull(), F.struct((zone != "").alias("zoned"), seconds.alias("seconds"), F.rtrim(part(2), F.lit("0")).alias("fraction")))


def ordered(left: Column, right: Column, strict: bool) -> Column:
    """Whether left comes before right, as integers or as instants; false where they do not compare."""
    test = (lambda a, b: a < b) if strict else (lambda a, b: a <= b)
    a, b = instant_key(left), instant_key(right)
    instants = F.when(a["zoned"] == b["zoned"], test(a, b))
    return F.coalesce(test(integer_key(left), integer_key(right)), instants, F.lit(False))


def evaluate(links: DataFrame, literals: DataFrame, closure: DataFrame, rule: dict, shapes: dict[str, dict] | None = None) -> DataFrame:
    """(subject, focus, ok) for every node of the rule's population."""
    focus = targets(links, literals, closure, rule)
    bag = path_values(focus, links, literals, rule["path"])
    name, arg = rule["check"]
    v = F.col("value")
    if name in ("class", "node", "qualified_min"):
        if name == "class":
            good = instances(links, closure, arg)
        else:
            shape = (shapes or {}).get(arg[0] if name == "qualified_min" else arg)
            if shape is None:  # an unknown shape is ignored by node, and counts nothing for qualified_min
                return focus.withColumn("ok", F.lit(name == "node"))
            nested = {**shape, "target": shape["target"]}
            good = evaluate(links, literals, closure, nested, shapes).where("ok").select(*KEYS)
        good = good.select("subject", F.col("focus").alias("value"), F.lit(True).alias("good")).distinct()
        bag = bag.join(good, ["subject", "value"], "left").withColumn("good", F.coalesce("good", F.lit(False)) & F.col("is_node"))
        test = F.count_if("good") >= arg[1] if name == "qualified_min" else F.coalesce(F.bool_and("good"), F.lit(True))
    elif name in ("equals", "disjoint"):
        other = path_values(focus, links, literals, arg).groupBy(*KEYS).agg(F.array_sort(F.collect_set("value")).alias("b"))
        mine = bag.groupBy(*KEYS).agg(F.array_sort(F.collect_set("value")).alias("a"))
        none = F.array().cast("array<string>")
        both = focus.join(mine, KEYS, "left").join(other, KEYS, "left").withColumns({"a": F.coalesce("a", none), "b": F.coalesce("b", none)})
        return both.select(*KEYS, (F.col("a") == F.col("b") if name == "equals" else ~F.arrays_overlap("a", "b")).alias("ok"))
    elif name in ("less_than", "less_than_or_equals"):
        # every value must come before every value of the other path: pairs of one node's values
        other = path_values(focus, links, literals, arg).select(*KEYS, F.col("value").alias("b"))
        pairs = bag.join(other, KEYS).groupBy(*KEYS).agg(F.bool_and(ordered(v, F.col("b"), name == "less_than")).alias("t"))
        return focus.join(pairs, KEYS, "left").select(*KEYS, F.coalesce("t", F.lit(True)).alias("ok"))
    else:
        # checks on all values hold for a node without any
        every = lambda c: F.coalesce(F.bool_and(F.when(F.col("_hit"), F.coalesce(c, F.lit(False)))), F.lit(True))
        test = {
            "min_count": lambda: F.count("value") >= arg,
            "max_count": lambda: F.count("value") <= arg,
            "has_value": lambda: F.coalesce(F.bool_or(v == arg), F.lit(False)),
            "in": lambda: every(v.isin(arg)),
            "datatype": lambda: every(~F.col("is_node") & (F.col("datatype") == arg)),
            "node_kind": lambda: every(F.col("is_node") == (arg == "node")),
            "min_inclusive": lambda: every(ordered(F.lit(arg), v, False)),
            "max_inclusive": lambda: every(ordered(v, F.lit(arg), False)),
        }[name]()
    return focus.join(bag.withColumn("_hit", F.lit(True)), KEYS, "left").groupBy(*KEYS).agg(test.alias("ok"))


def results(links: DataFrame, literals: DataFrame, closure: DataFrame, rules: dict[str, dict], shapes: dict[str, dict] | None = None) -> DataFrame:
    """(rule, subject, applicable, failed) of several user rules."""
    parts = [evaluate(links, literals, closure, r, shapes).groupBy("subject").agg(F.count("*").alias("applicable"), F.count_if(~F.col("ok")).alias("failed")).select(F.lit(n).alias("rule"), "subject", "applicable", "failed") for n, r in rules.items()]
    return reduce(DataFrame.unionAll, parts)


def where_subclass(rows: DataFrame, column: str, closure: DataFrame, ancestor: str, flagged: DataFrame | None = None) -> DataFrame:
    """Rows whose class is ``ancestor`` or below it; with ``flagged`` also those of a flagged class."""
    wanted = closure.where(F.col("ancestor") == ancestor).select(F.col("descendant").alias(column))
    if flagged is not None:
        wanted = wanted.union(flagged.select(column))
    return rows.join(wanted.distinct(), column, "left_semi")
