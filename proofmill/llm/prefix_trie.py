"""The trie of all conversation prefixes, with totals of every subtree.

A node is named by its prefix: two 64-bit exclusive ors over the hashes of its turns, each hash made
of the turn's depth and the SHA-256 of its role and text.  So a parent's name is the child's name
less one hash, and names are running totals that can be cut anywhere.

Subtree totals go by bands of BAND depths.  A node adds to its ancestors within its band alone, at
most BAND of them; what a band's top node gathers is then rolled up among the tops alone, which are
BAND times shallower, by the same steps; and each top adds its completed total to its ancestors in
the band above.  A trie of depth D takes about log(D) / log(BAND) steps down and up again, and no
row is met by more than BAND others at each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, words_of, written

BAND = 16
#: Depths of a conversation that one task takes together; a multiple of BAND.
RUN = 1024
#: A conversation takes its first turns, fewer than HEADS, from the first of its family.
FAMILY, HEADS = 20, 4
SUMS = ("n_leaves", "saved_tokens")


def placed(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, base, h, lead, size) and their own turns (those columns, pos, key, tokens).

    Turns are sorted by ranges, so a conversation of any length spreads over tasks; each range counts
    its own turns and the counts of the ranges before it are added.
    """
    role, text = text_of("role"), text_of("text")
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("key"),
        F.size(words_of(text)).alias("tokens"),
    )
    part = F.spark_partition_id().alias("part")
    rows = written(rows.repartitionByRange("conv_id", "turn", "key").select("*", part), "turns")
    counts = rows.groupBy("part", "conv_id").agg(F.count("*").alias("n"))
    whole, before = Window.partitionBy("conv_id"), Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(counts.select("part", "conv_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("n")), "turn-counts")
    sizes = counts.groupBy("conv_id").agg(F.max("n").alias("n"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS))
    convs = sizes.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), h.alias("h"))
    convs = convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
    lead = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = written(convs.select("conv_id", "base", "h", lead.alias("lead"), (lead + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")), "conversations")
    at = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy("turn", "key"))
    places = counts.select("part", "conv_id", "before").join(convs, "conv_id")
    turns = rows.withColumn("at", at).join(places, ["part", "conv_id"])
    return convs, written(turns.select(*convs.columns, (F.col("before") + F.col("at")).alias("pos"), "key", "tokens"), "placed")


def rebuilt(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """Turns (conv_id, depth, key, tokens, last) of the rebuilt conversations; a first of a family lends
    at most HEADS - 1 turns to at most 2 * FAMILY - 1 others."""
    rest = ["key", "tokens"]
    own = turns.where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("lead")).alias("depth"), *rest, "size")
    lent = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < HEADS)).select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), *rest)
    lent = lent.join(convs, "base").where("depth <= h").select("conv_id", "depth", *rest, "size")
    return own.union(lent).select("conv_id", "depth", *rest, (F.col("depth") == F.col("size")).alias("last"))


def latest(window: Window, a: Column, b: Column) -> Column:
    """The parents' names up to the top of the parent's band, at most BAND of them, from the top down."""
    names = F.collect_list(F.struct(a.alias("a"), b.alias("b"))).over(window.rowsBetween(1 - BAND, 0))
    n = ((F.col("depth") - 1) % BAND + 1).cast("int")
    return F.slice(names, F.size(names) - n + 1, n)


def chains(turns: DataFrame) -> DataFrame:
    """Per rebuilt turn its node (a, b), its parent (pa, pb) and ``up``, the ancestors in the parent's band."""
    e1, e2 = F.xxhash64(F.lit(1), "depth", "key"), F.xxhash64(F.lit(2), "depth", "key")
    run = F.floor((F.col("depth") - 1) / RUN)
    turns = turns.select("conv_id", "depth", "tokens", "last", run.alias("run"), e1.alias("e1"), e2.alias("e2"))
    own = Window.partitionBy("conv_id", "run").orderBy("depth")
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    rows = turns.select("*", F.bit_xor("e1").over(so_far).alias("a"), F.bit_xor("e2").over(so_far).alias("b"))
    rows = rows.select("conv_id", "depth", "run", "tokens", "last", "a", "b", F.col("a").bitwiseXOR(F.col("e1")).alias("pa"), F.col("b").bitwiseXOR(F.col("e2")).alias("pb"))
    rows = written(rows.select("*", latest(own, F.col("pa"), F.col("pb")).alias("up")), "runs")
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.where(F.col("depth") % RUN == 0).select("conv_id", (F.col("run") + 1).alias("run"), F.bit_xor("a").over(before).alias("oa"), F.bit_xor("b").over(before).alias("ob"))
    moved = lambda c, by: F.col(c).bitwiseXOR(F.col(by)).alias(c)
    later = rows.where("run > 0").join(ends, ["conv_id", "run"])
    up = F.transform("up", lambda x: F.struct(x["a"].bitwiseXOR(F.col("oa")).alias("a"), x["b"].bitwiseXOR(F.col("ob")).alias("b"))).alias("up")
    later = later.select("conv_id", "depth", "tokens", "last", moved("a", "oa"), moved("b", "ob"), moved("pa", "oa"), moved("pb", "ob"), up)
    return written(rows.where("run = 0").select(*later.columns).union(later), "chains")


def added(rows: DataFrame) -> DataFrame:
    return rows.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in SUMS])


def given(nodes: DataFrame) -> DataFrame:
    """What nodes add to the ancestors listed in ``up``."""
    return nodes.select(F.explode("up").alias("x"), *SUMS).select("x.a", "x.b", *SUMS)


def rolled_up(nodes: DataFrame, chain: DataFrame, deepest: int) -> DataFrame:
    """Totals (a, b, n_leaves, saved_tokens) of the subtrees of ``nodes(a, b, depth, up, n_leaves, saved_tokens)``."""
    top = F.col("depth") % BAND == 0
    local = added(nodes.select("a", "b", *SUMS).union(given(nodes.where(~top))))
    if deepest < BAND:
        return local
    local = written(local, "band-totals")
    tops = nodes.where(top).select("a", "b", "depth", "up")
    own = Window.partitionBy("conv_id", F.floor((F.col("depth") - 1) / BAND)).orderBy("depth")
    above = chain.where(top).select("conv_id", (F.col("depth") / BAND).cast("long").alias("depth"), "a", "b", F.col("up")[0].alias("p"))
    above = written(above.select("conv_id", "depth", "a", "b", latest(own, F.col("p.a"), F.col("p.b")).alias("up")), "bands")
    lists = above.groupBy("a", "b").agg(F.first("up").alias("up"))
    higher = tops.drop("up").withColumn("depth", (F.col("depth") / BAND).cast("long")).join(local, ["a", "b"]).join(lists, ["a", "b"], "left")
    higher = written(higher.withColumn("up", F.coalesce("up", F.array().cast(lists.schema["up"].dataType))), "band-tops")
    done = rolled_up(higher, above, deepest // BAND)
    return added(local.union(given(tops.where("depth > 0").join(done, ["a", "b"]))))


def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending conv_ids that end at each node (a, b), joined by commas.

    Ids are first strung together by 4,096 consecutive numbers, then a digest reads a node's strings
    in order, one at a time: it is a sequence by nature, so one task reads a node's strings, but holds one.
    """
    strung = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    strings = ends.groupBy("a", "b", F.shiftright("conv_id", 12).alias("block")).agg(strung.alias("ids"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for pdf in frames for row in pdf.itertuples(index=False, name=None))
        out = []
        for (a, b), own in groupby(rows, key=lambda r: r[:2]):
            digest = hashlib.sha256(next(own)[3].encode())
            for row in own:
                digest.update(b"," + row[3].encode())
            out.append((a, b, digest.hexdigest()))
            if len(out) == 10_000:
                yield pd.DataFrame(out, columns=["a", "b", "ends_sha256"])
                out = []
        yield pd.DataFrame(out, columns=["a", "b", "ends_sha256"])

    return strings.repartition("a", "b").sortWithinPartitions("a", "b", "block").mapInPandas(run, "a long, b long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of ``conversations(conv_id, turn, role, text)``, a row each.

    Turns stand by turn, null first, equal turns by the SHA-256 of role and text; null role and text
    are empty, equal rows are turns of their own, rows without a conv_id belong to none and are left
    out, other columns are not read.  Conversations are rebuilt first: the first h turns of the first
    of the family of FAMILY, then the own ones after the first h.  An empty table gives no nodes.
    A node whose members are a large part of all rows is counted before the shuffle; joins on such a
    parent are left to the planner's skew handling, and the root, everyone's parent, is no join key.
    """
    convs, turns = placed(conversations)
    chain = chains(rebuilt(convs, turns))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("size").alias("deepest")).first()
    first = lambda *cs: [F.first(c).alias(c) for c in cs]
    nodes = chain.groupBy("a", "b").agg(*first("depth", "tokens", "pa", "pb", "up"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    top = top.selectExpr("0L AS a", "0L AS b", "0L AS depth", "0 AS tokens", "cast(null AS long) AS pa", "cast(null AS long) AS pb", "cast(array() AS array<struct<a: bigint, b: bigint>>) AS up", "conv_id", "n_convs")
    nodes = written(nodes.union(top), "prefixes")
    children = nodes.where("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("tokens")
    nodes = written(nodes.withColumns({"n_leaves": leaf, "saved_tokens": saved}), "nodes")
    totals = rolled_up(nodes, chain, root["deepest"] or 0)
    ends = chain.where("last").select("a", "b", "conv_id").union(convs.where("size = 0").select(F.lit(0).cast("long"), F.lit(0).cast("long"), "conv_id"))
    parents = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    deep = nodes.where("depth > 1").join(parents, ["pa", "pb"])
    shown = ["a", "b", "conv_id", "depth", "n_convs", "n_children"]
    near = F.when(F.col("depth") == 1, F.lit(root["conv_id"])).cast("long")
    out = deep.select(*shown, "parent_conv_id").union(nodes.where("depth <= 1").select(*shown, near))
    out = out.join(totals, ["a", "b"]).join(end_digests(ends), ["a", "b"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *SUMS, F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
