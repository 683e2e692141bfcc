"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_dir, written  # noqa: F401

#: Fixed value: runs of the six characters that separate words, as a pattern.
WHITE = "[\\t-\\r ]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order."""
    return F.array_remove(F.split(text, WHITE), "")


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality on ``keys``."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def carried(docs: DataFrame) -> DataFrame:
    """``docs`` as one struct column, doc, so that no name of its columns meets an operator's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))


def opaque(df: DataFrame) -> DataFrame:
    """The same rows behind a generator.  A filter put on top stays there: pushed below, it would
    repeat the expressions of its columns, and those of array functions once per element."""
    return df.select(F.inline_outer(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def hash_filter(hashes: DataFrame, longs: int):
    """A cheap test for 64-bit hashes that may be among ``hashes(h)``: a bit table of ``longs`` 64-bit words.

    The table's size is fixed whatever the input; it has no false negatives, and an exact join follows.
    """
    place = lambda h: F.pmod(h, F.lit(longs)).cast("int")
    bit = lambda h: F.pmod(F.shiftright(h, 13), F.lit(64)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("h")))
    table = [0] * longs
    for r in hashes.groupBy(place(F.col("h")).alias("at")).agg(F.bit_or(one).alias("bits")).collect():
        table[r["at"]] = r["bits"]
    literal = F.from_json(F.lit(str(table)), "array<bigint>")
    return lambda h: F.getbit(F.get(literal, place(h)), bit(h)) == 1


def components(edges: DataFrame, name: str, max_rounds: int = 40) -> DataFrame:
    """Connected components of ``edges(a, b)`` (bigint): rows ``(node, root)``, root the least node.

    Alternates large-star and small-star (Kiverris et al., "Connected components in MapReduce and
    beyond"); each round is written to the shared folder, and the number of rounds grows with the
    logarithm of the longest path.  Nodes without an edge are not returned.
    """
    pairs = edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct()
    cur = written(pairs, f"{name}-cc")
    before = None
    for _ in range(max_rounds):
        both = cur.union(cur.selectExpr("b AS a", "a AS b"))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        # large star: neighbours above the node point at the least of the neighbourhood and the node
        large = both.join(low, "a").where("b > a").selectExpr("b AS a", "least(a, m) AS b").distinct()
        # small star: the node and its neighbours below it point at the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        nxt = small.where("b <> m").selectExpr("b AS a", "m AS b").union(least.selectExpr("a", "m AS b")).distinct()
        cur = written(nxt, f"{name}-cc")
        now = cur.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if before is not None and tuple(now) == before:
            return cur.selectExpr("a AS node", "b AS root").union(cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = tuple(now)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
