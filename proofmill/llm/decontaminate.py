"""Benchmark decontamination as a prefix-filtered set join.

Every benchmark window (13 words, or the whole of a shorter item) is a set of short shingles.  Its
shingles are ordered by rarity in the corpus; as the whole window must be contained, the rarest
one alone is a sufficient prefix.  Document shingles join those prefixes, the offset of the shingle
in the window gives the only place where it can start, bounds discard places outside the document,
and the words from there on are compared with the window's words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_filter, same, text_of, written

WINDOW = 13
#: Words in a shingle; shorter items use shingles as long as they are.
SHINGLE = 3
#: 64-bit words of the bit table that thins document shingles before the exact join: one for PER benchmark
#: shingles (16 bits each, so one in 16 others passes), between LEAST and MOST; beyond MOST more pass, to the same join.
PER, LEAST, MOST = 4, 4096, 1 << 18
#: Fixed value: every ASCII character that is neither digit nor letter separates words.
_SEPARATE = "[\\x00-/:-@\\[-`{-\\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def bench_words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z only."""
    cut = lambda t: F.array_remove(F.split(t, _SEPARATE), "")
    ascii_ = lambda t: F.octet_length(t) == F.length(t)  # noqa: E731  there lower() is cheap and changes A-Z only
    mixed = F.transform(cut(text), lambda w: F.when(ascii_(w), F.lower(w)).otherwise(F.translate(w, _UPPER, _UPPER.lower())))
    return F.when(ascii_(text), cut(F.lower(text))).otherwise(mixed)


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, _SEPARATE), "")).cast("long")


def shingles(words: Column, k: int) -> Column:
    """64-bit hashes of each run of ``k`` words, in order of their start."""
    at = F.slice(words, 1, F.greatest(F.size(words) - (k - 1), F.lit(0)))
    return F.transform(at, lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, k)]))


def windows_of(bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: (win, words, len, items), items the sorted ids of items that have it."""
    rows = bench.select("item_id", bench_words(text_of()).alias("_w")).where(F.size("_w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - (window - 1), F.lit(1)))
    rows = rows.select("item_id", "_w", F.explode(starts).alias("at")).select("item_id", F.slice("_w", F.col("at"), F.lit(window)).alias("words"))
    return rows.groupBy("words").agg(F.collect_set("item_id").alias("items")).select(F.xxhash64("words").alias("win"), "words", F.size("words").alias("len"), "items")


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: n_words, n_hit, n_items, items (sorted ids as text), contaminated.

    A document is contaminated when n_hit > 0 and 20 * n_hit >= n_words, a tie included.  Null or empty
    text has no words, an empty benchmark hits nothing, null item ids and texts without words are
    ignored, items of equal text are hit together.  Rows that repeat a doc_id, or have none, each get
    their row, judged by their own text; other columns of either table are not read; an empty table
    gives none.  A text of any length is one row of a task; what it shares with the benchmark is its
    places there, at most one for each window and word.
    """
    windows = written(windows_of(bench.where("item_id is not null").select("item_id", "text"), window), "windows")
    sizes = sorted({min(r["len"], SHINGLE) for r in windows.select("len").distinct().collect()})
    own = docs.select("doc_id", text_of().alias("text")).withColumn("key", F.xxhash64("text"))
    base = own.select("doc_id", "key", n_words(F.col("text")).alias("n_words"))
    if not sizes:
        hits = docs.sparkSession.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key long, n_hit long, items array<string>")
        return _finish(base, hits)
    bench_sh = reduce(DataFrame.union, [windows.where(F.least("len", F.lit(SHINGLE)) == k).select("win", "len", F.posexplode_outer(shingles(F.col("words"), k)).alias("off", "sh"), F.lit(k).alias("k")) for k in sizes])
    vocab = written(bench_sh.select("k", "sh").distinct(), "shingles")
    met_maybe = hash_filter(vocab.select(F.col("sh").alias("h")), min(MOST, max(LEAST, vocab.count() // PER)))
    maybe = lambda p: met_maybe(p["sh"])

    # one pass over the documents: the places where a shingle of the benchmark stands
    rows = own.select("doc_id", "key", bench_words(F.col("text")).alias("_w")).withColumn("n", F.size("_w"))
    for k in sizes:
        placed = F.transform(shingles(F.col("_w"), k), lambda s, i: F.struct(i.alias("pos"), s.alias("sh")))
        rows = rows.withColumn(f"_{k}", F.transform(F.filter(placed, maybe), _with_size(k)))
    met = rows.select("doc_id", "key", "n", F.inline_outer(F.concat(*[F.col(f"_{k}") for k in sizes]))).where("sh is not null")
    met = written(met.join(vocab, ["k", "sh"], "left_semi"), "met")
    # rarity: corpus frequency of each shingle; the rarest of a window is its prefix
    seen = met.groupBy("k", "sh").agg(F.count("*").alias("df"))
    order = F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("sh"), F.col("off"))
    rarest = bench_sh.join(seen, ["k", "sh"], "left").groupBy("win", "len", "k").agg(F.min(order).alias("p"))
    prefix = written(rarest.where("p.df > 0").select("k", F.col("p.sh").alias("sh"), F.col("p.off").alias("off"), "win", "len"), "prefix")
    # candidates: the prefix fixes the start; length and position bound it
    found = met.join(prefix, ["k", "sh"]).withColumn("start", F.col("pos") - F.col("off")).where("start >= 0 and start + len <= n")
    places = written(found.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "win")).alias("places")), "places")
    # verification: the words from the start on are the window's words
    check = own.join(places.hint("merge"), same(own, places, ["doc_id", "key"])).select(own["doc_id"], own["key"], "text", "places").dropDuplicates(["doc_id", "key"])
    check = check.select("doc_id", "key", bench_words(F.col("text")).alias("_w"), "places")
    have = F.transform("places", lambda p: F.struct(p["start"].alias("start"), p["win"].alias("win"), F.slice(F.col("_w"), p["start"] + 1, F.lit(window)).alias("have")))
    check = check.select("doc_id", "key", F.inline_outer(have))
    true = check.join(windows, "win").where(F.slice("have", F.lit(1), F.col("len")) == F.col("words"))
    hits = true.groupBy("doc_id", "key").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence("start", F.col("start") + F.col("len") - 1))))).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.transform(F.flatten(F.collect_set("items")), lambda i: i.cast("string")))).alias("items"),
    )
    return _finish(base, written(hits, "hits"))


def _with_size(k: int):
    return lambda p: F.struct(F.lit(k).alias("k"), p["pos"].alias("pos"), p["sh"].alias("sh"))


def _finish(base: DataFrame, hits: DataFrame) -> DataFrame:
    items = F.coalesce("items", F.array().cast("array<string>"))
    out = base.join(hits, same(base, hits, ["doc_id", "key"]), "left").select(base["doc_id"], "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
