"""Quality rules: counted base rules, then a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed n-grams (each word, each pair of neighbouring words,
and the last three characters of each word): a trusted target (labelled documents of good quality)
and the raw corpus (all documents).  A document's mean log ratio decides against a fixed threshold,
so every document gets its verdict by the same rule.  All steps are DataFrame expressions; no Python
runs on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, opaque, text_of, words_of

#: Fixed value: characters counted as symbols, as a pattern.
SYMBOLS = "[#*$%&|<>]"
#: Number of buckets of the two multinomials; bounds what the driver holds.
BUCKETS = 32_768
#: Bound on the labelled rows of the trusted target (the least by hash of doc_id).
MAX_TRUSTED = 20_000
#: A document passes when its mean log ratio is at least this.
MIN_SCORE = -0.5
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def hashed_words(rows: DataFrame, text: Column) -> DataFrame:
    """Adds words, and x and e: 64-bit hashes of each word and of its last three characters."""
    rows = rows.withColumn("words", words_of(text))
    return rows.withColumn("x", F.transform("words", lambda w: F.xxhash64(w))).withColumn("e", F.transform("words", lambda w: F.xxhash64(F.right(w, F.lit(3)))))


def with_base(rows: DataFrame, text: Column) -> DataFrame:
    """Adds the BASE counts (bigint) and base_failed to rows with words and x.

    Repeated windows are found inside the row: sorted 64-bit hashes of the 3-word windows with their
    positions, equal neighbours, then the distinct positions they cover.
    """
    lines = F.filter(F.split(text, "\n"), lambda v: v.rlike("[^\\t-\\r ]"))
    # a window's name is a hash of its three words' hashes
    three = F.transform(F.slice("x", 1, F.greatest(F.size("x") - 2, F.lit(0))), lambda h, i: F.xxhash64(h, F.get("x", i + 1), F.get("x", i + 2)))
    rows = rows.withColumn("lines", lines).withColumn("h", three).withColumn("again", F.size(F.array_distinct("h")) < F.size("h"))
    rows = rows.withColumn("s", F.when(F.col("again"), F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    places = F.filter(
        F.sequence(F.lit(1), F.size("s")),
        lambda j: (F.try_element_at("s", j + 1)["h"] == F.element_at("s", j)["h"])
        | F.coalesce(F.when(j > 1, F.try_element_at("s", F.greatest(j - 1, F.lit(1)))["h"] == F.element_at("s", j)["h"]), F.lit(False)),
    )
    rows = rows.withColumn("p", F.when(F.col("again"), F.transform(places, lambda j: F.element_at("s", j)["i"])))
    covered = F.size(F.array_distinct(F.flatten(F.transform("p", lambda i: F.array(i, i + 1, i + 2)))))
    rows = (
        rows.withColumn("n_words", F.size("words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
        .withColumn("n_symbols", (F.size(F.split(text, SYMBOLS)) - 1).cast("long"))
        .withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
        .withColumn("n_repeat_words", F.when(F.col("again"), covered).otherwise(0).cast("long"))
        .drop("lines", "h", "again", "s", "p")
    )
    return rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def buckets(word: Column, end: Column, following: Column, n: int) -> list[Column]:
    """Buckets of a word, its end, and it with the next word, from the hashes of these; the last is null at the end of a text."""
    bucket = lambda c: F.pmod(c, F.lit(n)).cast("int")
    return [bucket(word), bucket(end), F.when(following.isNotNull(), bucket(F.xxhash64(word, following)))]


def beside(words: str) -> Column:
    """The words from the second one on, so that each stands beside the one before it."""
    return F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))


def log_ratios(docs: DataFrame, labels: DataFrame, n: int = BUCKETS, max_trusted: int = MAX_TRUSTED) -> list[float]:
    """Log of (target share / raw share) of each bucket, add-one smoothed over all buckets.

    The raw counts cover every document.  The target is documents labelled quality 1, at most
    ``max_trusted`` of them, so its id list is safe to broadcast.  The result has ``n`` numbers,
    whatever the corpus; without labels all are 0 and the ratio decides nothing.
    """
    trusted = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted)
    rows = docs.select("doc_id", "text").join(F.broadcast(trusted.withColumn("trusted", F.lit(1))), "doc_id", "left")
    # one row a word with the next one beside it, then three; partial sums leave n rows a task
    words = rows.select("trusted", words_of(text_of()).alias("w")).withColumn("y", beside("w")).select("trusted", F.inline_outer(F.arrays_zip("w", "y"))).where("w is not null")
    hashed = words.select("trusted", F.xxhash64("w").alias("h"), F.xxhash64(F.right("w", F.lit(3))).alias("e"), F.when(F.col("y").isNotNull(), F.xxhash64("y")).alias("y"))
    counts = hashed.select("trusted", F.stack(F.lit(3), *buckets(F.col("h"), F.col("e"), F.col("y"), n)).alias("b")).where("b is not null")
    counts = counts.groupBy("b").agg(F.count("*").alias("raw"), F.count("trusted").alias("good")).collect()
    raw, good = [0] * n, [0] * n
    for r in counts:
        raw[r["b"]], good[r["b"]] = r["raw"], r["good"]
    if not sum(good):
        return [0.0] * n
    a, b = sum(good) + n, sum(raw) + n
    return [round(math.log((g + 1) / a) - math.log((r + 1) / b), 6) for g, r in zip(good, raw, strict=True)]


def llr(ratios: list[float]) -> Column:
    """Mean log ratio over the n-grams of rows with x, e and y (x from the second on), 0 for a text without words."""
    table = F.from_json(F.lit("[" + ",".join(map(str, ratios)) + "]"), "array<double>")

    def add(total: Column, v: Column) -> Column:
        word, end, pair = buckets(v["x"], v["e"], v["y"], len(ratios))
        return total + (F.get(table, word) + F.get(table, end) + F.coalesce(F.get(table, pair), F.lit(0.0)))

    total = F.aggregate(F.arrays_zip("x", "e", "y"), F.lit(0.0), add)
    return F.round(F.coalesce(total / F.nullif(3 * F.size("x") - 1, F.lit(-1)), F.lit(0.0)), 6)


def base_counts(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc (the row as it came), the BASE counts and base_failed."""
    text = text_of("doc.text")
    return with_base(hashed_words(carried(docs), text), text).select("doc", *BASE, "base_failed")


def quality_rules(docs: DataFrame, labels: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc (the row as it came), the BASE counts, base_failed, llr, kept.

    kept is false where a base rule fails, else llr >= min_score (a tie is kept).  Null or empty text:
    no words, so rejected.  Equal texts get equal verdicts whatever their doc_id, repeated or null; a
    label that repeats counts once; the input's other columns, whatever their names, are in doc; an
    empty table gives none.  A text of any length is one row of one task.
    """
    ratios = log_ratios(docs, labels)
    text = text_of("doc.text")
    rows = with_base(hashed_words(carried(docs), text), text).withColumn("y", beside("x")).withColumn("llr", llr(ratios))
    return opaque(rows.select("doc", *BASE, "base_failed", "llr", (~F.col("base_failed") & (F.col("llr") >= min_score)).alias("kept")))
