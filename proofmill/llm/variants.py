"""Spelling variants: words one edit apart, found through pivotal bigrams.

Bigrams are ordered by how few words hold them.  A word's gram prefix is its three rarest bigrams
(and every other place of the third), and its pivots are two of these that share no letter, the
cheapest pair by dynamic programming.  One edit touches at most one pivot, so of two words a single
edit apart, the one whose prefix ends earlier in the order has a pivot that stands unharmed in the
prefix of the other.  What lies on one side of that pivot, and the pivot itself, is then equal in
both words: the position limit says from which end the pivot's place is the same, and the join is on
the equal side.  Where that side is short, the join also takes the WINDOW letters beyond the pivot,
or, if the edit is within these, all that follows them.  Every pair met is verified.

A bigram may stand at very many places of a very long run, so words of more than LONG letters are
joined by halves instead: one edit leaves the first or the last half of the shorter word whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

#: Which runs are words, and which letters are lower-cased.
LETTERS, LARGE, SMALL = "[A-Za-z\u00C0-\u00FF]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST, TWICE, MUCH = 7, 2, 10
#: Letters of an equal side that make a key by themselves, and letters taken beyond a shorter one.
STRONG, WINDOW = 6, 3
#: Letters of a word up to which bigrams find its partners.
LONG = 64


def spellings(docs: DataFrame) -> DataFrame:
    """Words and how often they occur; every 31st occurrence, by checksum, has lost a letter.

    A run shorter than LEAST cannot become a word and is not read.
    """
    run = F.translate("run", LARGE, SMALL)
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(text_of(), F.lit(f"{LETTERS}{{{LEAST},}}"), 0)).alias("run")).select("doc_id", run.alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary"))
    rows = runs.select("run", h.alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    word = F.when(F.pmod("h", F.lit(31)) == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return rows.select(word.alias("word")).where(F.length("word") >= LEAST).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= TWICE)


def cheapest_pair(places: list[int], costs: list[int]) -> tuple[int, int]:
    """Two places at least two apart with the least sum of costs; ``places`` ascend."""
    best, single, ahead = None, None, 0
    for place, cost in zip(places, costs, strict=True):
        while places[ahead] <= place - 2:
            single = min(x for x in (single, (costs[ahead], places[ahead])) if x)
            ahead += 1
        if single:
            best = min(x for x in (best, (single[0] + cost, single[1], place)) if x)
    return best[1:]


def grams_of(words: DataFrame) -> DataFrame:
    """Per word its gram prefix (places), its pivots (places) and the order of the prefix's last gram.

    The order of bigrams goes to every task: there are at most 90 letters, so at most 8,100 of them.
    """
    each = words.select(F.explode(F.expr("transform(sequence(1, length(word) - 1), i -> substring(word, i, 2))")).alias("gram"))
    counts = {r["gram"]: r["n"] for r in each.groupBy("gram").agg(F.count("*").alias("n")).collect()}
    order = {gram: i for i, (_, gram) in enumerate(sorted((n, gram) for gram, n in counts.items()))}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for word in pdf["word"]:
                grams = [order[word[i : i + 2]] for i in range(len(word) - 1)]
                last = sorted(grams)[2]
                prefix = [i for i, g in enumerate(grams) if g <= last]
                out.append((prefix, cheapest_pair(prefix, [counts[word[i : i + 2]] for i in prefix]), last))
            yield pdf.assign(prefix=[x[0] for x in out], pivots=[list(x[1]) for x in out], last=[x[2] for x in out])

    return words.mapInPandas(run, "word string, n long, prefix array<int>, pivots array<int>, last int")


def side_keys(probe: bool) -> Column:
    """Hashes of what must be equal, for the gram at place ``at`` of ``word``; 64 bits, as pairs are verified."""
    word, at, size = F.col("word"), F.col("at"), F.length("word")
    head, tail = (lambda n: F.substring(word, F.lit(1), F.greatest(n, F.lit(0)))), (lambda n: F.right(word, F.greatest(n, F.lit(0))))
    # an insertion or deletion inside the window moves what follows by one place in the partner
    moves = [F.lit(0)] if probe else [F.lit(-1), F.lit(0), F.lit(1)]
    name = lambda kind, *parts: F.xxhash64(F.lit(kind), *parts)
    left, right = at + 2, size - at
    by_left = F.when(left >= STRONG, F.array(name("left", head(left)))).otherwise(
        F.array(name("left on", head(left + WINDOW)), *[name("left past", head(left), tail(size - left - WINDOW + m)) for m in moves])
    )
    by_right = F.when(right >= STRONG, F.array(name("right", tail(right)))).otherwise(
        F.array(name("right on", tail(right + WINDOW)), *[name("right past", tail(right), head(at - WINDOW + m)) for m in moves])
    )
    return F.concat(by_left, by_right)


def half_keys() -> Column:
    """Hashes of the first and last half that a word shares with a partner as long, one letter longer or shorter."""
    word, size = F.col("word"), F.length("word")
    sizes = [(size, size), (size, size + 1), (size - 1, size)]
    half = lambda n: F.floor(n / 2).cast("int")
    return F.array(*[F.xxhash64(F.lit(side), short, long, part(half(short))) for short, long in sizes for side, part in (("first", lambda n: F.substring(word, F.lit(1), n)), ("last", lambda n: F.right(word, n)))])


def near_words(words: DataFrame) -> DataFrame:
    """Rows (word, near, near_n), both ways, of all ``words(word, n)`` exactly one edit apart."""
    grams = written(grams_of(words.where(F.length("word") <= LONG)), "grams")
    keyed = lambda places, probe: grams.select("word", "n", "last", F.explode(places).alias("at")).select("word", "n", "last", F.explode(side_keys(probe)).alias("key"))
    halves = words.where(F.length("word") >= LONG).select("word", "n", F.lit(0).alias("last"), F.explode(half_keys()).alias("key"))
    met = []
    for x, y in ((keyed("pivots", True), keyed("prefix", False)), (halves, halves)):
        both = x.alias("x").join(y.alias("y"), "key").where("x.last <= y.last AND x.word <> y.word AND levenshtein(x.word, y.word, 1) = 1")
        met.append(both.select(F.col("x.word").alias("w"), F.col("x.n").alias("n"), F.col("y.word").alias("v"), F.col("y.n").alias("m")))
    ways = F.array(F.struct(F.col("w").alias("word"), F.col("v").alias("near"), F.col("m").alias("near_n")), F.struct(F.col("v").alias("word"), F.col("w").alias("near"), F.col("n").alias("near_n")))
    return met[0].union(met[1]).select(F.inline(ways)).distinct()


def roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, root) of ``forms(word, form)``: each step takes what a word's root leads to.  Counts grow
    MUCH-fold with each link, so a chain up to count ``most`` has few links, and the steps double."""
    links = len(str(most))
    forms = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(links - 1, 0).bit_length()):
        onward = forms.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        forms = written(forms.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root")), "roots")
    return forms


def variant_groups(docs: DataFrame) -> DataFrame:
    """Words of ``docs(doc_id, text)`` with their form (the most frequent word one edit away, if at least
    MUCH times as frequent; of equal ones the first in code-point order), root, n, n_near and form_n.

    A null or empty text has no words; a null doc_id counts as an empty one in the checksum; rows that
    repeat a doc_id each count; other columns are not read; an empty table gives none.  Words of any
    length are whole, and a task holds a few.  Frequent words and runs are counted before the shuffle; a key that many words
    share is split by the planner's skew join.  Words that share a rare pivot and a whole side of it
    are compared with each other, whatever their number.
    """
    words = written(spellings(docs), "words")
    near = written(near_words(words), "near-words")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    out = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.m")).alias("near_n"))
    is_form = F.col("near_n") >= MUCH * F.col("n")
    out = written(out.select("word", "n", "n_near", F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")), "forms")
    most = words.agg(F.max("n")).first()[0] or 0
    return out.join(roots(out.where("form is not null"), most), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
