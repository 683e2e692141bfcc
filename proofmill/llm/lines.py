"""Line dedup by a log-template tree of fixed depth.

A line's tokens that hold a digit are variable fields.  The tree has one leaf for each token count
and leading tokens.  A leaf holds many clusters: a masked line as it stands is one, and the tokens
after the leading ones, cut into BANDS runs of places, give one for each pair of runs left open, so
lines that differ inside any two runs meet under one key whatever else the leaf holds.  A cluster met
in ``min_docs`` different documents is a template that recurs, and its lines are dropped from every
document.

What counts as a different document: exact copies count once, and a document speaks for a cluster
only if lines of its own (of no cluster met so often) make up half of what it holds beside that
cluster, or if no more than FEW of its lines recur, as on a page with a menu and a footer.  So near
copies of one document do not make templates of its text, yet lose the templates that other
documents show to be such.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, opaque, text_of, words_of, written

MIN_DOCS = 10
#: Leading tokens that name a leaf, beside the token count.
DEPTH = 3
#: Runs of places behind the leading tokens; two of them are left open, so 0.6 of the places stand fast.
BANDS = 5
#: Recurring lines of a document that are no more than boilerplate, however short its own text.
FEW = 2
#: Shortest line, in tokens, of which places are left open.
LEAST = 5
FIELD = "<*>"
_BANDS = [f"b{a}" for a in range(BANDS)]


def tokens_of(line: Column) -> Column:
    masked = F.transform(words_of(line), lambda t: F.when(t.rlike("[0-9]"), F.lit(FIELD)).otherwise(t))
    return F.when(line.rlike("[0-9]"), masked).otherwise(words_of(line))


def line_rows(docs: DataFrame) -> DataFrame:
    """One row per line that has a word: doc_id, key (hash of the text), at, n, leaf, tmpl and a hash of each run; no text."""
    text = text_of()
    rows = docs.select("doc_id", F.xxhash64(text).alias("key"), F.posexplode_outer(F.split(text, "\n")).alias("at", "line"))
    rows = rows.where(F.col("line").rlike("[^\\t-\\r ]")).select("doc_id", "key", "at", tokens_of(F.col("line")).alias("tokens"))
    rest = F.greatest(F.size("tokens") - DEPTH, F.lit(0))
    start = lambda a: F.floor((a * rest + (BANDS - 1)) / BANDS).cast("int")
    runs = [F.xxhash64(F.slice("tokens", DEPTH + 1 + start(a), start(a + 1) - start(a))).alias(b) for a, b in enumerate(_BANDS)]
    rows = rows.select("doc_id", "key", "at", F.size("tokens").alias("n"), F.xxhash64(F.size("tokens"), F.slice("tokens", 1, DEPTH)).alias("leaf"), *runs)
    return rows.select("doc_id", "key", "at", "n", "leaf", F.xxhash64("leaf", *_BANDS).alias("tmpl"), *_BANDS)


def speaking(clusters: DataFrame, words: DataFrame, min_docs: int) -> DataFrame:
    """Of ``clusters(c, key, w)``, w the words of key's lines in c: the c that enough documents speak for.  ``words(key, total, own, others)``."""
    beside = F.col("total") - F.col("w")
    speak = clusters.join(words, "key").where((F.col("own") > 0) & ((2 * F.col("own") >= beside) | (F.col("others") <= FEW)))
    return speak.groupBy("c").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs).select("c")


def recurring_templates(rows: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Names of the masked lines to drop, (tmpl); ``rows`` is ``line_rows(docs)``, written.

    64-bit names only.  Every step counts by key with partial sums; no set of a leaf is gathered.
    """
    slim = rows.select("key", "tmpl", "leaf", "n").distinct()
    counts = written(slim.groupBy("tmpl", "leaf").agg(F.count("*").alias("docs")), "line-counts")
    often = counts.where(F.col("docs") >= min_docs).select("tmpl")
    rare = counts.where(F.col("docs") < min_docs)
    # leaves in which lines differ, yet enough documents meet
    leaves = rare.groupBy("leaf").agg(F.sum("docs").alias("d"), F.count("*").alias("t")).where((F.col("d") >= min_docs) & (F.col("t") > 1)).select("leaf")
    loose = rows.where(F.col("n") >= LEAST).join(written(leaves, "leaves"), "leaf", "left_semi").join(often, "tmpl", "left_anti")
    loose = loose.select("key", "tmpl", "n", "leaf", *_BANDS).distinct()
    opened = [F.xxhash64("leaf", F.lit(BANDS * a + b), *[x for i, x in enumerate(_BANDS) if i not in (a, b)]) for a, b in combinations(range(BANDS), 2)]
    clusters = written(loose.select("key", "tmpl", "n", F.explode_outer(F.array_distinct(F.array(*opened))).alias("c")), "line-clusters")
    met = clusters.select("c", "key").distinct().groupBy("c").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs).select("c")
    clusters = written(clusters.join(met, "c", "left_semi"), "line-clusters-met")
    # words of each document in lines of its own
    exact = written(slim.join(often, "tmpl", "left_semi").select(F.col("tmpl").alias("c"), "key", F.col("n").alias("w")), "line-exact")
    shared = exact.select("key", F.col("c").alias("tmpl"), F.col("w").alias("n")).union(clusters.select("key", "tmpl", "n")).distinct()
    shared = shared.groupBy("key").agg(F.sum("n").alias("shared"), F.count("*").alias("others"))
    words = slim.groupBy("key").agg(F.sum("n").alias("total")).join(shared, "key").select("key", "total", "others", (F.col("total") - F.col("shared")).alias("own"))
    words = written(words, "line-words")
    one = speaking(exact, words, min_docs).select(F.col("c").alias("tmpl"))
    many = speaking(clusters.groupBy("c", "key").agg(F.sum("n").alias("w")), words, min_docs)
    return one.union(clusters.join(many, "c", "left_semi").select("tmpl")).distinct()


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc (the row as it came), n_lines, n_dropped, kept_text.

    n_lines counts all ``\\n``-separated lines, n_dropped those of a recurring template, which are gone
    from kept_text.  Null text stays null (no line); blank lines are never templates and stay; rows
    that repeat a doc_id each get their row, with equal texts counted once; a document whose lines all
    recur keeps an empty text; the input's other columns, whatever their names, are in doc; an empty
    table gives none.  Lines and texts may be of any length: a task holds one document's at a time.
    """
    rows = written(line_rows(docs.select("doc_id", "text")), "lines")
    drop = written(recurring_templates(rows, min_docs), "recurring")
    hits = rows.join(drop, "tmpl", "left_semi").select("doc_id", "key", "at").distinct()
    hits = written(hits.groupBy("doc_id", "key").agg(F.sort_array(F.collect_list("at")).alias("at")), "line-hits")
    own = carried(docs)
    joined = own.join(hits.hint("merge"), F.col("doc.doc_id").eqNullSafe(hits["doc_id"]) & (F.xxhash64(text_of("doc.text")) == hits["key"]), "left")
    # lines between dropped ones, run by run
    cut = opaque(joined.select("doc", "at", F.split("doc.text", "\n").alias("lines")))
    cut = opaque(cut.select("doc", "lines", F.when(F.col("at").isNotNull(), F.concat(F.array(F.lit(-1)), F.col("at"), F.array(F.size("lines")))).alias("ends")))
    between = F.transform("ends", lambda e, j: F.slice("lines", e + 2, F.greatest(F.coalesce(F.get("ends", j + 1) - e - 1, F.lit(0)), F.lit(0))))
    kept = F.when(F.col("ends").isNull(), F.col("doc.text")).otherwise(F.array_join(F.flatten(between), "\n"))
    out = cut.select("doc", F.greatest(F.coalesce(F.size("lines"), F.lit(0)), F.lit(0)).cast("long").alias("n_lines"), F.greatest(F.coalesce(F.size("ends") - 2, F.lit(0)), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"))
    return opaque(out)
