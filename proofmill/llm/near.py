"""MinHash near-dedup: ProbMinHash sketches, banding, exact verification, classes.

Sketch: every 5-word shingle of a document is a Poisson process whose rate is the shingle's weight
(1 + log2 of its count); its arrivals land in random slots, each slot keeps the shingle that came
first, and a shingle stops as soon as its next arrival is later than the latest slot.  Two sketches
agree in a slot with the probability Jaccard of the weighted sets.  Banding makes candidates;
shared buckets join texts into coarse clusters with one edge per row, never all pairs.
Verification is exact (set Jaccard of 5-word shingles) and reports connected classes, not pairs.  A
cluster is cut into blocks; each block is compared within itself and with a few pivots of its
cluster, work that grows with the cluster.  What the pivots hold together needs no more; only texts
outside a cluster's main class then meet the other blocks, so no link in a cluster is lost.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, text_of, written

WORDS = 5
THRESHOLD = (4, 5)  # 0.8 as a fraction
BANDS, ROWS = 24, 5
#: Texts, and bytes of text, in a block of a cluster, on average; a task compares at most two blocks.
BLOCK, BLOCK_BYTES = 1024, 32 << 20
#: Pivots of a cluster of several blocks, on average.
PIVOTS = 16
#: Texts, and bytes of text, of small clusters that share one verification task, on average.
SHARED, SHARED_BYTES = 400, 8 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_FACTORS = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit numbers (a public finaliser of xorshift and multiply steps)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit names of all 5-word shingles of some texts, and the text each belongs to, in order.

    A text of one to four words has one shingle, all its words; a text without words has none.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", dtype=np.uint8)
    white = _WHITE[data]
    start = np.flatnonzero(white[:-1] & ~white[1:]) + 1
    end = np.flatnonzero(~white[:-1] & white[1:]) + 1
    power = np.full(len(data) + 1, _BASE, dtype=np.uint64)
    power[0] = 1
    np.cumprod(power, out=power)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
    # what a word's bytes add to the running sum, moved to the same power, does not depend on its place
    inverse = np.full(len(data) + 1, _INV, dtype=np.uint64)
    inverse[0] = 1
    np.cumprod(inverse, out=inverse)
    word = mix((total[end] - total[start]) * inverse[start])
    offset = np.cumsum([1] + [len(r) + 1 for r in raw])
    doc = np.searchsorted(offset, start, side="right") - 1
    n = len(word)
    size = np.bincount(doc, minlength=len(texts))
    first = np.r_[0, np.cumsum(size)[:-1]]
    place = np.arange(n) - first[doc]
    take = (place <= size[doc] - WORDS) | ((place == 0) & (size[doc] < WORDS))
    at = np.flatnonzero(take)
    out = np.zeros(len(at), dtype=np.uint64)
    for j, f in enumerate(_FACTORS):
        here = np.minimum(at + j, n - 1)
        inside = place[at] + j < size[doc[at]]
        out += np.where(inside, word[here] * f, np.uint64(j))
    return mix(out), doc[at]


def sketch(texts: list[str], slots: int = BANDS * ROWS) -> tuple[np.ndarray, np.ndarray]:
    """ProbMinHash sketches (texts x slots, names of shingles) and the number of shingles of each text."""
    name, doc = shingles(texts)
    # 20 bits for the text, 44 for the shingle: one sort gives distinct shingles and their counts
    packed, count = np.unique((doc.astype(np.uint64) << np.uint64(44)) | (name >> np.uint64(20)), return_counts=True)
    item, doc = packed & np.uint64((1 << 44) - 1), (packed >> np.uint64(44)).astype(np.int64)
    rate, when = 1.0 + np.log2(count), np.zeros(len(item))
    first = np.full(len(texts) * slots, np.inf)
    held = np.zeros(len(texts) * slots, dtype=np.uint64)
    sizes = np.bincount(doc, minlength=len(texts))
    step = 0
    while len(item):
        step += 1
        draw = mix(item + np.uint64((step * int(_BASE)) % (1 << 64)))
        when = when - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / rate
        slot = doc * slots + (mix(draw) % np.uint64(slots)).astype(np.int64)
        np.minimum.at(first, slot, when)
        won = first[slot] == when
        held[slot[won]] = item[won]
        latest = first.reshape(len(texts), slots).max(axis=1)
        live = when < latest[doc]  # early end: later arrivals cannot win
        item, doc, rate, when = item[live], doc[live], rate[live], when[live]
    return held.reshape(len(texts), slots), sizes


def band_names(held: np.ndarray) -> np.ndarray:
    parts = held.reshape(len(held), BANDS, ROWS)
    out = np.zeros((len(held), BANDS), dtype=np.uint64)
    for j in range(ROWS):
        out = mix(out * _BASE + parts[:, :, j] + np.arange(BANDS, dtype=np.uint64) * _FACTORS[0])
    return out.view(np.int64)


def chunks(frames, chars: int = 2_000_000, rows: int = 50_000):
    """Runs of rows with about ``chars`` characters of text; a longer text stands alone."""
    for pdf in frames:
        if len(pdf):
            run = np.maximum(pdf["text"].str.len().to_numpy().cumsum() // chars, np.arange(len(pdf)) // rows)
            for _, part in pdf.groupby(run, sort=True):
                yield part


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n, k1, k2, bands): hash and bytes of the text, a 128-bit name of its words, and the bands (null without words)."""

    def run(frames):
        for pdf in chunks(frames):
            held, sizes = sketch(pdf["text"].tolist())
            key = [hashlib.md5(b" ".join(t.encode("utf-8", "surrogatepass").split())).digest() for t in pdf["text"]]
            both = np.frombuffer(b"".join(key), dtype="<i8").reshape(-1, 2)
            bands = [b if n else None for b, n in zip(band_names(held), sizes, strict=True)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "h": pdf["h"].to_numpy(), "n": pdf["n"].to_numpy(), "k1": both[:, 0], "k2": both[:, 1], "bands": bands})

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.select("*", F.xxhash64("text").alias("h"), F.octet_length("text").cast("long").alias("n")).mapInPandas(run, "doc_id long, h long, n long, k1 long, k2 long, bands array<long>")


def linked(texts: list[str]) -> np.ndarray:
    """For each text the least index it is connected with over pairs of similarity >= 0.8, all pairs compared."""
    name, doc = shingles(texts)
    pair = np.unique(np.stack([doc.astype(np.uint64), name], axis=1), axis=0) if len(name) else np.zeros((0, 2), np.uint64)
    doc, name = pair[:, 0].astype(np.int64), pair[:, 1]
    size = np.bincount(doc, minlength=len(texts))
    _, column, often = np.unique(name, return_inverse=True, return_counts=True)
    shared = often[column] > 1
    doc, column = doc[shared], np.unique(column[shared], return_inverse=True)[1]
    common = np.zeros((len(texts), len(texts)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    width = 4096
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        some, row = np.unique(doc[a:b], return_inverse=True)
        x = np.zeros((len(some), width), dtype=np.float32)
        x[row, column[a:b] - lo] = 1.0
        common[np.ix_(some, some)] += x @ x.T
    both = common.astype(np.int64)
    near = THRESHOLD[1] * both >= THRESHOLD[0] * (size[:, None] + size[None, :] - both)
    near &= size[:, None] > 0
    root = np.arange(len(texts))
    while True:
        low = np.where(near, root[None, :], len(texts)).min(axis=1)
        low = np.minimum(low, root)
        low = low[low]
        if (low == root).all():
            return root
        root = low


def compared(docs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Links (a, b) between texts of one task and root; ``tasks(node, h, root, task)``, a node and h naming a text of ``docs``."""
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("node"), text_of().alias("text")).withColumn("h", F.xxhash64("text"))

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in pdf.groupby("root"):
            part = part.drop_duplicates(["node", "h"])
            ids = part["node"].to_numpy()
            out.append(pd.DataFrame({"a": ids, "b": ids[linked(part["text"].tolist())]}))
        return pd.concat(out)

    # merge: the same plan at every size
    return texts.join(tasks.hint("merge"), ["node", "h"]).groupBy("task").applyInPandas(verify, "a long, b long").where("a <> b")


def first_links(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Links inside each block of ``members(node, h, root, s, b)``, and between it and its cluster's pivots."""
    total = members.agg(F.count("*").alias("c"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    shared = max(1, total["c"] // SHARED, total["n"] // SHARED_BYTES)
    pivot = F.pmod(F.xxhash64("node", "h", F.lit("pivot")), F.ceil(F.col("m") / PIVOTS).cast("long")) == 0
    everywhere = members.where((F.col("s") > 1) & pivot).withColumn("b", F.explode_outer(F.sequence(F.lit(0), F.col("s") - 1)))
    task = F.when(F.col("s") == 1, F.pmod(F.xxhash64("root"), F.lit(shared))).otherwise(F.xxhash64("root", "b"))
    return compared(docs, members.union(everywhere).select("node", "h", "root", task.alias("task")))


def last_links(docs: DataFrame, members: DataFrame, classes: DataFrame) -> DataFrame:
    """Links that the first ones leave open: each text outside the main class of a cluster of several blocks against all its blocks."""
    own = members.where("s > 1").join(classes.withColumnRenamed("root", "class"), "node", "left").withColumn("class", F.coalesce("class", "node"))
    sizes = written(own.groupBy("root", "class").agg(F.count("*").alias("c"), F.sum("n").alias("n")), "class-sizes")
    blocks = lambda c, n: F.ceil(F.greatest(c / BLOCK, n / BLOCK_BYTES)).cast("int")
    main = sizes.groupBy("root").agg(F.max(F.struct("c", "class", "n")).alias("top"), F.sum("c").alias("c"), F.sum("n").alias("n")).where("c > top.c")
    main = main.select("root", F.col("top.class").alias("main"), blocks(F.col("top.c"), F.col("top.n")).alias("sm"), blocks(F.col("c") - F.col("top.c"), F.col("n") - F.col("top.n")).alias("sr"))
    own = own.join(written(main, "main-classes"), "root").withColumn("rest", F.col("class") != F.col("main"))
    mine = F.pmod(F.xxhash64("node", "h"), F.when(F.col("rest"), F.col("sr")).otherwise(F.col("sm"))).cast("int")
    own = own.withColumn("i", mine)
    other = F.sequence(F.lit(0), F.col("sr") - 1)
    rest_main = own.select("node", "h", "root", "rest", "i", F.explode_outer(F.when(F.col("rest"), F.sequence(F.lit(0), F.col("sm") - 1)).otherwise(other)).alias("j"))
    rest_main = rest_main.select("node", "h", "root", F.xxhash64("root", F.lit("main"), F.when(F.col("rest"), F.col("i")).otherwise(F.col("j")), F.when(F.col("rest"), F.col("j")).otherwise(F.col("i"))).alias("task"))
    rest_rest = own.where("rest").select("node", "h", "root", "i", F.explode_outer(other).alias("j")).select("node", "h", "root", F.xxhash64("root", F.lit("rest"), F.least("i", "j"), F.greatest("i", "j")).alias("task"))
    return compared(docs, rest_main.union(rest_rest))


def text_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, h, class_id) of each row with a doc_id; ``near_duplicates`` says what a class is."""
    own = written(sketches(docs), "sketches")
    # texts of the same words collapse to one row, named by its least doc_id, before anything is compared
    first = own.where("bands is not null").groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "h")).alias("f"))
    first = written(first.select("k1", "k2", F.col("f.doc_id").alias("node"), F.col("f.h").alias("h")), "firsts")
    named = written(own.select("doc_id", "h", "n", "k1", "k2").join(first.withColumnRenamed("h", "_h"), ["k1", "k2"], "left").select("doc_id", "h", "n", "k1", "node", (F.col("h") == F.col("_h")).alias("same")), "named")
    bands = own.join(first.select("k1", "k2", F.col("node").alias("doc_id"), "h"), ["k1", "k2", "doc_id", "h"], "left_semi").select("k1", F.explode_outer("bands").alias("band")).distinct()
    bands = written(bands, "bands")
    lows = bands.groupBy("band").agg(F.min("k1").alias("low"), F.max("k1").alias("high")).where("low < high").select("band", "low")
    # half a name tells texts apart here: a clash only makes a cluster larger
    coarse = components(bands.join(lows, "band").select(F.col("k1").alias("a"), F.col("low").alias("b")), "coarse")
    members = named.where("same and node = doc_id").select("node", "h", "n", "k1").distinct().join(coarse, named["k1"] == coarse["node"]).select(named["node"], "h", "n", "root")
    members = written(members, "clusters")
    sizes = members.groupBy("root").agg(F.count("*").alias("m"), F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_BYTES)).cast("int").alias("s"))
    members = written(members.join(sizes, "root").withColumn("b", F.pmod(F.xxhash64("node", "h"), F.col("s")).cast("int")), "members")
    # rows that repeat a doc_id with other texts hold these together
    several = named.where("node is not null").groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    repeats = named.join(several, "doc_id").select(F.col("node").alias("a"), F.col("low").alias("b"))
    links = written(first_links(docs, members).union(repeats), "links")
    classes = written(components(links, "classes"), "classes")
    if not members.where("s > 1").isEmpty():
        more = written(last_links(docs, members, classes), "links")
        classes = written(components(links.union(more), "classes"), "classes")
    return named.join(classes, "node", "left").select("doc_id", "h", F.coalesce("root", "node", "doc_id").alias("class_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id and class_id, the least doc_id of its class.

    Classes are the connected components of similarity >= 0.8 between 5-word shingle sets, a tie
    included; texts with the same words are one, a text of fewer than five words has one shingle, and
    rows that repeat a doc_id are in one class, with all that either text links to.  A null or empty
    text is its own class (that of its doc_id's other rows where it has some), a null doc_id has a null
    class; an empty table gives none.  Other columns are not read.  Texts may be of any length: tasks
    are cut by bytes as well as by number, and one text is never split.
    """
    classes = written(text_classes(docs), "text-classes")
    # a doc_id without words in one row and with words in another: one class
    own = classes.groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    out = classes.select("doc_id").join(own, "doc_id")
    return out.unionByName(docs.where("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id")))
