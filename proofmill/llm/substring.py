"""Exact substring dedup over sampled suffixes.

A position is removed when it lies in a 50-byte string that also starts in a document with a
smaller doc_id.  This is no suffix array and no induced sorting: a full sort of all suffixes passes
the disk budget, so suffixes are sampled and grouped by hash.  Every 50-byte string chooses one
suffix by its own bytes (the least-hashed 24-byte prefix of those that start in it), so equal strings
choose alike.  Chosen suffixes meet by the hash of their prefix; those of one document only are
dropped.  Around the others the strings that chose them are compared byte for byte with those of
smaller documents, in one pass over contexts sorted by prefix and document.

A prefix of very many documents is split by the 13 bytes that its strings have beyond it to the
right, or else to the left, and copies of a context inside one run of rows are settled before the
shuffle, so neither meets in one task as it stands.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .near import chunks, mix

LENGTH = 50
PREFIX = 24
SPAN = LENGTH - PREFIX + 1
#: Documents from which a prefix counts as hot; bytes beside it that its strings are then grouped by.
HOT = 4096
BESIDE = (LENGTH - PREFIX) // 2
#: Names have 56 bits; this one marks a hot name.
_MARK = 1 << 60


def samples(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sampled suffixes of some texts: text, place, name of the prefix, first and last start of the strings that chose it."""
    data = b"".join(texts)
    size = np.array([len(t) for t in texts])
    off = np.r_[0, np.cumsum(size)]
    n = len(data) - PREFIX + 1
    if n < SPAN:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.int64),) + (np.zeros(0, np.int64),) * 2
    eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    name = mix(eight[:n] * np.uint64(0x9E3779B97F4A7C15) + mix(eight[8 : 8 + n] * np.uint64(0xA0761D6478BD642F) + mix(eight[16 : 16 + n])))
    name >>= np.uint64(8)  # 56 bits tell apart the samples of 100 TB; a clash only adds a comparison
    # least name of each run of SPAN starts, the leftmost of equal ones: runs of doubling length
    low, at, have = name, np.arange(n, dtype=np.int32), 1
    while have < SPAN:
        step = min(have, SPAN - have)
        right = low[step:] < low[:-step]
        at = np.where(right, at[step:], at[:-step])
        low = np.where(right, low[step:], low[:-step])
        have += step
    m = len(low)
    doc = np.repeat(np.arange(len(texts)), size)[:m]
    inside = np.arange(m) + LENGTH <= off[doc + 1]
    # consecutive strings of one text with the same choice form one sample
    start = np.flatnonzero(inside & np.r_[True, (at[1:] != at[:-1]) | ~inside[:-1] | (doc[1:] != doc[:-1])])
    stop = np.flatnonzero(inside & np.r_[(at[1:] != at[:-1]) | ~inside[1:] | (doc[1:] != doc[:-1]), True])
    place, which = at[start].astype(np.int64), doc[start]
    return which, place - off[which], name[place].view(np.int64), start - off[which], stop - off[which]


def encoded(pdf: pd.DataFrame) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in pdf["text"]]


def sample_names(frames):
    for pdf in chunks(frames):
        which, _, name, _, _ = samples(encoded(pdf))
        ids = pdf["doc_id"].to_numpy()
        yield pd.DataFrame({"name": name, "doc_id": ids[which]})


def shared_names(frames):
    """From tuples sorted by (name, doc_id): those whose name more than one document has, marked where more than HOT have it.

    What waits between batches is one name with at most HOT documents.
    """
    waiting, hot = pd.DataFrame({"name": np.zeros(0, np.int64), "doc_id": np.zeros(0, np.int64)}), None
    last = None
    for pdf in frames:
        name, doc = np.r_[waiting["name"].to_numpy(), pdf["name"].to_numpy()], np.r_[waiting["doc_id"].to_numpy(), pdf["doc_id"].to_numpy()]
        if not len(name):
            continue
        fresh = np.r_[True, (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])]
        if hot is not None and name[0] == hot and doc[0] == last:
            fresh[0] = False
        name, doc = name[fresh], doc[fresh]
        waiting = pd.DataFrame({"name": name[:0], "doc_id": doc[:0]})
        if not len(name):
            continue
        start = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
        size = np.diff(np.r_[start, len(name)])
        known = hot is not None and name[0] == hot
        many = size > HOT
        many[0] |= known
        emit = many | (size > 1)
        if many[-1]:
            hot, last = name[-1], doc[-1]
        else:
            hot, emit[-1] = None, False
            waiting = pd.DataFrame({"name": name[start[-1] :], "doc_id": doc[start[-1] :]})
        rows = np.repeat(emit, size)
        yield pd.DataFrame({"doc_id": doc[rows], "name": (name + np.repeat(many, size) * _MARK)[rows]})
    if len(waiting) > 1:
        yield waiting[["doc_id", "name"]]


def contexts(frames):
    """Of each sample with a shared name: the bytes of all the strings that chose it.

    A hot one gives up to two: the strings that reach BESIDE bytes beyond the prefix to the right
    (side 1), and the others (side 2).  A copy of a context of a smaller document in the same run of
    rows is settled here: side -1, its length in place of ``before``, and no bytes.
    """
    for pdf in chunks(frames):
        pdf = pdf.sort_values("doc_id", kind="stable")
        raw = encoded(pdf)
        which, place, name, start, stop = samples(raw)
        keep, hot = np.zeros(len(name), dtype=bool), np.zeros(len(name), dtype=bool)
        bounds = np.searchsorted(which, np.arange(len(raw) + 1))
        for i, names in enumerate(pdf["names"]):
            a, b = bounds[i], bounds[i + 1]
            names = np.asarray(names, dtype=np.int64)
            keep[a:b] = np.isin(name[a:b], names & (_MARK - 1))
            if (names >= _MARK).any():
                hot[a:b] = np.isin(name[a:b] | _MARK, names)
        cut = place - BESIDE
        parts = [(keep & ~hot, start, stop, 0), (keep & hot & (stop >= cut), np.maximum(start, cut), stop, 1), (keep & hot & (start < cut), start, np.minimum(stop, cut - 1), 2)]
        ids, first, out = pdf["doc_id"].to_numpy(), {}, []
        for some, low, high, side in parts:
            some = np.flatnonzero(some)
            rows = zip(which[some].tolist(), low[some].tolist(), high[some].tolist(), (place - low)[some].tolist(), strict=True)
            for w, a, b, before in rows:
                doc, context = int(ids[w]), raw[w][a : b + LENGTH]
                if first.setdefault((side, before, context), doc) < doc:
                    out.append((doc, a, len(context), -1, None))
                else:
                    out.append((doc, a, before, side, context))
        yield pd.DataFrame(out, columns=["doc_id", "start", "before", "side", "context"])


def group_key() -> Column:
    """The bytes that all strings of a group share: the prefix, with those beside it where it is hot."""
    at, c = F.col("before"), F.col("context")
    key = F.when(F.col("side") == 0, F.substring(c, at + 1, F.lit(PREFIX))).when(F.col("side") == 1, F.substring(c, at + 1, F.lit(PREFIX + BESIDE)))
    return key.when(F.col("side") == 2, F.substring(c, at + 1 - BESIDE, F.lit(PREFIX + BESIDE))).otherwise(F.encode(F.col("doc_id").cast("string"), "UTF-8"))


def repeated_runs(frames):
    """From contexts sorted by (key, side, doc_id): runs of bytes that a smaller document has too.

    What is remembered are the distinct strings of one key, each with the least document it
    starts in; as documents come in ascending order, that is the first one.
    """
    now, strings, whole = None, {}, {}
    for pdf in frames:
        out = []
        for doc, start, before, side, context in zip(pdf["doc_id"].tolist(), pdf["start"].tolist(), pdf["before"].tolist(), pdf["side"].tolist(), pdf["context"], strict=True):
            if side < 0:
                out.append((doc, start, start + before))
                continue
            key = (side, context[before - (BESIDE if side == 2 else 0) : before + PREFIX + (BESIDE if side == 1 else 0)])
            if key != now:
                now, strings, whole = key, {}, {}
            first = whole.setdefault((before, context), doc)
            if first < doc:
                out.append((doc, start, start + len(context)))
                continue
            lo = None
            for k in range(len(context) - LENGTH + 1):
                if strings.setdefault((before - k, context[k : k + LENGTH]), doc) < doc:
                    lo = k if lo is None else lo
                elif lo is not None:
                    out.append((doc, start + lo, start + k - 1 + LENGTH))
                    lo = None
            if lo is not None:
                out.append((doc, start + lo, start + len(context)))
        yield pd.DataFrame(out, columns=["doc_id", "a", "b"])


def keep_rest(keep_text: bool):
    def run(frames):
        for pdf in chunks(frames):
            rows = []
            for raw, a, b, copy in zip(encoded(pdf), pdf["a"], pdf["b"], pdf["copy"], strict=True):
                kept, at, removed, spans, last = [], 0, 0, 0, -1
                if copy and len(raw) >= LENGTH:
                    a, b = [0], [len(raw)]
                if a is not None and len(a):
                    a, b = np.asarray(a), np.asarray(b)
                    order = np.argsort(a, kind="stable")
                    for x, y in zip(a[order].tolist(), b[order].tolist(), strict=True):
                        if x > last:
                            spans += 1
                            kept.append(raw[at:x])
                        if y > last:
                            removed += y - max(x, last if last >= 0 else x)
                            last = at = y
                rest = b"".join([*kept, raw[at:]])
                rows.append((len(raw), removed, spans, hashlib.sha256(rest).hexdigest(), rest))
            out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out if keep_text else out.drop(columns="kept")

    return run


def substring_dedup(docs: DataFrame, keep_bytes: bool = False) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: n_bytes, n_removed, n_spans, kept_sha256, and with ``keep_bytes`` the rest itself.

    Null text counts as empty; a text under 50 bytes and a null doc_id lose nothing and take nothing
    away; rows that repeat a doc_id are one document as far as "smaller" goes, and each get their row.
    Other columns are not read; an empty table gives none.  Texts of any length are read whole; what a
    task remembers is one key's distinct strings.
    """
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = every.where("doc_id is not null")  # the same rows below every join, so their exchange is reused
    digest = F.md5(F.encode("text", "UTF-8"))
    # an exact copy of a smaller document loses every string and is no one's only source
    names = texts.select("doc_id", digest.alias("h"))
    later = names.join(names.groupBy("h").agg(F.min("doc_id").alias("low")), "h").where("doc_id > low")
    copies = later.groupBy("doc_id").agg(F.collect_set("h").alias("copy_of"))
    is_copy = F.coalesce(F.array_contains("copy_of", digest), F.lit(False))
    marked = texts.join(copies, "doc_id", "left")
    own = marked.where(~is_copy).select("doc_id", "text")
    sampled = own.mapInPandas(sample_names, "name long, doc_id long")
    shared = sampled.repartition("name").sortWithinPartitions("name", "doc_id").mapInPandas(shared_names, "doc_id long, name long")
    wanted = shared.groupBy("doc_id").agg(F.collect_list("name").alias("names"))
    around = own.join(wanted, "doc_id").mapInPandas(contexts, "doc_id long, start int, before int, side byte, context binary")
    runs = around.repartition(group_key()).sortWithinPartitions(group_key(), "side", "doc_id").mapInPandas(repeated_runs, "doc_id long, a int, b int")
    spans = runs.groupBy("doc_id").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_bytes else "")
    none = F.lit(None).cast("array<int>")
    nameless = every.where("doc_id is null").select("doc_id", "text", none.alias("a"), none.alias("b"), F.lit(False).alias("copy"))
    out = marked.join(spans, "doc_id", "left").select("doc_id", "text", "a", "b", is_copy.alias("copy")).mapInPandas(keep_rest(keep_bytes), schema)
    return out.union(nameless.mapInPandas(keep_rest(keep_bytes), schema))
