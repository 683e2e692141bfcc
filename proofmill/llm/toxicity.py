"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(b + sum of weights + sum of dot products of the latent vectors of each pair of terms
that a document has).  The pair part learns combinations that a sum of single weights misses.
A term counts by how clearly its presence, alone or beside another frequent term, speaks for or
against the label, so rare terms of the fitted rows do not drown the rest, while two words that are
harmless each and toxic together both enter; how many terms a model has follows from the rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex
import zlib
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near import chunks

#: Hash space of terms; length of the latent vectors.
BUCKETS, FACTORS = 1 << 20, 4
#: z-score at which a term counts half, and how sharply its value rises there; a value under LEAST is 0.
EVIDENCE, SHARPNESS, LEAST = 2.8, 10, 1e-4
#: The most frequent terms of the fitted rows, whose pairs are looked at too, and how far the z-score of a
#: pair must pass those of its two terms to count like an own score of EVIDENCE.
FREQUENT, BESIDE = 1_000, 8.0
#: The fit ends when STILL steps have lowered the loss by less than a part SETTLED, or after STEPS.
STEPS, STILL, SETTLED = 1_000, 20, 0.01
#: Bound on the labelled rows that the model is fitted on (the least by hash of doc_id).
MAX_TRAIN = 16_000
PREDICT_AT = 0.7
#: Weight of a toxic row against another in the fit, at most.
BALANCE = 6.0
find_terms = regex.compile(r"\p{L}+").findall


def terms_of(text: str) -> set[str]:
    return set(find_terms(text.lower()))


def bucket(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % BUCKETS


def z_score(df: np.ndarray, hit: np.ndarray, n: int, pos: float) -> np.ndarray:
    """How far apart the shares of toxic and other rows are that hold something met in ``df`` rows, ``hit``
    of them toxic; shrunk where they hardly differ."""
    a, b = (hit + 0.5) / (pos + 1), (df - hit + 0.5) / (n - pos + 1)
    return np.abs(a - b) / np.sqrt(np.maximum(a * (1 - a) / pos + b * (1 - b) / (n - pos), 0) + 1e-12) * np.minimum(1.0, np.abs(np.log(a / b)))


def values(owner: np.ndarray, col: np.ndarray, terms: int, toxic: np.ndarray) -> np.ndarray:
    """Value of each term: z^s / (z^s + EVIDENCE^s), z its own z-score or what the best of its pairs has
    beyond the scores of both, in units of BESIDE, whichever is more.

    The pairs are those of the FREQUENT most frequent terms, counted by one product of matrices.
    """
    n, pos = len(toxic), toxic.sum()
    df, hit = np.bincount(col, minlength=terms), np.bincount(col, weights=toxic[owner], minlength=terms)
    z = z_score(df, hit, n, pos)
    often = np.sort(np.argsort(-df, kind="stable")[:FREQUENT])
    place = np.full(terms, -1)
    place[often] = np.arange(len(often))
    use = place[col] >= 0
    both, ill = np.zeros((len(often), len(often))), np.zeros((len(often), len(often)))
    for at in range(0, n, 4096):  # in blocks of rows, so memory does not grow with them
        some = use & (owner >= at) & (owner < at + 4096)
        x = np.zeros((min(4096, n - at), len(often)), np.float32)
        x[owner[some] - at, place[col[some]]] = 1
        bad = x[toxic[at : at + 4096] == 1]
        both += x.T @ x
        ill += bad.T @ bad
    beyond = z_score(both, ill, n, pos) - np.maximum(z[often][:, None], z[often][None, :])
    np.fill_diagonal(beyond, 0)
    z[often] = np.maximum(z[often], EVIDENCE / BESIDE * beyond.max(axis=1, initial=0))
    return 1 / (1 + (EVIDENCE / np.maximum(z, 1e-6)) ** SHARPNESS)


def fit(rows: list[np.ndarray], toxic: np.ndarray, steps: int = STEPS, seed: int = 7, factors: int = FACTORS) -> dict:
    """The model: buckets, weights, latent vectors and bias.

    Full-batch gradient descent (Adam) on the logistic loss with L2, over sparse rows, until the loss
    settles.  A bucket's value in a row is that of ``values``.  Without factors the model is linear.
    """
    toxic = np.asarray(toxic, dtype=np.float64)
    n, pos = len(rows), toxic.sum()
    share = (pos + 1) / (n + 2)
    prior = {"terms": np.zeros(0, np.int64), "w": np.zeros(0), "v": np.zeros((0, factors)), "b": float(np.log(share / (1 - share)))}
    if not n or pos in (0, n) or not sum(map(len, rows)):
        return prior
    terms, col = np.unique(np.concatenate(rows), return_inverse=True)
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    value = values(owner, col, len(terms), toxic)
    some = value >= LEAST
    if not some.any():
        return prior
    terms, value, use = terms[some], value[some].astype(np.float32), some[col]
    owner, col = owner[use], (np.cumsum(some) - 1)[col[use]]
    x = value[col][:, None]
    lines, first = np.unique(owner, return_index=True)
    by = np.argsort(col, kind="stable")
    owner_by, x_by, first_by = owner[by], x[by], np.r_[0, np.cumsum(np.bincount(col))[:-1]]
    # the rarer class counts up to BALANCE times, else few documents of a language could not lift a score
    importance = np.where(toxic == 1, min(BALANCE, (n - pos) / pos), 1.0)
    rng = np.random.default_rng(seed)
    p = {"w": np.zeros(len(terms)), "v": rng.normal(0, 0.05, (len(terms), factors)), "b": np.array(np.log(pos / (n - pos)))}
    m, s = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    losses: list[float] = []
    for t in range(1, steps + 1):
        each = np.concatenate([p["w"][:, None], p["v"]], axis=1).astype(np.float32)[col] * x
        sums, squares = np.zeros((n, factors + 1)), np.zeros(n)
        sums[lines] = np.add.reduceat(each, first, axis=0)
        squares[lines] = np.add.reduceat((each[:, 1:] ** 2).sum(axis=1), first)
        y = p["b"] + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(axis=1) - squares)
        losses.append(float((importance * np.logaddexp(0, np.where(toxic == 1, -y, y))).mean()))
        if t > 5 * STILL and losses[-1 - STILL] - losses[-1] < SETTLED * losses[-1 - STILL]:
            break
        err = importance * (1 / (1 + np.exp(-np.clip(y, -30, 30))) - toxic) / n
        back = np.concatenate([err[:, None], err[:, None] * sums[:, 1:]], axis=1).astype(np.float32)[owner_by] * x_by
        back = np.add.reduceat(back, first_by, axis=0)
        grad = {"w": back[:, 0] + 2e-5 * p["w"], "v": back[:, 1:] - p["v"] * (back[:, 0] * value)[:, None] + 2e-5 * p["v"], "b": err.sum()}
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * grad[k]
            s[k] = 0.999 * s[k] + 0.001 * grad[k] ** 2
            p[k] = p[k] - 0.05 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    return {"terms": terms, "w": p["w"] * value, "v": p["v"] * value[:, None], "b": float(p["b"])}


def score(model: dict, texts: list[str]) -> np.ndarray:
    place = {int(t): i for i, t in enumerate(model["terms"])}
    known: dict[str, int] = {}
    w, v, out = model["w"], model["v"], np.zeros(len(texts))
    for i, text in enumerate(texts):
        at = set()
        for term in terms_of(text):
            k = known.get(term)
            if k is None:
                k = known[term] = place.get(bucket(term), -1)
            if k >= 0:
                at.add(k)
        idx = np.fromiter(at, np.int64, len(at))
        own = v[idx]
        y = model["b"] + w[idx].sum() + 0.5 * ((own.sum(axis=0) ** 2).sum() - (own**2).sum())
        out[i] = 1 / (1 + np.exp(-np.clip(y, -30, 30)))
    return out


def train(docs: DataFrame, labels: DataFrame, fold: int = 1, max_train: int = MAX_TRAIN) -> dict:
    """Fits on at most ``max_train`` labelled rows outside the held-out fold; the bound keeps the
    id list broadcastable and the sparse rows small enough for one task."""
    rows = labels.where(f"doc_id is not null and toxic is not null and crc32(cast(doc_id as string)) % 3 <> {fold}").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)

    def hashed(frames):
        for pdf in chunks(frames):
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "terms": [sorted({bucket(t) for t in terms_of(x)}) for x in pdf["text"]]})

    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(rows), "doc_id").mapInPandas(hashed, "doc_id long, toxic int, terms array<int>")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        m = fit([np.asarray(t, dtype=np.int64) for t in pdf["terms"]], pdf["toxic"].to_numpy())
        return pd.DataFrame({"terms": [m["terms"]], "w": [m["w"]], "v": [m["v"].ravel()], "b": [m["b"]]})

    got = sample.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(one, "terms array<long>, w array<double>, v array<double>, b double").collect()
    if not got:
        return fit([], np.zeros(0))
    r = got[0]
    return {"terms": np.array(r["terms"], dtype=np.int64), "w": np.array(r["w"]), "v": np.array(r["v"]).reshape(-1, FACTORS), "b": r["b"]}


def toxicity(docs: DataFrame, labels: DataFrame, fold: int = 1) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: held_out, score and predicted (score >= 0.7, so a tie counts).

    Only text enters a score, and equal texts have equal scores.  Null or empty text gets the score of
    no term; without labels, or with one class only, every score is the prior; a null doc_id is not
    held out; labels that repeat a doc_id count once, toxic if any says so; rows that repeat a doc_id
    each get their row.  Other columns are not read; an empty table gives none.  Texts may be of any
    length: a run of rows is cut at about two million characters, a longer text stands alone.
    """
    model = train(docs, labels, fold)

    def run(frames):
        for pdf in chunks(frames):
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "score": score(model, pdf["text"].tolist())})

    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == fold, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
