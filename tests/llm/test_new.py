"""Token files, the prefix trie and spelling variants against plain Python; the toxicity fit against dense sums."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from proofmill.llm import prefix_trie, token_files, toxicity, variants
from proofmill.llm.queries import vocabulary_path

rnd = random.Random(11)
CLASHING = "a b n h key at depth pos part up tokens word near root run last ids turns base x y".split()


def with_clashing(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("own") for c in CLASHING if c not in df.columns})


# -- 11 -------------------------------------------------------------------------------------------

SIGNS = list("ab 1.,\n\t ' 　\x1cé中ª") + ["'s", " ", "\n", "<|endoftext|>", "word"]
STRANGE = [None, "", "\n", " ", "x" * 5000, " ".join(["long text"] * 30_000)] + ["".join(rnd.choices(SIGNS, k=rnd.randint(0, 30))) for _ in range(500)]


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def written_tokens(spark, tmp_path_factory):
    rows = [(i * 7 % 997, t) for i, t in enumerate(STRANGE)] + [(3, "again"), (3, "again"), (None, "no id")]
    path = str(tmp_path_factory.mktemp("tokens")) + "/t"
    docs = with_clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    token_files.write_tokens(docs, vocabulary_path("byte_bpe_50k.json"), path)
    return rows, path


def test_token_files_equal_the_library(spark, written_tokens):
    rows, path = written_tokens
    got = [tuple(r) for r in token_files.token_digests(token_files.read_tokens(spark, path)).collect()]
    tokens = library()
    raw = {t: tokens.encode(t or "", add_special_tokens=False).ids + [2] for _, t in rows}
    assert sorted((str(i), n, crc) for i, _, n, crc in got) == sorted((str(i), len(raw[t]), zlib.crc32(np.array(raw[t], "<u4").tobytes())) for i, t in rows)
    at = 0
    for i, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += n
    ids = [i for i, *_ in sorted(got, key=lambda r: r[1])]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])


def test_token_files_hold_lists_of_integers_with_indexes(spark, written_tokens):
    """Files ascend by doc_id and have a Bloom filter on it; a search for one id is pushed to the scan."""
    _, path = written_tokens
    df = token_files.read_tokens(spark, path)
    assert "EqualTo(doc_id,14)" in df.where("doc_id = 14")._jdf.queryExecution().executedPlan().toString()
    assert df.where("doc_id = 14").count() == 1 and df.where("doc_id = 999999").count() == 0
    jvm, hadoop = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    filters, spans = 0, []
    for f in sorted({r[0] for r in spark.read.orc(f"{path}/ids").selectExpr("input_file_name()").collect()}):
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f), jvm.org.apache.orc.OrcFile.readerOptions(hadoop))
        assert "ids:array<int>" in reader.getSchema().toString()
        rows = reader.rows()
        for stripe in reader.getStripes():
            filters += "BLOOM_FILTER" in rows.readStripeFooter(stripe).toString()
        spans.append([r[0] for r in spark.read.orc(f).selectExpr("doc_id").where("doc_id is not null").collect()])
    assert filters >= len(spans) >= 1 and all(s == sorted(s) for s in spans)
    assert sum(spans, []) == sorted(sum(spans, []))


def test_token_files_forget(spark, monkeypatch):
    monkeypatch.setattr(token_files, "MEMORY", 50)
    own, tokens = token_files.LibraryEncoder(vocabulary_path("byte_bpe_50k.json")), library()
    for _ in range(20):
        texts = [" ".join(rnd.choices(["alpha", "beta.", "Über", "x,y", "漢字"], k=9)) for _ in range(20)]
        assert [x.tolist() for x in own.encode(pa.array(texts))] == [tokens.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files_empty(spark, tmp_path):
    token_files.write_tokens(spark.createDataFrame([], "doc_id long, text string"), vocabulary_path("byte_bpe_50k.json"), f"{tmp_path}/t")
    assert token_files.token_digests(token_files.read_tokens(spark, f"{tmp_path}/t")).count() == 0


def test_token_files_of_another_tokenizer(spark, tmp_path):
    path = vocabulary_path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    want = [len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids) for t in ("One two", "three")]
    token_files.write_tokens(spark.createDataFrame([(1, "One two"), (2, "three")], "doc_id long, text string"), path, f"{tmp_path}/t")
    assert [r["n_tokens"] - 1 for r in token_files.read_tokens(spark, f"{tmp_path}/t").orderBy("doc_id").collect()] == want


# -- 12 -------------------------------------------------------------------------------------------


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()), (role, text)))
    own = {c: tuple(x for _, x in sorted(ts, key=lambda t: t[0])) for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - int(abs(c) % 20) * (1 if c >= 0 else -1)
        path = own.get(first, ())[:h] + ts[h:]
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(cs) - 1) * len([w for w in re.split("[\t-\r ]+", p[-1][1]) if w]) if p else 0
    return sorted(
        (min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, cs in members.items()
    )


def trie_rows(spark, rows, schema="conv_id long, turn long, role string, text string"):
    df = with_clashing(spark.createDataFrame(rows, schema).repartition(3))
    cols = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted(tuple(r[c] for c in cols) for r in prefix_trie.prefix_trie(df).collect())


ODD_TURNS = [
    *[(c, t, ["user", "assistant"][t % 2], rnd.choice(["hi there", "what now", "tell me more of it"])) for c in range(60) for t in range(rnd.randint(1, 5))],
    (-7, 1, "user", "below zero"), (-7, 0, "user", "hi there"), (-20, 0, "user", "hi there"), (None, 0, "user", "nobody's"), (None, None, None, None),
    (200, None, None, None), (200, None, "user", "no turn"), (200, 3, None, "x  y\tz"), (200, 3, "user", None), (201, 3, "", ""), (201, 3, "", ""), (202, 1, "user", "hi there"), (219, 0, "a", "short"),
    *[(c, 0, "user", "a copy of many") for c in range(9000, 9040)],
]


def test_trie(spark):
    assert trie_rows(spark, ODD_TURNS) == plain_trie(ODD_TURNS)
    assert trie_rows(spark, []) == []


@pytest.mark.parametrize(("band", "run"), [(2, 4), (3, 9), (16, 1024)])
def test_trie_of_deep_conversations(spark, monkeypatch, band, run):
    """More depths than a band of bands holds; branches at every depth; runs cut inside bands of bands."""
    monkeypatch.setattr(prefix_trie, "BAND", band)
    monkeypatch.setattr(prefix_trie, "RUN", run)
    n = 40 if band < 16 else 300
    trunk = [("user" if i % 2 else "assistant", f"turn {i} of it") for i in range(n)]
    rows = [(20, i, *t) for i, t in enumerate(trunk)]
    for k, c in enumerate(range(21, 34)):
        cut = rnd.randint(1, n - 1)
        rows += [(c, i, *t) for i, t in enumerate([*trunk[:cut], *[("user", f"{k // 2} branch")] * (k % 5 * n // 10)])]
    assert trie_rows(spark, rows) == plain_trie(rows)


# -- 13 -------------------------------------------------------------------------------------------


def plain_variants(rows):
    small = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(small)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [x for x in words if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in words}
    best = {w: min(xs, key=lambda x: (-words[x], x)) for w, xs in near.items() if xs}
    form = {w: x for w, x in best.items() if words[x] >= 10 * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items())


def variant_rows(spark, rows):
    df = with_clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in variants.variant_groups(df).collect()), key=lambda r: r[0])


def changed(word):
    i, c = rnd.randrange(len(word) + 1), rnd.choice("abeéß÷")
    return rnd.choice([word[:i] + c + word[i:], word[:i] + word[i + 1 :], word[:i] + c + word[i + 1 :]])


def test_variants(spark):
    words = ["".join(rnd.choices(["tion", "er", "ab", "é", "st", "z", "on"], k=rnd.randint(3, 6))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaab", "abababab", "babababa", "Überlänge"]
    words += [changed(w) for w in words for _ in range(4)]
    words += [changed(w) for w in words]
    rows = [(i, " ".join(rnd.choices(words, k=200)) + " Mixed CASES-of_Words9 naïveté") for i in range(40)]
    rows += [(i % 7, "spelling " * 700 + "spellingg " * 40 + "sspellingg " * 3) for i in range(7)]
    long = ["".join(rnd.choices("abcdé", k=k)) for k in (62, 63, 63, 64, 65, 66, 90)]
    long += [changed(w) for w in long for _ in range(8)]
    rows += [(60 + i, " ".join(long + long[i:])) for i in range(3)]
    rows += [(None, "spelling xspelling xspelling"), (50, None), (51, ""), (52, "q" * 20_000 + " " + "q" * 20_000 + " " + "q" * 20_001 + " " + "q" * 20_001), (1, "spelling"), (1, "spelling")]
    got = variant_rows(spark, rows)
    assert got == plain_variants(rows) and sum(r[4] > 0 for r in got) > 100 and any(r[1] and r[1] != r[2] for r in got)
    assert variant_rows(spark, [(1, None)]) == []


def test_cheapest_pair():
    for _ in range(2000):
        places = sorted(rnd.sample(range(12), rnd.randint(3, 6)))
        costs = [rnd.randint(1, 9) for _ in places]
        pairs = [(costs[i] + costs[j], places[i], places[j]) for i in range(len(places)) for j in range(i) if places[i] - places[j] >= 2]
        a, b = variants.cheapest_pair(places, costs)
        assert b - a >= 2 and costs[places.index(a)] + costs[places.index(b)] == min(pairs)[0]


# -- 10 -------------------------------------------------------------------------------------------


def neutral_pairs(seed, n=6000):
    """Two words harmless and marginally neutral each, toxic together, and a third toxic where neither is."""
    r = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        a, b, c = r.random() < 0.3, r.random() < 0.3, r.random() < 3 / 7
        own = {f"w{i}" for i in r.integers(0, 200, 15)} | {w for w, x in (("insult", a), ("group", b), ("third", c)) if x}
        out.append((own, int((a and b) or (c and not a and not b))))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_toxicity_of_neutral_pairs(seed):
    rows = neutral_pairs(seed)
    terms = [np.array(sorted({toxicity.bucket(w) for w in own})) for own, _ in rows]
    label = np.array([t for _, t in rows])
    fitted, held = slice(0, 4000), slice(4000, None)

    def rates(factors):
        m = toxicity.fit(terms[fitted], label[fitted], factors=factors)
        place = {int(t): i for i, t in enumerate(m["terms"])}
        idx = [[place[t] for t in x.tolist() if t in place] for x in terms[held]]
        y = np.array([m["b"] + m["w"][i].sum() + 0.5 * ((m["v"][i].sum(axis=0) ** 2).sum() - (m["v"][i] ** 2).sum()) for i in idx])
        found, toxic = 1 / (1 + np.exp(-y)) >= toxicity.PREDICT_AT, label[held] == 1
        pair = np.array([{"insult", "group"} <= own for own, _ in rows[held]])
        return found[pair].mean(), found[toxic].mean(), found[~toxic].mean()

    pair, recall, wrong = rates(toxicity.FACTORS)
    assert pair >= 0.9 and recall >= 0.9 and wrong <= 0.05
    pair, _, wrong = rates(0)
    assert pair < 0.9 and wrong > 0.05


def test_toxicity_fit_equals_dense_sums():
    """Values, loss steps and the model against loops and dense matrices, on a table small enough for them."""
    rows = neutral_pairs(5, 300)
    terms, label = [np.array(sorted({toxicity.bucket(w) for w in own})) for own, _ in rows], np.array([float(t) for _, t in rows])
    names = sorted({t for x in terms for t in x.tolist()})
    n, pos = len(rows), label.sum()

    def z(mask):
        df, hit = mask.sum(), mask[label == 1].sum()
        a, b = (hit + 0.5) / (pos + 1), (df - hit + 0.5) / (n - pos + 1)
        return abs(a - b) / np.sqrt(a * (1 - a) / pos + b * (1 - b) / (n - pos) + 1e-12) * min(1.0, abs(np.log(a / b)))

    has = np.array([[t in set(x.tolist()) for t in names] for x in terms])
    own = [z(has[:, j]) for j in range(len(names))]
    beside = [max([0.0] + [z(has[:, j] & has[:, k]) - max(own[j], own[k]) for k in range(len(names)) if k != j]) for j in range(len(names))]
    score = np.maximum(own, toxicity.EVIDENCE / toxicity.BESIDE * np.array(beside))
    value = 1 / (1 + (toxicity.EVIDENCE / np.maximum(score, 1e-6)) ** toxicity.SHARPNESS)
    some = value >= toxicity.LEAST
    x, value = has[:, some] * value[some], value[some]
    weight = np.where(label == 1, min(toxicity.BALANCE, (n - pos) / pos), 1.0)
    steps = 25
    p = {"w": np.zeros(x.shape[1]), "v": np.random.default_rng(7).normal(0, 0.05, (x.shape[1], toxicity.FACTORS)), "b": np.log(pos / (n - pos))}
    m, s = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for t in range(1, steps + 1):
        inner = p["v"] @ p["v"].T
        np.fill_diagonal(inner, 0)
        y = p["b"] + x @ p["w"] + 0.5 * np.einsum("ij,jk,ik->i", x, inner, x)
        err = weight * (1 / (1 + np.exp(-y)) - label) / n
        pairs = np.einsum("i,ij,ik->jk", err, x, x)
        np.fill_diagonal(pairs, 0)
        grad = {"w": x.T @ err + 2e-5 * p["w"], "v": pairs @ p["v"] + 2e-5 * p["v"], "b": err.sum()}
        for k in p:
            m[k], s[k] = 0.9 * m[k] + 0.1 * grad[k], 0.999 * s[k] + 0.001 * grad[k] ** 2
            p[k] = p[k] - 0.05 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    got = toxicity.fit(terms, label, steps=steps)
    assert got["terms"].tolist() == [t for t, k in zip(names, some, strict=True) if k]
    assert np.allclose(got["w"], p["w"] * value, atol=2e-3) and np.allclose(got["v"], p["v"] * value[:, None], atol=5e-3) and abs(got["b"] - p["b"]) < 2e-3


def test_token_files_encode_in_little_memory():
    import subprocess
    import sys

    code = """
import random, resource
import public_tokenizers, pyarrow as pa
from proofmill.llm import token_files as tf
random.seed(1)
word = lambda: "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=random.randint(2, 9)))
texts = pa.array([" ".join(word() for _ in range(300)) for _ in range(6000)])
own, began = tf.LibraryEncoder(public_tokenizers.path("byte_bpe_50k.json")), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for a, b in tf.batches(texts) if hasattr(tf, "batches") else [(0, 1800), (1800, 3600), (3600, 6000)]:
    rows = own.encode(texts.slice(a, b - a))
    assert len(rows) == b - a
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - began) // 1024)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert int(done.stdout.split()[-1]) < 300
