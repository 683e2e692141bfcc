"""Byte-pair encoding: two array forms of the same merge rules, both kept free of the tokenizer library.

``RankSynchronousCounter`` (token counts) holds a batch of pre-tokens as one ragged numpy array
and, round by round, merges in every sequence its lowest-ranked pair at all its places.
``WordEncoder`` (encoding and decoding) holds for each short word its parts and the ranks of
neighbouring parts in contiguous arrays, and deletes one boundary of a word at a time.
Both keep bounded dictionaries of words met before; those only save time.  A word of more than LONG
characters, as scripts without spaces or noise make them, is merged with a heap in n log n steps.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The published pre-token patterns of the two vocabulary files.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Code points that the library's Unicode 16 tables hold to be neither letter nor number, though later tables do.
LATER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 "
    "1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 "
    "1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
#: Capitals of the library's tables that Unicode 15.1 lacks, with how far their small letters stand from them.
CAPITALS = "1C89+1 A7CB-A567 A7CC+1 A7CE+1 A7D2+1 A7D4+1 A7DA+1 A7DC-A641 " + " ".join([f"{c:X}+20" for c in range(0x10D50, 0x10D66)] + [f"{c:X}+1B" for c in range(0x16EA0, 0x16EB9)])
#: Words remembered by one Python worker; beyond it the memory starts anew.
MEMORY = 400_000
NONE = np.iinfo(np.int32).max
#: Characters from which a word is merged with a heap.
LONG = 512


def spans(text: str) -> list[tuple[int, int]]:
    return [(int(a, 16), int(b or a, 16)) for a, _, b in (r.partition("-") for r in text.split())]


_LATER = "[" + "".join(rf"\U{a:08X}-\U{b:08X}" for a, b in spans(LATER)) + "]"
_SMALL = {int(a, 16): int(a, 16) + int(step, 16) for a, step in (regex.match(r"([0-9A-F]+)(.+)", c).groups() for c in CAPITALS.split())}
ODD = frozenset(chr(c) for a, b in spans(LATER) for c in range(a, b + 1)) | frozenset(map(chr, _SMALL))


def pinned(pattern: str):
    """Cuts by ``pattern`` with letters and numbers as the library's tables have them; the plain pattern where a text has none that differ."""
    letters, numbers = rf"[\p{{L}}--{_LATER}]", rf"[\p{{N}}--{_LATER}]"
    exact = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{letters}{numbers}]").replace(r"[\p{L}]", letters).replace(r"[\p{N}]", numbers).replace(r"\p{L}", letters).replace(r"\p{N}", numbers)
    plain, exact = regex.compile(pattern).findall, regex.compile("(?V1)" + exact).findall
    return lambda text: plain(text) if text.isascii() or ODD.isdisjoint(text) else exact(text)


def byte_letters() -> list[str]:
    """The printable letter of each byte: itself where printable, else the next unused code from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(plain))
    spare = dict(zip(rest, range(256, 512), strict=False))
    return [chr(spare.get(b, b)) for b in range(256)]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def specials(spec: dict) -> dict[str, int]:
    return {t["content"]: t["id"] for t in spec["added_tokens"]}


def splitter(names: dict[str, int]):
    """Cuts a text at special strings, longest first."""
    return regex.compile("(" + "|".join(regex.escape(s) for s in sorted(names, key=len, reverse=True)) + ")") if names else None


class PairTable:
    """Rank and product of each mergeable pair, in an open-addressed numpy hash table."""

    BITS = 20

    def __init__(self, spec: dict):
        vocab = spec["model"]["vocab"]
        self.size = len(vocab)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int32)
        self.key = np.full(1 << self.BITS, -1, dtype=np.int64)
        self.rank = np.full(1 << self.BITS, NONE, dtype=np.int32)
        left, slot, self.probes = np.arange(len(keys)), self.slot(keys), 0
        while len(left):
            self.probes += 1
            _, first = np.unique(slot, return_index=True)
            first = first[self.key[slot[first]] < 0]
            self.key[slot[first]], self.rank[slot[first]] = keys[left[first]], left[first]
            rest = np.ones(len(left), dtype=bool)
            rest[first] = False
            left, slot = left[rest], (slot[rest] + 1) & ((1 << self.BITS) - 1)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where the pair does not merge."""
        key = left.astype(np.int64) * self.size + right
        at = self.slot(key)
        out = np.where(self.key[at] == key, self.rank[at], NONE).astype(np.int32)
        open_ = np.flatnonzero((out == NONE) & (self.key[at] >= 0))
        for step in range(1, self.probes):
            if not len(open_):
                break
            to = (at[open_] + step) & ((1 << self.BITS) - 1)
            hit = self.key[to] == key[open_]
            out[open_[hit]] = self.rank[to[hit]]
            open_ = open_[~hit & (self.key[to] >= 0)]
        return out


class HeapMerger:
    """Merges one word of any length: the least rank of a heap, the leftmost of equal ones, over a linked list of parts."""

    def __init__(self, spec: dict):
        vocab = spec["model"]["vocab"]
        self.merges = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])

    def parts(self, ids: list[int]) -> list[int]:
        part, n, get = list(ids), len(ids), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, part[i], part[i + 1]) for i in range(n - 1) if (m := get((part[i], part[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if part[i] != left or j >= n or part[j] != right:
                continue  # a part of this pair has changed since
            part[i], part[j] = get((left, right))[1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := get((part[i], part[k])):
                    heapq.heappush(heap, (m[0], i, part[i], part[k]))
            h = before[i]
            if h >= 0 and (m := get((part[h], part[i]))):
                heapq.heappush(heap, (m[0], h, part[h], part[i]))
        return [p for p in part if p >= 0]


class RankSynchronousCounter:
    def __init__(self, path: str):
        spec = vocabulary(path)
        vocab = spec["model"]["vocab"]
        self.special, self.pairs = specials(spec), PairTable(spec)
        self.cut, self.find = splitter(self.special), pinned(BYTE_LEVEL)
        self.long = HeapMerger(spec)
        self.first = np.array([vocab[c] for c in byte_letters()], dtype=np.int32)
        self.known: dict[str, int] = {}

    def symbols_left(self, words: list[str]) -> np.ndarray:
        """How many symbols of each word survive all merges."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        out = lengths.copy()
        sym = self.first[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        seq = np.repeat(np.arange(len(raw)), lengths)
        while len(sym) > 1:
            joint = seq[:-1] == seq[1:]
            rank = np.full(len(sym), NONE, dtype=np.int32)
            rank[:-1][joint] = self.pairs.ranks(sym[:-1][joint], sym[1:][joint])
            starts = np.flatnonzero(np.r_[True, ~joint])
            low = np.minimum.reduceat(rank, starts)
            low_here = np.repeat(low, np.diff(np.r_[starts, len(sym)]))
            live = low_here < NONE  # finished words leave the arrays
            if not live.any():
                break
            hit = (rank == low_here) & live
            # in a run of overlapping places (aaa) every second one merges, from the left
            run = np.flatnonzero(hit)
            fresh = np.r_[True, np.diff(run) != 1]
            within = np.arange(len(run)) - np.maximum.accumulate(np.where(fresh, np.arange(len(run)), 0))
            at = run[within % 2 == 0]
            sym = sym.copy()
            sym[at] = self.pairs.made[rank[at]]
            keep = live
            keep[at + 1] = False
            sym, seq = sym[keep], seq[keep]
            ids, left = np.unique(seq, return_counts=True)
            out[ids] = left
        return out

    def count(self, texts: list[str]) -> list[int]:
        out, parts, fixed = [], [], []
        for t in texts:
            found, marks = [], 0
            for p in self.cut.split(t) if self.cut and any(s in t for s in self.special) else (t,):
                if p in self.special:
                    marks += 1
                else:
                    found += self.find(p)
            parts.append(found)
            fixed.append(marks)
        new = {w for p in parts for w in p} - self.known.keys()
        if len(self.known) + len(new) > MEMORY:
            self.known = {}
            new = {w for p in parts for w in p}
        large = [w for w in new if len(w) > LONG]
        for w in large:
            self.known[w] = len(self.long.parts(self.first[np.frombuffer(w.encode("utf-8", "surrogatepass"), dtype=np.uint8)].tolist()))
        new = list(new.difference(large))
        for i in range(0, len(new), 50_000):
            block = new[i : i + 50_000]
            self.known.update(zip(block, self.symbols_left(block).tolist(), strict=True))
        get = self.known.__getitem__
        for p, n in zip(parts, fixed, strict=True):
            out.append(n + sum(map(get, p)))
        return out


class WordEncoder:
    #: Words of up to so many bytes are encoded many at a time, in arrays of equal length.
    SHORT = 32

    def __init__(self, path: str):
        spec = vocabulary(path)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        self.special, self.pairs = specials(spec), PairTable(spec)
        self.cut, self.find = splitter(self.special), pinned(WORD_LEVEL)
        self.long = HeapMerger(spec)
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int32)
        self.last = np.array([vocab[c + end] for c in letters], dtype=np.int32)
        self.said = [""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.said[i] = t
        self.known: dict[str, tuple[int, str, str]] = {}

    def parts(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of words of one length, given as rows of bytes: ids by row, and how many count.

        A row holds the parts between the word's boundaries in one contiguous stretch, and beside
        it the ranks of neighbouring parts.  Each turn scans for a row's least rank (the leftmost
        of equal ones), deletes that boundary, and looks up the two ranks beside it again.
        """
        n, width = words.shape
        part = self.inner[words]
        part[:, -1] = self.last[words[:, -1]]
        size = np.full(n, width)
        if width == 1:
            return part, size
        rank = self.pairs.ranks(part[:, :-1].ravel(), part[:, 1:].ravel()).reshape(n, width - 1)
        rank = np.concatenate([rank, np.full((n, 1), NONE, dtype=np.int32)], axis=1)
        done, rows = part.copy(), np.arange(n)
        while len(rows):
            at = rank.argmin(axis=1)
            here = np.arange(len(rows))
            low = rank[here, at]
            if (low == NONE).any():
                over = low == NONE
                done[rows[over]] = part[over]
                rows, part, rank, at, low = rows[~over], part[~over], rank[~over], at[~over], low[~over]
                here = np.arange(len(rows))
                if not len(rows):
                    break
            part[here, at] = self.pairs.made[low]
            # the boundary after ``at`` goes: what follows moves one place to the left
            move = np.arange(width - 1)[None, :] > at[:, None]
            part[:, :-1] = np.where(move, part[:, 1:], part[:, :-1])
            move[:, :] = np.arange(width - 1)[None, :] >= at[:, None]
            rank[:, :-1] = np.where(move, rank[:, 1:], rank[:, :-1])
            size[rows] -= 1
            ahead = np.flatnonzero(at + 1 < size[rows])
            rank[ahead, at[ahead]] = self.pairs.ranks(part[ahead, at[ahead]], part[ahead, at[ahead] + 1])
            ended = np.flatnonzero(at + 1 >= size[rows])
            rank[ended, at[ended]] = NONE
            back = np.flatnonzero(at > 0)
            rank[back, at[back] - 1] = self.pairs.ranks(part[back, at[back] - 1], part[back, at[back]])
        return done, size

    def coded(self, words: list[str]) -> list[tuple[int, str, str]]:
        """Of each word: number of tokens, their ids and their strings, each joined by one space."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        by: dict[int, list[int]] = {}
        for i, w in enumerate(raw):
            by.setdefault(len(w), []).append(i)
        out: list = [None] * len(words)
        said = self.said
        for length, which in by.items():
            if length > LONG:
                for i in which:
                    raw_ids = self.inner[np.frombuffer(raw[i], dtype=np.uint8)].tolist()
                    raw_ids[-1] = int(self.last[raw[i][-1]])
                    ids = self.long.parts(raw_ids)
                    out[i] = (len(ids), " ".join(map(str, ids)), " ".join([said[t] for t in ids]))
                continue
            step = max(1, 20_000 * self.SHORT // max(length, self.SHORT))
            for k in range(0, len(which), step):
                own = which[k : k + step]
                got, size = self.parts(np.frombuffer(b"".join([raw[i] for i in own]), dtype=np.uint8).reshape(len(own), length))
                for i, ids, n in zip(own, got.tolist(), size.tolist(), strict=True):
                    ids = ids[:n]
                    out[i] = (n, " ".join(map(str, ids)), " ".join([said[t] for t in ids]))
        return out

    def normal(self, text: str) -> str:
        """Composed form, then lower case letter by letter (a final sigma has no form of its own here)."""
        if text.isascii():
            return text.lower()
        small = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return small if ODD.isdisjoint(small) else small.translate(_SMALL)

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Of each whole text: number of tokens, ids joined by one space, decoded text."""
        split = []
        for t in texts:
            pieces = self.cut.split(t) if self.cut and any(s in t for s in self.special) else (t,)
            split.append([(p, ()) if p in self.special else ("", self.find(self.normal(p))) for p in pieces])
        new = {w for pieces in split for _, ws in pieces for w in ws} - self.known.keys()
        if len(self.known) + len(new) > MEMORY:
            self.known = {}
            new = {w for pieces in split for _, ws in pieces for w in ws}
        new = list(new)
        self.known.update(zip(new, self.coded(new), strict=True))
        get, out = self.known.__getitem__, []
        for pieces in split:
            n, ids, said = 0, [], []
            for mark, ws in pieces:
                if mark:
                    n += 1
                    ids.append(str(self.special[mark]))
                    said.append(mark)
                elif ws:
                    count, i, d = zip(*map(get, ws), strict=True)
                    n += sum(count)
                    ids += i
                    said += d
            out.append((n, " ".join(ids), " ".join(said)))
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> RankSynchronousCounter:
    return RankSynchronousCounter(path)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def text_chunks(frames: Iterator[pd.DataFrame], chars: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """Cuts Arrow batches into runs of rows with about ``chars`` characters; a longer text stands alone."""
    for pdf in frames:
        if not len(pdf):
            continue
        size = pdf["text"].str.len().to_numpy().cumsum() // chars
        for _, part in pdf.groupby(size, sort=True):
            yield part


def token_counts(docs: DataFrame, vocab_path: str, limit: int = 512) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: n_bytes, n_tokens and over_limit (n_tokens > limit, so a tie is not over).

    A null text counts as empty; equal rows give equal rows, null and repeated doc_ids each theirs;
    other columns are not read; an empty table gives none.  Texts and words may be of any length: runs
    of rows are cut at about two million characters, a longer text stands alone and whole.  The
    vocabulary file is read by path in each Python worker.  No shuffle.
    """

    def run(frames):
        own = counter(vocab_path)
        for pdf in text_chunks(frames):
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": pdf["n_bytes"], "n_tokens": own.count(pdf["text"].tolist())})

    rows = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.coalesce("text", F.lit("")).alias("text"))
    out = rows.mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def encode_decode(docs: DataFrame, vocab_path: str, keep_text: bool = False) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: n_tokens, digests of the ids and of the decoded text, and
    with ``keep_text`` the ids (array) and the decoded text themselves.

    A null text counts as empty (no tokens, empty decoded text); null and repeated doc_ids each get
    their row; other columns are not read; an empty table gives none.  Texts and words may be of any
    length, as in ``token_counts``.  Decoding joins the token strings by one space, as this vocabulary
    has no decoder.  No shuffle.
    """

    def sha(s: str) -> str:
        return hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def run(frames):
        own = encoder(vocab_path)
        for pdf in text_chunks(frames):
            got = own.encode(pdf["text"].tolist())
            out = pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "n_tokens": [g[0] for g in got], "ids_sha256": [sha(g[1]) for g in got], "decoded_sha256": [sha(g[2]) for g in got]})
            if keep_text:
                out["ids"] = [[int(i) for i in g[1].split()] for g in got]
                out["decoded"] = [g[2] for g in got]
            yield out

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, schema + (", ids array<int>, decoded string" if keep_text else ""))
