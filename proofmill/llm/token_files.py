"""Token ids in ORC: whole texts encoded by the tokenizers library, written in the order of doc_id, read back by stripe.

``write_tokens`` lays out a folder of two ORC tables.  ``ids`` has a row per document (doc_id, part,
at, n_tokens, ids): the ids are a list of integers, which ORC stores run-length encoded and
bit-packed; files and the rows in them ascend by doc_id, with a row index every 1,000 rows and a
Bloom filter on doc_id, so a reader of some ids skips files, stripes and row groups by their
metadata alone, and a reader of all of them takes the stripes in parallel.  ``parts`` has a row per
file: how many ids stand in the files before it.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids of pieces of text that one Python worker remembers; beyond it the memory starts anew.
MEMORY = 6_000_000
#: Bytes of text encoded at once; a longer text stands alone.
BATCH = 1 << 20
#: Keys of the two 64-bit hashes by which a piece is remembered.
KEYS = "of pieces, first", "of pieces,second"
#: Fixed value: the characters that are white space to the library, or might be taken for it.
WHITE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
STRIPE, STRIDE, FALSE_POSITIVES = 32 << 20, 1_000, 0.01


class LibraryEncoder:
    """Ids of whole texts, as the library's ``encode`` gives them, for many texts at a time.

    Byte-level pre-tokens never cross the place before a single space, nor before a single line break,
    that stands between two characters other than white space.  Texts with no other white space are
    therefore cut there, the library encodes the different pieces once, strung together, and the
    bytes of its tokens tell which are whose.  Every other text, one that holds a special string,
    and every text of another kind of tokenizer goes to the library by itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        before = own.get("pre_tokenizer") or {}
        self.by_piece = own.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        special = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        other = WHITE.replace(r"\x09-\x0D", r"\x09\x0B-\x0D").replace(r"\x1C-\x20", r"\x1C-\x1F")
        self.odd = "|".join([f"[{WHITE}][{WHITE}]", f"\\A[{WHITE}]", f"[{WHITE}]\\z", f"[{other}]", *special])
        vocabulary = self.library.get_vocab()
        self.bytes = np.zeros(max(vocabulary.values(), default=0) + 1, "int64")
        for token, i in vocabulary.items():
            self.bytes[i] = len(token)  # a character for each byte
        self.forget()

    def forget(self) -> None:
        """Of each piece known: two hashes, ascending by the first, where its ids begin and how many they are."""
        self.first, self.second = np.zeros(0, "uint64"), np.zeros(0, "uint64")
        self.at, self.size, self.ids = np.zeros(0, "int32"), np.zeros(0, "int32"), np.zeros(0, "int32")

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "int32")

    def learn(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Add the ids of pieces, each without its leading space: where they begin, and how many they are."""
        strung = "".join([w if w.startswith("\n") else " " + w for w in new])
        ids = np.array(self.library.encode_batch_fast([strung], add_special_tokens=False)[0].ids, "int32")
        ends = np.cumsum(pc.binary_length(pa.array(new)).to_numpy() + [not w.startswith("\n") for w in new])
        at = np.concatenate(([0], np.searchsorted(np.cumsum(self.bytes[ids]), ends) + 1)).astype("int32")
        old, self.ids = len(self.ids), np.concatenate((self.ids, ids))
        return old + at[:-1], np.diff(at)

    def pieces(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of plain texts.  Each text gets a line break in front, whose one id goes again."""
        if len(self.ids) > MEMORY:
            self.forget()
        line_break, nothing = pa.scalar("\n", "large_string"), pa.scalar("", "large_string")
        cut = pc.split_pattern(pc.binary_join_element_wise(line_break, pc.replace_substring(texts, "\n", " \n"), nothing), " ")
        coded, rows = cut.values.dictionary_encode(), cut.offsets.to_numpy()
        words, of = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy()
        first, second = (hash_array(words, hash_key=k, categorize=False) for k in KEYS)
        place = np.searchsorted(self.first, first)
        spot = np.minimum(place, max(len(self.first) - 1, 0))
        taken = self.first[spot] == first if len(self.first) else np.zeros(len(words), bool)
        known = taken & (self.second[spot] == second) if len(self.first) else taken
        at, size = (x[spot] if len(x) else np.zeros(len(words), "int32") for x in (self.at, self.size))
        if not known.all():
            at[~known], size[~known] = self.learn(words[~known].tolist())
            add = np.flatnonzero(~taken)
            add = add[np.argsort(first[add], kind="stable")]
            self.first, self.second, self.at, self.size = (np.insert(x, place[add], y[add]) for x, y in ((self.first, first), (self.second, second), (self.at, at), (self.size, size)))
        sizes = size[of]
        ends = np.cumsum(sizes, dtype="int32")
        ids = self.ids[np.repeat(at[of] - ends + sizes, sizes) + np.arange(ends[-1], dtype="int32")]
        ends = np.concatenate(([0], ends))[rows]
        return [ids[a + 1 : b] for a, b in pairwise(ends)]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        texts = texts.cast("large_string")
        odd = pc.match_substring_regex(texts, self.odd) if self.by_piece else pa.array([True] * len(texts))
        done = iter(self.pieces(texts.filter(pc.invert(odd))) if len(odd) and not pc.all(odd).as_py() else ())
        return [self.whole(text.as_py()) if alone else next(done) for text, alone in zip(texts, odd.to_pylist(), strict=True)]


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def batches(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """From where to where texts are encoded at once, by BATCH."""
    sizes = pc.binary_length(texts).to_numpy().cumsum() // BATCH
    return pairwise([0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(sizes)])


def encoded(docs: DataFrame, vocab_path: str, end_id: int) -> DataFrame:
    """Rows (doc_id, part, at, n_tokens, ids) of ``docs`` in ascending order: part counts the runs of
    doc_ids, at the ids before the document in its run."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "int32")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, at = library_encoder(vocab_path), TaskContext.get().partitionId(), 0
        for frame in frames:
            for a, b in batches(frame.column(1)):
                rows = [x for ids in own.encode(frame.column(1).slice(a, b - a)) for x in (ids, end)]
                n = np.fromiter(map(len, rows), "int64", len(rows)).reshape(-1, 2).sum(axis=1)
                places = np.concatenate(([0], np.cumsum(n)))
                ids = pa.ListArray.from_arrays(pa.array(places, "int32"), pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([frame.column(0).slice(a, b - a), pa.array([part] * len(n), "int32"), pa.array(at + places[:-1]), pa.array(n), ids], ["doc_id", "part", "at", "n_tokens", "ids"])
                at += int(places[-1])
            pa.default_memory_pool().release_unused()

    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("tie"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    return rows.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, part int, at long, n_tokens long, ids array<int>")


def write_tokens(docs: DataFrame, vocab_path: str, path: str, end_id: int = 2) -> None:
    """Write the ids of every whole text of ``docs(doc_id, text)``, ``end_id`` after each, to the folder ``path``.

    Documents stand in ascending order of doc_id, null first; rows that share a doc_id by a hash of
    their text, and each has its row.  A null text counts as empty and has the end id alone; other
    columns are not read; an empty table gives empty tables.  One shuffle, of the texts, by ranges of
    (doc_id, hash); a task holds a megabyte of texts, or one longer text, and their ids.  One number per file passes
    through the driver.
    """
    spark = docs.sparkSession
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": FALSE_POSITIVES, "orc.row.index.stride": STRIDE, "orc.stripe.size": STRIPE}
    encoded(docs, vocab_path, end_id).write.options(**options).orc(f"{path}/ids")
    sizes = spark.read.orc(f"{path}/ids").groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    before = [0, *accumulate(r["n"] for r in sizes)]
    spark.createDataFrame([(r["part"], b) for r, b in zip(sizes, before, strict=False)], "part int, before long").coalesce(1).write.orc(f"{path}/parts")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) of a written folder; a filter on doc_id reaches the files' metadata.

    The join carries one row per file, as many as the scan's own list of files.
    """
    schema = "part int, before long"
    rows, parts = spark.read.orc(f"{path}/ids"), spark.read.schema(schema).orc(f"{path}/parts")
    return rows.join(F.broadcast(parts), "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids")


def token_digests(tokens: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and the unsigned crc32 of the ids as little-endian 32-bit integers."""
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            lists = frame.column(3)
            raw, at = np.ascontiguousarray(lists.values.to_numpy(), "<u4").view("u1"), lists.offsets.to_numpy().astype("int64") * 4
            crc = pa.array([zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], "int64")
            yield pa.RecordBatch.from_arrays([frame.column(0), frame.column(1), frame.column(2), crc], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
