"""Five corpus stages, each written as Parquet and read again as the next one's documents.

Part of subpackage ``llm``: like it, nothing else in the library imports this file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofmill.llm import bpe, decontaminate, lines, near, quality
from proofmill.llm.common import carried, table, written
from proofmill.llm.queries import vocabulary_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, as they came; a null or empty text is rejected."""
    return quality.quality_rules(docs, table(spark, sf_dir, "labels")).where("kept").select("doc.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their recurring lines; n_chars follows the text, a null text stays null, all else is as it came."""
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return lines.dedup_lines(docs).select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with its least doc_id, and all rows without a doc_id.

    Where rows repeat that doc_id, each different text stays once, with the least of its other columns (as JSON).
    """
    first = written(near.near_duplicates(docs).where("doc_id = class_id").select("doc_id").distinct(), "firsts")
    kept = carried(docs).join(first, F.col("doc.doc_id") == first["doc_id"], "left_semi")
    order = Window.partitionBy("doc.doc_id", F.xxhash64("doc.text"), "doc.text").orderBy(F.to_json("doc"))
    kept = kept.withColumn("at", F.row_number().over(order)).where("at = 1").select("doc")
    return kept.unionByName(carried(docs).where("doc.doc_id is null")).select("doc.*")


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates, as they came; a row is judged with those that share its doc_id, null too."""
    bad = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id").distinct()
    bad = written(bad, "contaminated")
    return carried(docs).join(bad, F.col("doc.doc_id").eqNullSafe(bad["doc_id"]), "left_anti").select("doc.*")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded text of what is left, a row for each; a null text counts as empty."""
    return bpe.encode_decode(docs, vocabulary_path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("minhash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("bpe encoding and decoding", bpe_stage),
]

#: SQL has no byte-pair encoding and no hashed model; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
