"""Evidence bundles: reading lines and files with their digests, and writing results."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import digest_form

MAX_FILE = 512 * 1024 * 1024
RECORDS = T.StructType([T.StructField("sources", T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("class", T.StringType())]))), T.StructField("files", T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("sha256", T.StringType())])))])


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, ordinal, line) of all lines of the files below a path, blank ones left out.

    The ordinal ascends with the line's place in its file: the first byte of the split it was read
    with, and its number there (a line has a byte at least, so splits never overlap).  One file scan;
    lines are numbered split by split, so a file of any size is read in parallel.
    """
    rows = spark.read.option("recursiveFileLookup", "true").text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("first"), F.monotonically_increasing_id().alias("m"), F.col("value").alias("line"))
    at = F.row_number().over(Window.partitionBy("file", "first").orderBy("m")) - 1
    return rows.withColumn("ordinal", F.col("first") + at).where(F.trim("line") != "").select("file", "ordinal", "line")


def scan_table(spark: SparkSession, path: str) -> DataFrame:
    """The same from Parquet with a ``line`` column: file and row index come with the scan."""
    return spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("ordinal"), "line")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path relative to the bundle, bytes, sha256); a file over the limit has no digest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath().rstrip("/")
    name = F.substring_index(F.col("path"), base + "/", -1)
    return files.select(name.alias("path"), F.col("length").alias("bytes"), F.when(F.col("length") <= MAX_FILE, F.sha2("content", 256)).alias("sha256"))


def verify_files(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, problem) of files that are missing or differ from ``manifest(path, sha256)``."""
    want = manifest.select("path", digest_form(F.col("sha256")).alias("want"))
    both = want.join(found, "path", "left")
    return both.where(~F.col("want").eqNullSafe(F.col("sha256"))).select("path", F.when(F.col("bytes").isNull(), "missing").when(F.col("sha256").isNull(), "too large").otherwise("digest differs").alias("problem"))


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The manifest's sources (source, declared_class) and files (path, sha256)."""
    one = spark.read.schema(RECORDS).json(path, multiLine=True)
    sources = one.select(F.explode("sources").alias("s")).select(F.col("s.id").alias("source"), F.col("s.class").alias("declared_class"))
    return sources, one.select(F.explode("files").alias("f")).select("f.*")


def dataset_digest(found: DataFrame) -> str:
    """SHA-256 over the sorted lines ``path digest``; one line a file."""
    lines = F.array_sort(F.collect_list(F.concat_ws(" ", "path", "sha256")))
    return found.agg(F.sha2(F.array_join(lines, "\n"), 256)).first()[0]


#: Hexadecimal digits of a path's digest that name the groups of files of each level of a tree digest.
LEVELS = (6, 3, 0)


def tree_digest(found: DataFrame) -> str:
    """SHA-256 of a data set of any number of files, the same however its rows are dealt: files in groups by
    the digest of their path, a digest over the sorted lines of each group, and so on up to one."""
    rows = found.select(F.sha2("path", 256).alias("at"), F.concat_ws(" ", "path", "sha256").alias("line"))
    for digits in LEVELS:
        rows = rows.groupBy(F.substring("at", 1, digits).alias("at")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("d"))
        rows = rows.select("at", F.concat_ws(" ", "at", "d").alias("line"))
    top = rows.first()
    return top["line"].strip() if top else hashlib.sha256(b"").hexdigest()


def collect(parts: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Union of several sources' events, and (source, complete): complete only where it yielded events."""
    first = next(iter(parts.values()))
    names = first.sparkSession.createDataFrame([(n,) for n in parts], "source_name string")
    rows = reduce(DataFrame.unionByName, [df.withColumn("source_name", F.lit(n)) for n, df in parts.items()])
    counts = rows.groupBy("source_name").agg(F.count("*").alias("n"))
    return rows, names.join(counts, "source_name", "left").select("source_name", F.coalesce(F.col("n") > 0, F.lit(False)).alias("complete"))


def write_bundle(events: DataFrame, path: str) -> DataFrame:
    """Events in order of time and id, the source dimension derived from them, and the manifest of both: (path, bytes, sha256)."""
    spark = events.sparkSession
    events.repartitionByRange("time", "id").sortWithinPartitions("time", "id").write.parquet(f"{path}/events")
    events.select("source", F.col("source_class").alias("declared_class")).distinct().write.parquet(f"{path}/sources")
    found = file_digests(spark, path).where("path like '%.parquet'")
    found.coalesce(1).write.json(f"{path}/manifest")  # one row a file
    return spark.read.schema(found.schema).json(f"{path}/manifest")


def write_quarantine(rows: DataFrame, path: str) -> None:
    rows.where("reason is not null").write.partitionBy("reason").json(path)


def write_assertions(assertions: DataFrame, path: str, form: str = "parquet") -> None:
    """Assertions as parquet or json, or as the six-column flat export sorted by subject and control."""
    if form == "csv":
        flat = assertions.select("subject", "control", "outcome", "severity", "applicable", "failed")
        flat.orderBy("subject", "control").write.option("header", True).csv(path)
    else:
        assertions.write.format(form).save(path)


def evidence_submission(assertions: DataFrame, pointers: DataFrame, checked_at: str) -> DataFrame:
    """(control_id, subject, outcome, digest, evidence, checked_at); raises where a required field is missing."""
    refs = pointers.groupBy("subject", "checks").agg(F.array_sort(F.collect_set("focus")).alias("evidence"))
    out = assertions.join(refs, ["subject", "checks"], "left").select(
        F.col("control").alias("control_id"), "subject", "outcome", F.sha2(F.concat_ws("|", "subject", "catalog", "control", "outcome", "applicable", "failed"), 256).alias("digest"), F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"), F.lit(checked_at).alias("checked_at")
    )
    if out.where("control_id is null or subject is null or outcome is null").limit(1).count():
        raise ValueError("an assertion lacks a required field")
    return out
