"""Hash chains of evidence streams: broken content, gaps, reordering, late clocks, strength."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .ingest import BLOCK

GENESIS = "0" * 64


def links(rows: DataFrame) -> DataFrame:
    """Adds idx (position in arrival order), back (hash of the row before) and three findings per row.

    ``broken``: the stored hash is not that of the content; ``unlinked``: prev is not the hash before;
    ``gap``: an unlinked row whose prev no row of its stream has (otherwise it is reordered).
    """
    rows = rows.withColumn("_block", F.floor(F.col("ordinal") / BLOCK))
    # only blocks are put in order over a whole stream: rows before each, and the hash that the one before ends with
    over, here = Window.partitionBy("stream").orderBy("_block"), Window.partitionBy("stream", "_block").orderBy("ordinal")
    ends = rows.groupBy("stream", "_block").agg(F.count("*").alias("_n"), F.max_by("hash", "ordinal").alias("_last"))
    before = F.coalesce(F.sum("_n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select("stream", "_block", before.alias("_before"), F.lag("_last", 1, GENESIS).over(over).alias("_entry"))
    nth = F.row_number().over(here)
    out = rows.join(ends, ["stream", "_block"]).withColumns({"idx": F.col("_before") + nth - 1, "back": F.when(nth == 1, F.col("_entry")).otherwise(F.lag("hash").over(here))})
    out, rows = out.drop("_block", "_before", "_entry"), rows.drop("_block")
    out = out.withColumn("broken", F.coalesce(F.col("hash") != F.col("content_hash"), F.lit(True))).withColumn("unlinked", ~F.col("prev").eqNullSafe(F.col("back")))
    # membership by a join on the unlinked rows alone, not by collecting a stream
    known = rows.select("stream", F.col("hash").alias("prev"), F.lit(True).alias("_known")).distinct()
    lost = out.where("unlinked").select("stream", "idx", "prev").join(known, ["stream", "prev"], "left")
    lost = lost.select("stream", "idx", (F.col("_known").isNull() & (F.col("prev") != GENESIS)).alias("gap"))
    return out.join(lost, ["stream", "idx"], "left").withColumn("gap", F.coalesce("gap", F.lit(False)))


def stream_status(rows: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """One row per stream: strength, status, first_bad_index, n_events.

    The first rule that finds anything decides: failed content, then the first broken link (gap or
    reordered), then an event later than the newest anchor, then what the strength claims.  Rows may
    carry ``strength`` and ``signed``; without them a stream is export_chained.
    """
    for name, kind in (("strength", "string"), ("signed", "boolean")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    newest = None if anchors is None else anchors.groupBy("stream").agg(F.max("anchor_time").alias("newest"))
    one = rows.withColumn("newest", F.lit(None).cast("string")) if newest is None else rows.join(newest, "stream", "left")
    got = written(_first_findings(one), "streams")
    # whether a row of the stream has the hash that its first unlinked row names; only where the status turns on it
    open_ = got.where("f is null and l is not null").select("stream", F.col("l_prev").alias("hash")).where(F.col("hash").isNotNull() & (F.col("hash") != GENESIS))
    if open_.isEmpty():
        got = got.withColumn("g", F.lit(False))
    else:
        known = rows.select("stream", "hash").join(open_, ["stream", "hash"], "left_semi").select("stream").distinct()
        lost = open_.join(known, "stream", "left_anti").select("stream", F.lit(True).alias("g"))
        got = got.join(lost, "stream", "left").withColumn("g", F.coalesce("g", F.lit(False)))
    status = (
        F.when(F.col("f").isNotNull(), "failed")
        .when(F.col("l").isNotNull(), F.when(F.col("g"), "gap").otherwise("reordered"))
        .when(F.col("t").isNotNull(), "time_suspect")
        .when(F.col("strength") == "source_signed", F.when(F.col("signed"), "verified").otherwise("unsigned"))
        .when((F.col("strength") == "export_anchored") & F.col("anchored"), "verified")
        .otherwise("verified_weak")
    )
    return got.select("stream", "strength", status.alias("status"), F.coalesce("f", "l", "t").cast("long").alias("first_bad_index"), "n_events")


def _first_findings(rows: DataFrame) -> DataFrame:
    """One row per stream: n_events, strength, signed, anchored, the index of the first broken row (f), of the
    first unlinked one (l, with its prev) and of the first one later than ``newest`` (t).

    Rows are read and sorted once, in blocks of ordinals; a block tells the least place of each finding
    in itself, and only blocks are put in order over a whole stream.
    """
    rows = rows.withColumns({"_block": F.floor(F.col("ordinal") / BLOCK), "_broken": F.coalesce(F.col("hash") != F.col("content_hash"), F.lit(True)), "_late": F.col("time") > F.col("newest")})
    here, over = Window.partitionBy("stream", "_block").orderBy("ordinal"), Window.partitionBy("stream").orderBy("_block")
    rows = rows.select("stream", "_block", "ordinal", "hash", "prev", "strength", "signed", "newest", "_broken", "_late", F.row_number().over(here).alias("_nth"), F.lag("hash").over(here).alias("_back"))
    first = lambda test: F.min(F.when(test, F.col("_nth")))
    inner = (F.col("_nth") > 1) & ~F.col("prev").eqNullSafe(F.col("_back"))
    blocks = rows.groupBy("stream", "_block").agg(
        F.count("*").alias("_n"),
        F.max_by("hash", "_nth").alias("_last"),
        F.max(F.when(F.col("_nth") == 1, F.col("prev"))).alias("_head"),
        first(F.col("_broken")).alias("_f"),
        F.min(F.when(inner, F.struct("_nth", "prev"))).alias("_l"),
        first(F.col("_late")).alias("_t"),
        F.min(F.when(F.col("strength").isNotNull(), F.struct("ordinal", "strength"))).alias("_strength"),
        F.bool_and(F.coalesce("signed", F.lit(False))).alias("signed"),
        F.bool_or(F.col("newest").isNotNull()).alias("anchored"),
    )
    before = F.coalesce(F.sum("_n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumns({"_before": before, "_entry": F.lag("_last", 1, GENESIS).over(over)})
    # the first row of a block follows the last one of the block before
    head = F.when(~F.col("_head").eqNullSafe(F.col("_entry")), F.struct(F.lit(1).alias("_nth"), F.col("_head").alias("prev")))
    blocks = blocks.withColumn("_l", F.coalesce(head, "_l"))
    at = lambda nth: F.col("_before") + nth - 1
    unlinked = F.min(F.when(F.col("_l").isNotNull(), F.struct(at(F.col("_l._nth")).alias("l"), F.col("_l.prev").alias("prev"))))
    out = blocks.groupBy("stream").agg(
        F.sum("_n").alias("n_events"),
        F.coalesce(F.min("_strength")["strength"], F.lit("export_chained")).alias("strength"),
        F.min(at(F.col("_f"))).alias("f"),
        unlinked.alias("_u"),
        F.min(at(F.col("_t"))).alias("t"),
        F.bool_and("signed").alias("signed"),
        F.bool_or("anchored").alias("anchored"),
    )
    return out.select("stream", "n_events", "strength", "f", F.col("_u.l").alias("l"), F.col("_u.prev").alias("l_prev"), "t", "signed", "anchored")


def signatures(rows: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Adds signed: ``sig_ref`` names a file of the bundle, ``files(path)``; without a listing, any name will do."""
    named = F.coalesce(F.nullif("sig_ref", F.lit("")).isNotNull(), F.lit(False))
    if files is None:
        return rows.withColumn("signed", named)
    there = files.select(F.col("path").alias("sig_ref"), F.lit(True).alias("_there")).distinct()
    return rows.join(there, "sig_ref", "left").withColumn("signed", named & F.coalesce("_there", F.lit(False))).drop("_there")
