"""Sorting, numbering and shifting of cues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sort_cues(df: DataFrame) -> DataFrame:
    """pos by (from, to, idx) within each file; idx is unique there, so the order is total."""
    by = Window.partitionBy("file_id").orderBy("from_ms", "to_ms", "idx")
    return df.withColumn("pos", F.row_number().over(by).cast("long"))


def reindex(df: DataFrame) -> DataFrame:
    """idx 1..n in the order of pos."""
    return df.withColumn("idx", F.row_number().over(Window.partitionBy("file_id").orderBy("pos")).cast("long"))


def validate_idx(df: DataFrame) -> DataFrame:
    """(file_id, expected, found): the first cue of each file whose idx isn't its place; no row for a sound file."""
    numbered = df.withColumn("expected", F.row_number().over(Window.partitionBy("file_id").orderBy("pos")).cast("long"))
    return numbered.filter("idx <> expected").groupBy("file_id").agg(F.min("expected").alias("expected"), F.min_by("idx", "expected").alias("found"))


def numbered(df: DataFrame) -> DataFrame:
    """As a reader wants cues: idx 1..n in each file, and was_misnumbered, the warning that a file's own numbers weren't that."""
    file = Window.partitionBy("file_id")
    right = df.withColumn("_nth", F.row_number().over(file.orderBy("pos")).cast("long"))
    return right.withColumn("was_misnumbered", F.max(~F.col("idx").eqNullSafe(F.col("_nth"))).over(file)).withColumn("idx", F.col("_nth")).drop("_nth")


def shift_time(df: DataFrame, shift_ns: int, mode: str = "FAILFAST") -> DataFrame:
    """Both times moved by nanoseconds and cut to milliseconds; none is a no-op. A file in which a time would be below zero
    fails: FAILFAST raises, PERMISSIVE drops its rows."""
    if not shift_ns:
        return df
    moved = {c: F.col(c) * 1_000_000 + F.lit(shift_ns) for c in ("from_ms", "to_ms")}
    below = (moved["from_ms"] < 0) | (moved["to_ms"] < 0)
    if mode == "PERMISSIVE":
        whole = Window.partitionBy("file_id")
        df = df.withColumn("_bad", F.max(below).over(whole)).filter("NOT _bad").drop("_bad")
        below = F.lit(False)
    failed = F.raise_error(F.concat(F.lit("a shifted time is negative in "), F.col("file_id").cast("string"))).cast("bigint")
    return df.withColumns({c: F.when(below, failed).otherwise(F.floor(m / 1_000_000).cast("bigint")) for c, m in moved.items()})
