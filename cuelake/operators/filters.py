"""Row filters over cues (file_id, pos, idx, from_ms, to_ms, text). The first accepted cue of a file is kept unseen."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cuelake.functions import hi, style, text
from cuelake.operators.kept import durable
from cuelake.options import FixOptions


def _in_file() -> WindowSpec:
    return Window.partitionBy("file_id").orderBy("pos")


def normalized(df: DataFrame, options: FixOptions) -> DataFrame:
    """Clean, style tags, hearing-impaired cues, decorative lines, clean; in that order."""
    c = text.clean_text(F.col("text"))
    if options.strip_style:
        c = style.strip_style(c)
    if options.strip_hi:
        c = hi.strip_hi(c, options.strip_hi_mode)
    return df.withColumn("text", text.clean_text(text.drop_decorative(c)))


def skip_translator(df: DataFrame) -> DataFrame:
    """Without the leading cues of each file that credit a translator."""
    begun = F.max(~text.is_translator_credit(F.col("text"))).over(_in_file().rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_begun", begun).filter("_begun").drop("_begun")


def mark_first(df: DataFrame) -> DataFrame:
    return df.withColumn("is_first", F.row_number().over(_in_file()) == 1)


def drop_empty(df: DataFrame) -> DataFrame:
    return df.filter("is_first OR text <> ''")


def drop_inverted(df: DataFrame) -> DataFrame:
    return df.filter("is_first OR from_ms <= to_ms")


def dedup_cues(df: DataFrame) -> DataFrame:
    """Of later cues with equal times and text the first; the file's first cue doesn't count as seen."""
    same = Window.partitionBy("file_id", "is_first", "from_ms", "to_ms", "text").orderBy("pos")
    return df.withColumn("_nth", F.row_number().over(same)).filter("_nth = 1").drop("_nth")


def survivors(df: DataFrame, options: FixOptions) -> DataFrame:
    """The rows that the merge sees, with normalised text: without leading credits, and after a file's first cue without empty,
    inverted and repeated ones. A file's first cue is an aggregate that goes back to the rows by join, so that no file needs
    one task; the normalised rows are kept for it."""
    rows = durable(normalized(df, options))
    counts = ~text.is_translator_credit(F.col("text")) if options.skip_translator else F.lit(True)
    firsts = rows.groupBy("file_id").agg(F.min(F.when(counts, F.col("pos"))).alias("_first"))
    out = rows.join(firsts, "file_id").filter(F.col("pos") >= F.col("_first")).withColumn("is_first", F.col("pos") == F.col("_first"))
    return dedup_cues(drop_inverted(drop_empty(out))).drop("is_first", "_first")
