"""The two pipelines over cues: fix() cleans and re-times, translate() sends texts away and joins them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.operators import merge, order
from cuelake.operators.kept import durable
from cuelake.operators.translate import translate  # noqa: F401
from cuelake.options import FixOptions

CUE = ["file_id", "pos", "idx", "from_ms", "to_ms", "text"]


def fix(df: DataFrame, options: FixOptions | None = None, mode: str = "FAILFAST") -> DataFrame:
    """Merge pass; files whose cues came out of order are sorted and merged once more, normalisation included; then the
    shift. The input is read once: the first pass is kept for the second."""
    options = options or FixOptions()
    once = durable(merge.merge_cues(df, options))
    return order.shift_time(merge.merge_again(once, options).select(*CUE), options.shift_ns, mode)


def fix_files(files: DataFrame, options: FixOptions | None = None, mode: str = "FAILFAST") -> DataFrame:
    """(file_id, content, was_empty, changed) from (file_id, content): scan, fix, render, and the input where nothing is left."""
    from cuelake.sources import srt

    parsed = srt.parse(files)
    if mode == "FAILFAST":
        failed = F.raise_error(F.concat_ws(": ", "file_id", "_error")).cast("string")
        parsed = parsed.withColumn("text", F.when(F.col("_error").isNotNull(), failed).otherwise(F.col("text")))
    return srt.or_original(srt.render(fix(parsed.filter("_error IS NULL").drop("_error"), options, mode)), files)
