"""Functions for spark.sql: register(spark) makes them temporary functions. `srt_cues(content)` is a table function, a row for each
cue; `render_srt(collect_list(struct(pos, from_ms, to_ms, text)))` is its counterpart over groups."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from cuelake.functions import style
from cuelake.functions.wire import _parse
from cuelake.sources import srt


class SrtCues:
    """(pos, idx, from_ms, to_ms, text) of a file's content; ValueError at the first malformed cue, nothing of a null."""

    def eval(self, content: str) -> Iterator[tuple]:
        for _, *cue in srt.read_cues("", content or ""):
            yield tuple(cue)


def register(spark: SparkSession) -> None:
    """clean_text, is_decorative_line, format_time and mask_key as SQL functions; strip_style as a Python UDF, parse_ndjson as an Arrow UDF."""
    w = r"\\p{IsWhite_Space}"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION clean_text(t STRING) RETURNS STRING RETURN array_join(filter(transform(split(replace(t, '\\r\\n', '\\n'), '\\n', -1), x -> regexp_replace(x, '^{w}+|{w}+\\\\z', '')), x -> x <> ''), '\\n')")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION is_decorative_line(t STRING) RETURNS BOOLEAN RETURN t RLIKE '^{w}*([-:._♪♫])(?:{w}*\\\\1)*{w}*\\\\z'")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION format_time(ms BIGINT) RETURNS STRING RETURN format_string('%02d:%02d:%02d,%03d', ms DIV 3600000, ms DIV 60000 % 60, ms DIV 1000 % 60, ms % 1000)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION mask_key(t STRING) RETURNS STRING RETURN CASE length(t) WHEN 0 THEN '' WHEN 1 THEN '*' WHEN 2 THEN concat(left(t, 1), '*') ELSE concat(left(t, 1), repeat('*', length(t) - 2), right(t, 1)) END")
    spark.sql(r"""CREATE OR REPLACE TEMPORARY FUNCTION render_srt(cues ARRAY<STRUCT<pos: BIGINT, from_ms: BIGINT, to_ms: BIGINT, text: STRING>>) RETURNS STRING
        RETURN array_join(transform(sort_array(cues), (c, i) -> format_string('%d\n%02d:%02d:%02d,%03d --> %02d:%02d:%02d,%03d\n%s\n\n', i + 1,
            c.from_ms DIV 3600000, c.from_ms DIV 60000 % 60, c.from_ms DIV 1000 % 60, c.from_ms % 1000,
            c.to_ms DIV 3600000, c.to_ms DIV 60000 % 60, c.to_ms DIV 1000 % 60, c.to_ms % 1000, c.text)), '')""")
    spark.udtf.register("srt_cues", udtf(SrtCues, returnType="pos long, idx long, from_ms long, to_ms long, text string"))
    spark.udf.register("strip_style", style._strip)
    spark.udf.register("parse_ndjson", _parse)
