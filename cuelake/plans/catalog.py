"""All queries of the timed-text surface, with the SQL that answers them where SQL can."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake import sql
from cuelake.functions import hi, language, layout, style, text, timing, wire
from cuelake.operators import batches, client, filters, merge, order
from cuelake.operators import translate as translating
from cuelake.operators.kept import durable, shared_root
from cuelake.options import FixOptions, TranslateOptions
from cuelake.plans import pipeline
from cuelake.plans.views import CUES_SQL, DEC_SQL, cues, dec
from cuelake.sources import collection, srt

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


# Text

_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _clean(x: str) -> str:
    return f"array_to_string(list_filter(list_transform(string_split(replace({x}, chr(13) || chr(10), chr(10)), chr(10)), lambda l: {_TRIM.format('l')}), lambda l: l <> ''), chr(10))"


_DECORATIVE = "regexp_matches({0}, '^\\s*(-(\\s*-)*|:(\\s*:)*|\\.(\\s*\\.)*|_(\\s*_)*|♪(\\s*♪)*|♫(\\s*♫)*)\\s*$')"


def _undecorated(x: str) -> str:
    return f"array_to_string(list_filter(string_split({x}, chr(10)), lambda l: NOT {_DECORATIVE.format('l')}), chr(10))"


def _on_dec(name: str, column: Callable[[Column], Column], sql: str | None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return dec(spark, sf_dir).select("file_id", "idx", column(F.col("text")).alias("text"))

    _query(name, sql and f"SELECT file_id, idx, {sql} AS text FROM ({DEC_SQL}) d")(run)


_on_dec("clean_text", text.clean_text, _clean("text"))
_on_dec("decorative_lines", text.drop_decorative, _undecorated("text"))
_on_dec("structural_line", lambda c: text.structural_line(F.concat(F.lit(" ﻿ "), text.lines(c)[0])), f"regexp_replace({_clean("regexp_replace(' ' || chr(65279) || ' ' || string_split(text, chr(10))[1], '^' || chr(65279), '')")}, '^' || chr(65279), '')")


def _styled_sql(rows: str) -> str:
    """CTEs that end with `styled`: the columns of rows (id, text, ...) with text stripped of its matched tags. `walk` goes
    through a text's tags with a stack."""
    inner = _TRIM.format("raw[2:length(raw) - 1]")
    named = _TRIM.format("CASE WHEN x[1] = '/' THEN x[2:] ELSE x END")
    bare = _TRIM.format("CASE WHEN y[-1] = '/' THEN y[:-2] ELSE y END")
    return f"""
given AS ({rows}),
pieces AS (SELECT id, generate_subscripts(p, 1) AS i, unnest(p) AS raw FROM (SELECT id, regexp_extract_all(text, '<[^>]*>|<[^>]*$|[^<]+') AS p FROM given) q),
inners AS (SELECT id, i, raw, CASE WHEN raw[1] = '<' AND raw[-1] = '>' AND length(raw) >= 3 THEN {inner} END AS x FROM pieces),
named AS (SELECT *, {named} AS y FROM inners),
bare AS (SELECT *, lower(regexp_extract({bare}, '^[^\\s]+')) AS name FROM named),
tags AS (SELECT id, i, raw, name, CASE WHEN x IS NULL OR x[1] IN ('!', '?') OR NOT regexp_full_match(name, '\\p{{L}}[\\p{{L}}\\p{{Nd}}:_-]*') THEN NULL
                                     WHEN x[1] = '/' THEN CASE WHEN y[-1] = '/' THEN NULL ELSE 'close' END
                                     WHEN y[-1] = '/' OR name = 'br' THEN 'self' ELSE 'open' END AS kind FROM bare),
steps AS (SELECT id, i, name, kind, row_number() OVER (PARTITION BY id ORDER BY i) AS k FROM tags WHERE kind IS NOT NULL),
walk AS (
  SELECT id, 0::BIGINT AS k, []::STRUCT(name VARCHAR, i BIGINT)[] AS stack, []::BIGINT[] AS gone FROM given
  UNION ALL
  SELECT w.id, t.k,
         CASE WHEN t.kind = 'open' THEN list_append(w.stack, struct_pack(name := t.name, i := t.i)) WHEN t.kind = 'close' AND w.stack[-1].name = t.name THEN w.stack[:-2] ELSE w.stack END,
         CASE WHEN t.kind = 'self' THEN list_append(w.gone, t.i) WHEN t.kind = 'close' AND w.stack[-1].name = t.name THEN list_concat(w.gone, [t.i, w.stack[-1].i]) ELSE w.gone END
  FROM walk w JOIN steps t ON t.id = w.id AND t.k = w.k + 1),
ends AS (SELECT id, arg_max(gone, k) AS gone FROM walk GROUP BY id),
follow AS (SELECT t.*, list_contains(e.gone, t.i) AS removed, coalesce(string_agg(CASE WHEN t.kind IS NULL THEN t.raw ELSE '' END, '') OVER (PARTITION BY t.id ORDER BY t.i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rest FROM tags t JOIN ends e ON e.id = t.id),
joined AS (SELECT id, string_agg(CASE WHEN NOT removed THEN raw WHEN name = 'br' AND regexp_matches(rest, '^[^\n]*[^\\s]') THEN chr(10) ELSE '' END, '' ORDER BY i) AS stripped, bool_or(removed) AS some FROM follow GROUP BY id),
styled AS (SELECT g.* REPLACE (CASE WHEN j.some THEN {_clean('j.stripped')} ELSE g.text END AS text) FROM given g LEFT JOIN joined j ON j.id = g.id)"""


def _dec_id(x: str) -> str:
    return f"SELECT file_id || ':' || idx AS id, file_id, idx, {x} AS text FROM ({DEC_SQL}) d"


_on_dec("strip_style", style.strip_style, None)
ORACLES["strip_style"] = f"WITH RECURSIVE {_styled_sql(_dec_id('text'))} SELECT file_id, idx, text FROM styled"


@_query("strip_style_pages", f"WITH RECURSIVE {_styled_sql('SELECT page_id AS id, html AS text FROM pages')} SELECT id AS page_id, sha256(text) AS text_sha256 FROM styled")
def _style_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.sha2(style.strip_style(F.col("html")), 256).alias("text_sha256"))


def _hi_sql(mode: str) -> str:
    """The mode's steps one by one; the repeated ones are unrolled further than any line of the data needs."""
    plus, speakers = mode.endswith("plus"), mode.startswith("standard")
    cue = r"(?:\[[^\[\]]+\]|\([^()]+\)|\{[^{}]+\})" if plus else r"\[[^\[\]]+\]"
    inline = r"\[[^\[\]]*\]|\([^()]*\)|\{[^{}]*\}" if plus else r"\[[^\[\]]*\]"
    block = r"\[[^\]]*\n[^\]]*\]" + (r"|\([^)]*\n[^)]*\)|\{[^}]*\n[^}]*\}" if plus else "")
    steps = [f"CASE WHEN regexp_matches(l, '^(?:-\\s*)?{cue}(?:\\s*[:\\-]\\s*)?$') THEN '' ELSE l END"]
    for pattern, to in ((rf"^-\s*{cue}(?:\s*[:\-]\s*|\s+)(.+)$", r"- \1"), (rf"^{cue}(?:\s*[:\-]\s*|\s+)(.+)$", r"\1"), (rf"^(.+?)\s+{cue}$", r"\1")):
        steps += [f"CASE WHEN regexp_matches(l, '{pattern}') THEN {_TRIM.format(f"regexp_replace(l, '{pattern}', '{to}')")} ELSE l END"] * 4
    line = [f"list_transform({{0}}, lambda l: {s})" for s in steps]
    if speakers:
        bare = r"regexp_replace(regexp_replace({0}, '\s+([,.;:!?])', '\1', 'g'), '\s{{2,}}', ' ', 'g')"
        inner = f"regexp_replace(regexp_replace({_TRIM.format("regexp_replace(l, '^-', '')")}, '{inline}', ' ', 'g'), '^[A-Z][A-Z0-9 .''-]{{1,30}}:\\s*', '')"
        fixed = _TRIM.format(f"regexp_replace({_TRIM.format(bare.format(inner))}, '^[:;]+\\s*', '')")
        dashed = "'- ' || " + _TRIM.format(f"regexp_replace({fixed}, '^-', '')")
        line.append(f"list_transform({{0}}, lambda l: CASE WHEN l = '' OR {fixed} = '' THEN '' WHEN l[1] = '-' THEN {dashed} ELSE {fixed} END)")
    out = f"string_split({_clean(f"regexp_replace(text, '{block}', chr(10), 'g')")}, chr(10))"
    for x in line:
        out = x.replace("{0}", out)
    kept = f"list_filter({out}, lambda l: regexp_matches(l, '[\\p{{L}}\\p{{Nd}}]') AND NOT regexp_matches(l, '^(?:-\\s*)?{cue}(?:\\s*[:\\-]\\s*)?$'))"
    return _clean(f"array_to_string({kept}, chr(10))")


for _mode in hi.MODES:
    _on_dec(f"strip_hi_{_mode.replace('-', '_')}", lambda c, m=_mode: hi.strip_hi(c, m), _hi_sql(_mode))

_NORMAL = FixOptions(strip_style=True, strip_hi=True, strip_hi_mode="standard-plus")


@_query("normalize_text", f"WITH RECURSIVE {_styled_sql(_dec_id(_clean('text')))}, heard AS (SELECT file_id, idx, {_hi_sql('standard-plus')} AS text FROM styled) SELECT file_id, idx, {_clean(_undecorated('text'))} AS text FROM heard")
def _normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.normalized(dec(spark, sf_dir).select("file_id", "idx", "text"), _NORMAL)


# Layout. Folds in DuckDB are list_reduce over structs that hold the lines so far and the open one.


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


def _wrap_sql(x: str, most: int) -> str:
    joined = "CASE WHEN a.line = '' THEN w.line ELSE a.line || ' ' || w.line END"
    full = f"strlen({joined}) > {most}"
    state = "struct_pack(done := {0}, line := {1})"
    fold = f"list_reduce(list_prepend({state.format("''", "''")}, list_transform({_words(_TRIM.format('l'))}, lambda w: {state.format("''", 'w')})), lambda a, w: {state.format(f"CASE WHEN {full} THEN a.done || a.line || chr(10) ELSE a.done END", f"CASE WHEN {full} THEN w.line ELSE {joined} END")})"
    tag = f"({_TRIM.format('l')} LIKE '<%' AND {_TRIM.format('l')} LIKE '%>')"
    return _clean(f"array_to_string(list_transform(string_split({x}, chr(10)), lambda l: CASE WHEN {tag} THEN {_TRIM.format('l')} ELSE ({fold}).done || ({fold}).line END), chr(10))")


def _merge_sql(x: str, words: int, most: int) -> str:
    state = "struct_pack(done := {0}, line := {1})"
    joined = "CASE WHEN a.line = '' THEN w.line ELSE a.line || ' ' || w.line END"
    fits = f"NOT (w.line LIKE '<%' AND w.line LIKE '%>') AND len({_words('w.line')}) <= {words} AND (a.line = '' OR ((w.line = '' OR regexp_matches(w.line, '^(?:[&,]|\\p{{Ll}})')) AND right(a.line, 1) NOT IN ('.', '>'))) AND strlen({joined}) < {most}"
    fold = f"list_reduce(list_prepend({state.format("''", "''")}, list_transform(string_split({x}, chr(10)), lambda l: {state.format("''", _TRIM.format('l'))})), lambda a, w: {state.format(f"CASE WHEN {fits} OR a.line = '' THEN a.done ELSE a.done || a.line || chr(10) END", f"CASE WHEN {fits} THEN {joined} ELSE w.line END")})"
    return _clean(f"({fold}).done || ({fold}).line")


def _lay_out_sql(x: str) -> str:
    """x has to be a column: it is repeated."""
    return f"CASE WHEN len(string_split({x}, chr(10))) > {layout.MAX_LINES} THEN {_merge_sql(x, layout.MIN_WORDS_MERGE, layout.MAX_LINE_LENGTH)} ELSE {x} END"


@_query("wrap_lines", f"SELECT doc_id, {_wrap_sql('text', 70)} AS text FROM documents")
def _wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", layout.wrap_lines(F.col("text")).alias("text"))


_SHORT = "regexp_replace(text, '[,.] ', chr(10), 'g')"


@_query("merge_short_lines", f"SELECT file_id, idx, {_merge_sql('text', 3, 70)} AS text FROM (SELECT file_id, idx, {_SHORT} AS text FROM ({DEC_SQL}) d) s")
def _short(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.regexp_replace("text", "[,.] ", "\n")
    return dec(spark, sf_dir).select("file_id", "idx", layout.merge_short_lines(broken).alias("text"))


# Filters, on cues. The steps build on each other as in survivors().

_CREDIT = "CASE WHEN idx <= 2 AND CAST(file_id AS BIGINT) % 3 = 0 THEN 'Translator: ' || text ELSE text END"
_S0 = f"SELECT file_id, pos, idx, from_ms, to_ms, {_CREDIT} AS text FROM ({CUES_SQL}) c"
_S1 = f"SELECT * EXCLUDE (begun) FROM (SELECT *, bool_or(NOT regexp_matches(text, '(?i)traductor|traducción|traduccion|translate|translator')) OVER (PARTITION BY file_id ORDER BY pos) AS begun FROM ({_S0}) a) b WHERE begun"
_S2 = f"SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY pos) = 1 AS is_first FROM ({_S1}) f"
_S3 = f"SELECT * FROM ({_S2}) g WHERE is_first OR text <> ''"
_S4 = f"SELECT * FROM ({_S3}) h WHERE is_first OR from_ms <= to_ms"
_S5 = f"SELECT * FROM ({_S4}) i QUALIFY row_number() OVER (PARTITION BY file_id, is_first, from_ms, to_ms, text ORDER BY pos) = 1"


def _credited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cues of which some begin with a translator's credit."""
    return cues(spark, sf_dir).withColumn("text", F.when((F.col("idx") <= 2) & (F.col("file_id").cast("long") % 3 == 0), F.concat(F.lit("Translator: "), F.col("text"))).otherwise(F.col("text")))


@_query("skip_translator", _S1)
def _skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.skip_translator(_credited(spark, sf_dir))


@_query("drop_empty", _S3)
def _empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.drop_empty(filters.mark_first(_skip(spark, sf_dir)))


@_query("drop_inverted", _S4)
def _inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.drop_inverted(_empty(spark, sf_dir))


@_query("dedup_cues", _S5)
def _dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.dedup_cues(_inverted(spark, sf_dir))


# Timeline. The fold is a recursion over the rows of each file.


def _fold_sql(name: str, rows: str) -> str:
    """CTEs: {name}_s the surviving rows numbered from 1, {name}_r the fold's states, {name} the merged cues."""
    return f"""
{name}_s AS (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY pos) AS n, from_ms AS f, to_ms AS t, text AS x FROM ({rows}) q),
{name}_r AS (
  SELECT file_id, n, f AS head, t AS last_to, x AS acc, 1 AS isl, false AS late FROM {name}_s WHERE n = 1
  UNION ALL
  SELECT s.file_id, s.n, CASE WHEN k.act IN ('late', 'new') THEN s.f ELSE r.head END, s.t,
         CASE k.act WHEN 'merge' THEN r.acc || chr(10) || s.x WHEN 'absorb' THEN r.acc ELSE s.x END,
         r.isl + CASE WHEN k.act IN ('late', 'new') THEN 1 ELSE 0 END, r.late OR k.act = 'late'
  FROM {name}_r r JOIN {name}_s s ON s.file_id = r.file_id AND s.n = r.n + 1,
       LATERAL (SELECT CASE WHEN s.t < r.head THEN 'late' WHEN s.f < r.last_to THEN 'merge'
                            WHEN s.t - s.f < {merge.SHORT_MS} AND contains(r.acc, s.x) THEN 'absorb' ELSE 'new' END AS act) k),
{name} AS (SELECT file_id, isl AS pos, arg_max(head, n) AS from_ms, arg_max(last_to, n) AS to_ms, arg_max(acc, n) AS text,
                  bool_or(bool_or(late)) OVER (PARTITION BY file_id) AS out_of_order
           FROM {name}_r GROUP BY file_id, isl)"""


def _laid_out_sql(name: str, rows: str) -> str:
    """CTE {name}: laid-out cues, empty ones dropped, numbered."""
    return f"""
{name}_w AS (SELECT * REPLACE ({_wrap_sql(_clean('text'), layout.MAX_LINE_LENGTH)} AS text) FROM {rows}),
{name}_l AS (SELECT * REPLACE ({_lay_out_sql('text')} AS text) FROM {name}_w),
{name} AS (SELECT * REPLACE (row_number() OVER (PARTITION BY file_id ORDER BY pos) AS pos), row_number() OVER (PARTITION BY file_id ORDER BY pos) AS idx FROM {name}_l WHERE text <> '')"""


def _survivor_sql(rows: str) -> str:
    out = f"SELECT file_id, pos, from_ms, to_ms, {_clean(_undecorated(_clean('text')))} AS text FROM ({rows}) v"
    out = f"SELECT * EXCLUDE (begun) FROM (SELECT *, bool_or(NOT regexp_matches(text, '(?i)traductor|traducción|traduccion|translate|translator')) OVER (PARTITION BY file_id ORDER BY pos) AS begun FROM ({out}) a) b WHERE begun"
    out = f"SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY pos) = 1 AS is_first FROM ({out}) f"
    out = f"SELECT * FROM ({out}) g WHERE is_first OR (text <> '' AND from_ms <= to_ms)"
    return f"SELECT * FROM ({out}) i QUALIFY row_number() OVER (PARTITION BY file_id, is_first, from_ms, to_ms, text ORDER BY pos) = 1"


def _twice_sql(rows: str) -> str:
    """Both passes; ends with the CTE `fixed`."""
    once = f"WITH RECURSIVE {_fold_sql('m1', _survivor_sql(rows))}, {_laid_out_sql('once', 'm1')}"
    by_time = "SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY from_ms, to_ms, idx) AS pos, from_ms, to_ms, text FROM once WHERE out_of_order"
    fixed = "SELECT file_id, CAST(pos AS BIGINT) AS pos, CAST(idx AS BIGINT) AS idx, from_ms, to_ms, text FROM "
    return f"{once}, sorted AS ({by_time}), {_fold_sql('m2', _survivor_sql('SELECT * FROM sorted'))}, {_laid_out_sql('again', 'm2')}, fixed AS ({fixed} once WHERE NOT out_of_order UNION ALL {fixed} again)"



@_query("absorb_short", f"WITH RECURSIVE {_fold_sql('m1', _survivor_sql(_S0))} SELECT file_id, CAST(pos AS BIGINT) AS pos, from_ms, to_ms, text, out_of_order FROM m1")
def _absorb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merged(filters.survivors(_credited(spark, sf_dir), FixOptions())).drop("nth")


_CALM = f"SELECT * FROM ({_S0}) z WHERE to_ms - from_ms >= {merge.SHORT_MS}"
_ISLANDS = f"""
SELECT file_id, CAST(isl AS BIGINT) AS pos, arg_min(from_ms, pos) AS from_ms, arg_max(to_ms, pos) AS to_ms, string_agg(text, chr(10) ORDER BY pos) AS text, false AS out_of_order
FROM (SELECT *, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY pos) AS isl
      FROM (SELECT *, coalesce(from_ms >= lag(to_ms) OVER (PARTITION BY file_id ORDER BY pos), true) AS begins
            FROM (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY from_ms, to_ms, idx) AS pos, from_ms, to_ms, text FROM ({_CALM}) y WHERE text <> '') x) w) v
GROUP BY file_id, isl
"""


@_query("overlap_merge", _ISLANDS)
def _overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    calm = _credited(spark, sf_dir).filter((F.col("to_ms") - F.col("from_ms") >= merge.SHORT_MS) & (F.col("text") != ""))
    return merge.merged(order.sort_cues(calm)).drop("nth")


@_query("out_of_order_files", f"WITH RECURSIVE {_fold_sql('m1', _survivor_sql(_S0))} SELECT file_id, bool_or(out_of_order) AS out_of_order, count(*) AS cues FROM m1 GROUP BY file_id")
def _late(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _absorb(spark, sf_dir).groupBy("file_id").agg(F.max("out_of_order").alias("out_of_order"), F.count("*").alias("cues"))


@_query("fix_pipeline", f"{_twice_sql(_S0)} SELECT * FROM fixed")
def _fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.fix(_credited(spark, sf_dir))


@_query("sort_cues", f"SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY from_ms, to_ms, idx) AS pos, idx, from_ms, to_ms, text FROM ({CUES_SQL}) c")
def _sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.sort_cues(cues(spark, sf_dir))


_ODD = f"SELECT * REPLACE (idx * 10 AS idx) FROM ({CUES_SQL}) c WHERE CAST(file_id AS BIGINT) % 2 = 1 UNION ALL SELECT * FROM ({CUES_SQL}) c WHERE CAST(file_id AS BIGINT) % 2 = 0"


def _misnumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cues(spark, sf_dir).withColumn("idx", F.when(F.col("file_id").cast("long") % 2 == 1, F.col("idx") * 10).otherwise(F.col("idx")).cast("long"))


@_query("reindex", f"SELECT file_id, pos, row_number() OVER (PARTITION BY file_id ORDER BY pos) AS idx, from_ms, to_ms, text FROM ({_ODD}) o")
def _reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.reindex(_misnumbered(spark, sf_dir))


@_query("validate_idx", f"SELECT file_id, min(expected) AS expected, arg_min(idx, expected) AS found FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY pos) AS expected FROM ({_ODD}) o) p WHERE idx <> expected GROUP BY file_id")
def _validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.validate_idx(_misnumbered(spark, sf_dir))


@_query("shift_time", f"SELECT file_id, pos, idx, from_ms + 1250 AS from_ms, to_ms + 1250 AS to_ms, text FROM ({CUES_SQL}) c")
def _shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.shift_time(cues(spark, sf_dir), timing.parse_duration("1s250ms"))


_BACK_MS = 150_000_000


@_query("shift_time_back", f"SELECT file_id, pos, idx, from_ms - {_BACK_MS + 1} AS from_ms, to_ms - {_BACK_MS + 1} AS to_ms, text FROM ({CUES_SQL}) c QUALIFY min(least(from_ms, to_ms)) OVER (PARTITION BY file_id) > {_BACK_MS}")
def _shift_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back by whole milliseconds and a nanosecond; files that would begin below zero go."""
    return order.shift_time(cues(spark, sf_dir), -_BACK_MS * 1_000_000 - 1, "PERMISSIVE")


@_query("read_subtitles", f"SELECT file_id, pos, row_number() OVER (PARTITION BY file_id ORDER BY pos) AS idx, from_ms, to_ms, text, CAST(file_id AS BIGINT) % 2 = 1 AS was_misnumbered FROM ({_ODD}) o")
def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.numbered(_misnumbered(spark, sf_dir))


def _clock(x: str) -> str:
    return f"printf('%02d:%02d:%02d,%03d', {x} // 3600000, {x} // 60000 % 60, {x} // 1000 % 60, {x} % 1000)"


@_query("format_timing", f"SELECT file_id, idx, {_clock('from_ms')} || ' --> ' || {_clock('to_ms')} AS timing FROM ({CUES_SQL}) c")
def _format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cues(spark, sf_dir).select("file_id", "idx", timing.format_timing(F.col("from_ms"), F.col("to_ms")).alias("timing"))


@_query("parse_timing", f"SELECT file_id, idx, from_ms, to_ms FROM ({CUES_SQL}) c")
def _parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, stop = timing.parse_timing(F.concat(F.lit("at "), F.col("timing"), F.lit(" X1:40")))
    return _format(spark, sf_dir).select("file_id", "idx", start.alias("from_ms"), stop.alias("to_ms"))


@_query("scan_srt", f"SELECT file_id, pos - 1 AS pos, row_number() OVER (PARTITION BY file_id ORDER BY pos) AS idx, from_ms, to_ms, text FROM ({CUES_SQL}) c")
def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cues rendered as files and parsed again."""
    return srt.parse(srt.render(cues(spark, sf_dir))).drop("_error")


@_query("srt_cues_sql", f"SELECT file_id, pos - 1 AS pos, row_number() OVER (PARTITION BY file_id ORDER BY pos) AS idx, from_ms, to_ms, text FROM ({CUES_SQL}) c")
def _cues_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files rendered and read by the functions for SQL users."""
    sql.register(spark)
    return spark.sql("""
        WITH files AS (SELECT file_id, render_srt(collect_list(struct(pos, from_ms, to_ms, text))) AS content FROM {cues} GROUP BY file_id)
        SELECT file_id, c.pos, c.idx, c.from_ms, c.to_ms, c.text FROM files, LATERAL srt_cues(content) c""", cues=cues(spark, sf_dir))


@_query("render_srt", f"SELECT file_id, string_agg(n || chr(10) || {_clock('from_ms')} || ' --> ' || {_clock('to_ms')} || chr(10) || text || chr(10) || chr(10), '' ORDER BY n) AS content FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY pos) AS n FROM ({CUES_SQL}) c) d GROUP BY file_id")
def _render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return srt.render(cues(spark, sf_dir))


def _rendered_sql(rows: str) -> str:
    return f"SELECT file_id, string_agg(n || chr(10) || {_clock('from_ms')} || ' --> ' || {_clock('to_ms')} || chr(10) || text || chr(10) || chr(10), '' ORDER BY n) AS content FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY pos) AS n FROM {rows}) r GROUP BY file_id"


_SOME = f"SELECT file_id, pos, idx, from_ms, to_ms, CASE WHEN CAST(file_id AS BIGINT) % 5 = 0 THEN '- - -' ELSE text END AS text FROM ({CUES_SQL}) c"


@_query("empty_guard", f"{_twice_sql(_SOME)}, old AS ({_rendered_sql(f'({_SOME})')}), new AS ({_rendered_sql('fixed')}) SELECT o.file_id, sha256(coalesce(n.content, o.content)) AS content_sha256, n.content IS NULL AS was_empty, coalesce(n.content <> o.content, false) AS changed FROM old o LEFT JOIN new n ON n.file_id = o.file_id")
def _guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of which some lose every cue, fixed as files."""
    some = cues(spark, sf_dir).withColumn("text", F.when(F.col("file_id").cast("long") % 5 == 0, "- - -").otherwise(F.col("text")))
    return pipeline.fix_files(srt.render(some)).select("file_id", F.sha2("content", 256).alias("content_sha256"), "was_empty", "changed")


@_query("publish_changed", f"{_twice_sql(_SOME)}, old AS ({_rendered_sql(f'({_SOME})')}), new AS ({_rendered_sql('fixed')}), both_ AS (SELECT o.file_id, o.content AS old, n.content AS new, CASE WHEN CAST(o.file_id AS BIGINT) % 3 = 1 THEN 'unchanged' WHEN n.content IS NULL THEN 'kept' WHEN n.content = o.content THEN 'unchanged' ELSE 'written' END AS status FROM old o LEFT JOIN new n ON n.file_id = o.file_id) SELECT file_id, status, sha256(CASE WHEN status = 'written' THEN new ELSE old END) AS content_sha256, CASE WHEN status = 'written' THEN sha256(old) END AS before_sha256 FROM both_")
def _publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files put into a collection, two thirds of them fixed, and all published again: what became of each, what the collection
    holds, and its backup."""
    some = cues(spark, sf_dir).withColumn("text", F.when(F.col("file_id").cast("long") % 5 == 0, "- - -").otherwise(F.col("text")))
    root = f"{shared_root(spark)}/collection-{uuid.uuid4().hex}"
    collection.publish(srt.render(some), root)
    held, third = collection.files(spark, root), F.col("file_id").cast("long") % 3 == 1
    fixed = pipeline.fix_files(held.filter(~third)).select("file_id", F.when(~F.col("was_empty"), F.col("content")).alias("content"))
    told = collection.publish(fixed.unionByName(held.filter(third)), root)
    sums = [collection.files(spark, root, age).select("file_id", F.sha2("content", 256).alias(name)) for age, name in ((0, "content_sha256"), (1, "before_sha256"))]
    return told.join(sums[0], "file_id", "left").join(sums[1], "file_id", "left")


# Wire

_LIMIT = 1200

_JSON = "replace(replace(replace('{{\"idx\":' || {0} || ',\"text\":' || CAST(to_json({1}) AS VARCHAR) || '}}', '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026')"
_ITEM = _JSON.format("idx", "text")
_CUT = f"""
WITH RECURSIVE i AS (SELECT file_id, idx, text, row_number() OVER (PARTITION BY file_id ORDER BY pos) AS n, {_ITEM} AS item, strlen({_ITEM}) + 1 AS size FROM ({DEC_SQL}) d),
b AS (SELECT file_id, n, size AS filled, 0 AS batch_id FROM i WHERE n = 1
      UNION ALL
      SELECT i.file_id, i.n, CASE WHEN b.filled + i.size > {_LIMIT} THEN i.size ELSE b.filled + i.size END,
             b.batch_id + CASE WHEN b.filled + i.size > {_LIMIT} THEN 1 ELSE 0 END
      FROM b JOIN i ON i.file_id = b.file_id AND i.n = b.n + 1)
"""

def _batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.build_batches(dec(spark, sf_dir), _LIMIT)


@_query("build_batches", _CUT + "SELECT i.file_id, i.idx, i.text, CAST(b.batch_id AS BIGINT) AS batch_id FROM i JOIN b USING (file_id, n)")
def _build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batched(spark, sf_dir)


@_query("ndjson_payload", _CUT + "SELECT i.file_id, CAST(b.batch_id AS BIGINT) AS batch_id, string_agg(i.item, chr(10) ORDER BY i.idx) AS payload FROM i JOIN b USING (file_id, n) GROUP BY 1, 2")
def _payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.payloads(_batched(spark, sf_dir))


@_query("batch_stats", _CUT + "SELECT file_id, count(DISTINCT batch_id) AS batches, count(*) AS cues FROM b GROUP BY file_id")
def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.batch_stats(_batched(spark, sf_dir))


@_query("parse_ndjson", f"SELECT file_id, idx, text FROM ({DEC_SQL}) d")
def _ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads in code fences, as a model may send them back, read into items."""
    fenced = F.concat(F.lit("```json\n"), F.col("payload"), F.lit("\n```"))
    items = wire.read_replies(_payload(spark, sf_dir), fenced).select("file_id", F.explode("items").alias("item"))
    return items.select("file_id", "item.idx", "item.text")


_BROKEN = f"SELECT file_id, idx, (CAST(file_id AS BIGINT) + idx) % 8 AS kind, text AS w FROM ({DEC_SQL}) d"
#: By kind: the reply around I (the cue's idx), J (the next) and W (its text), and the items that are read from it.
_REPLIES = (
    ('```json\n{"idx":I,"text":"W"}\n```', [("idx", "w")]),
    ('[{"idx":I,"text":"W"},{"idx":J,"text":"b"}]', [("idx", "w"), ("idx + 1", "'b'")]),
    ('Sure: {"idx":I,"text":"W"} {"IDX":J,"Text":"b","x":{}} done', [("idx", "w"), ("idx + 1", "'b'")]),
    ('{"idx":I,"text":"W "said", then"}', [("idx", "w || ' \"said\", then'")]),
    ('{"idx":J,"text":"a"}\n{"idx":I,"text":"x "W" y"}\n{"idx":3,"text":"{c}"}', [("idx + 1", "'a'"), ("idx", "'x \"' || w || '\" y'"), ("3", "'{c}'")]),
    ('{"idx":99999999999999999999,"text":"W"}', []),
    ('{"idx":I,"text":"\\ud800W"}', [("idx", "chr(65533) || w")]),
    ('[{"idx":I,"text":"W"', []),
)


@_query("parse_ndjson_broken", " UNION ALL ".join(f"SELECT file_id, idx, CAST({i} AS BIGINT) AS item_idx, {t} AS item_text FROM ({_BROKEN}) b WHERE kind = {n}" for n, (_, items) in enumerate(_REPLIES) for i, t in items))
def _broken_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies as models break them: fences, arrays, chatter, bare quotes, numbers beyond 64 bits, lone surrogates, open ends."""
    # the text as it stands between quotes
    written = F.to_json(F.struct("text"))
    rows = dec(spark, sf_dir).select("file_id", "idx", F.substring(written, F.lit(10), F.length(written) - 11).alias("w"))
    reply = F.get(F.array(*[F.lit(r) for r, _ in _REPLIES]), ((F.col("file_id").cast("long") + F.col("idx")) % 8).cast("int"))
    for mark, value in (("I,", F.concat(F.col("idx").cast("string"), F.lit(","))), ("J,", F.concat((F.col("idx") + 1).cast("string"), F.lit(","))), ("W", F.col("w"))):
        reply = F.replace(reply, F.lit(mark), value)
    items = wire.read_replies(rows, reply).select("file_id", "idx", F.explode("items").alias("item"))
    return items.select("file_id", "idx", F.col("item.idx").alias("item_idx"), F.col("item.text").alias("item_text"))


@_query("translate", f"SELECT file_id, pos, idx, '» ' || text AS text FROM ({DEC_SQL}) d")
def _translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way of a translation, with a function in place of the service."""

    def service(options: TranslateOptions) -> Callable[[str], str]:
        return lambda payload: "\n".join(json.dumps({"idx": i, "text": f"» {t}"}) for i, t in wire.parse_reply(payload))

    return pipeline.translate(dec(spark, sf_dir).select("file_id", "pos", "idx", "text"), TranslateOptions("es", max_batch_chars=_LIMIT, rps=0), service)


_TRANSLATED = "SELECT file_id, idx, '» ' || text AS text FROM ({0}) d WHERE idx % 3 <> 0"


@_query("apply_translations", f"SELECT d.file_id, d.idx, d.pos, coalesce(t.text, d.text) AS text FROM ({DEC_SQL}) d LEFT JOIN ({_TRANSLATED.format(DEC_SQL)}) t ON t.file_id = d.file_id AND t.idx = d.idx")
def _apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dec(spark, sf_dir)
    return batches.apply_translations(rows, rows.filter("idx % 3 <> 0").withColumn("text", F.concat(F.lit("» "), F.col("text"))))


_REPLY = "SELECT file_id, CASE WHEN idx % 4 = 0 THEN 1 WHEN idx % 7 = 0 THEN 70 ELSE idx END AS idx FROM ({0}) d WHERE idx % 3 <> 0"


@_query("validate_batch", f"SELECT file_id, idx, problem FROM (SELECT coalesce(w.file_id, g.file_id) AS file_id, coalesce(w.idx, g.idx) AS idx, CASE WHEN g.n IS NULL THEN 'missing' WHEN w.idx IS NULL THEN 'unexpected' WHEN g.n > 1 THEN 'repeated' END AS problem FROM (SELECT DISTINCT file_id, idx FROM ({DEC_SQL}) d) w FULL JOIN (SELECT file_id, idx, count(*) AS n FROM ({_REPLY.format(DEC_SQL)}) r GROUP BY ALL) g ON g.file_id = w.file_id AND g.idx = w.idx) p WHERE problem IS NOT NULL")
def _check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dec(spark, sf_dir)
    reply = rows.filter("idx % 3 <> 0").withColumn("idx", F.expr("CASE WHEN idx % 4 = 0 THEN 1 WHEN idx % 7 = 0 THEN 70 ELSE idx END").cast("long"))
    return batches.validate_batch(rows, reply, ["file_id"])


# Small strings

#: By idx: a whole fence, one that isn't closed, one that doesn't begin the text, and one with another within.
_FENCED = (("' ```srt\n'", "'\n``` end'"), ("'```\n'", "''"), ("''", "'\n```'"), ("'```json extra\n'", "'\n```\nmore``` '"))
_UNFENCED = (("''", "'\n'"), ("''", "''"), ("''", "'\n```'"), ("''", "'\n```\nmore'"))


def _by_idx(frames: tuple[tuple[str, str], ...], x: str) -> str:
    return "CASE idx % 4 " + " ".join(f"WHEN {n} THEN concat({a}, {x}, {b})" for n, (a, b) in enumerate(frames)) + " END"


@_query("strip_code_fences", f"SELECT file_id, idx, {_by_idx(_UNFENCED, 't')} AS text FROM (SELECT file_id, idx, {_TRIM.format('text')} AS t FROM ({DEC_SQL}) d) e")
def _fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    trimmed = dec(spark, sf_dir).withColumn("t", F.trim(F.regexp_replace("text", r"^\s+|\s+$", "")))
    return trimmed.select("file_id", "idx", text.strip_code_fences(F.expr(_by_idx(_FENCED, "t"))).alias("text"))


_WHOLE = "left({0}, list_max(list_filter(range(0, 41), lambda n: strlen(left({0}, n)) <= {1})))"
_ABBREVIATED = f"CASE WHEN strlen(t) <= {{1}} THEN t ELSE {_WHOLE.format('t', '{2}')} || {{3}} END"
_on_dec("abbreviate", lambda c: text.abbreviate(c, 40), None)
ORACLES["abbreviate"] = f"SELECT file_id, idx, {_ABBREVIATED.format('', 40, 37, chr(39) + '...' + chr(39))} AS text FROM (SELECT file_id, idx, {_TRIM.format('text')} AS t FROM ({DEC_SQL}) d) e"


@_query("abbreviate_documents", "SELECT doc_id, " + ", ".join(f"{_ABBREVIATED.format('', n, n if n <= 3 else n - 3, repr('' if n <= 3 else '...'))} AS short_{n}" for n in (3, 17, 30)) + f" FROM (SELECT doc_id, {_TRIM.format('regexp_replace(text, {0}, {1}, {2})'.format(repr('[ -~]'), repr(''), repr('g')))} AS t FROM documents) e")
def _abbreviate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of nothing but characters of more bytes, so that most cuts fall inside one."""
    wide = F.regexp_replace("text", "[ -~]", "")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", *[text.abbreviate(wide, n).alias(f"short_{n}") for n in (3, 17, 30)])


@_query("mask_keys", "SELECT item_id, array_to_string(list_transform(string_split(replace(text, ' ', ','), ','), lambda k: CASE length(k) WHEN 0 THEN '' WHEN 1 THEN '*' WHEN 2 THEN left(k, 1) || '*' ELSE left(k, 1) || repeat('*', length(k) - 2) || right(k, 1) END), ',') AS masked FROM benchmark")
def _mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", text.mask_keys(F.replace(F.col("text"), F.lit(" "), F.lit(","))).alias("masked"))


@_query("normalize_csv", f"SELECT item_id, array_to_string(list_filter(list_transform(string_split(replace(text, 'e', ' , '), ','), lambda k: {_TRIM.format('k')}), lambda k: k <> ''), ',') AS csv FROM benchmark")
def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", text.normalize_csv(F.replace(F.col("text"), F.lit("e"), F.lit(" , "))).alias("csv"))


_TAGS = "CASE doc_id % 6 WHEN 0 THEN ' ' || upper(lang) || '_gb ' WHEN 1 THEN lang || '--419' WHEN 2 THEN lang || '_ES' WHEN 3 THEN upper(lang) WHEN 4 THEN lang || '-*' ELSE lang || '__mx' END"
_LABELLED = "SELECT doc_id, tag, coalesce({0}, {1}, tag) AS label FROM (SELECT doc_id, lower(p[1]) || CASE WHEN len(p) > 1 THEN '-' || CASE length(p[2]) WHEN 2 THEN upper(p[2]) WHEN 3 THEN lower(p[2]) ELSE p[2] END ELSE '' END AS tag FROM (SELECT doc_id, string_split(regexp_replace(replace(trim(x), '_', '-'), '-{{2,}}', '-', 'g'), '-') AS p FROM (SELECT doc_id, {2} AS x FROM documents) a) b) c"


def _label_case(x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in language.LABELS.items()) + " END"


@_query("language_label", _LABELLED.format(_label_case("lower(tag)"), _label_case("CASE WHEN contains(tag, '-') THEN split_part(tag, '-', 1) || '-*' END"), _TAGS))
def _label(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr(_TAGS)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", language.language_tag(raw).alias("tag"), language.language_label(raw).alias("label"))


# The client and the pool. The services are functions that answer by the payload's length.

_PAYLOADS = ORACLES["ndjson_payload"]
_BAD = 101, 7


def _keyed(spark: SparkSession, sf_dir: str, options: TranslateOptions) -> DataFrame:
    return translating.keyed(_payload(spark, sf_dir), options)


#: By the payload's length: what the service answers, try by try, before it answers well, and the seconds that are waited.
_ANSWERS = ((), ((429, "3"),), ((503, None), (503, None)), ((500, "soon"),), ((429, None), (429, None), (429, "-1")), ((200, None),))
_WAITED = (0.0, 3.0, 1.5, 0.5, 3.5, 0.5)
_URL = "https://api.openai.com/v1/chat/completions"


def _service(options: TranslateOptions) -> Callable[[str], str]:
    """A ChatClient whose first key is refused; a reply's texts tell how the call went."""

    def call(payload: str) -> str:
        waits: list[float] = []
        sent: list[tuple[str, str]] = []

        def send(url: str, key: str, body: bytes, timeout: float) -> tuple[int, dict[str, str], str]:
            sent.append((url, key))
            if key == "first":
                return 401, {}, "no such key"
            said = json.loads(body)["messages"][1]["content"].partition("Input:\n")[2]
            bad = _ANSWERS[len(said.encode()) % len(_ANSWERS)]
            turn = sum(k == key for _, k in sent)
            status, after = bad[turn - 1] if turn <= len(bad) else (200, None)
            content = said if turn > len(bad) else " "
            return status, {"Retry-After": after} if after else {}, json.dumps({"choices": [{"message": {"content": content}}]})

        reply = client.ChatClient(options, send, waits.append, jitter=0)(payload)
        told = json.dumps({"calls": len(sent), "waited": sum(waits), "url": sent[-1][0], "key": sent[-1][1]})
        return "\n".join(json.dumps({"idx": i, "text": told}) for i, _ in wire.parse_reply(reply))

    return call


@_query("client_calls", f"SELECT file_id, batch_id, CAST(CASE strlen(payload) % {len(_ANSWERS)} " + " ".join(f"WHEN {n} THEN {2 * len(a) + 2}" for n, a in enumerate(_ANSWERS)) + f" END AS BIGINT) AS calls, CAST(CASE strlen(payload) % {len(_ANSWERS)} " + " ".join(f"WHEN {n} THEN {w}" for n, w in enumerate(_WAITED)) + f" END AS DOUBLE) AS waited, '{_URL}' AS url, 'second' AS key FROM ({_PAYLOADS}) p")
def _client_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every batch through the client: keys that give way, statuses that pass, waits that the service asks for or that double."""
    options = TranslateOptions("es", model="gpt-x", api_keys=" first, ,second", rps=0)
    got = translating.outcomes(_keyed(spark, sf_dir, options), options, _service)
    told = F.from_json(F.get("items", F.lit(0))["text"], "calls long, waited double, url string, key string")
    return got.select("file_id", "batch_id", told.alias("t")).select("file_id", "batch_id", "t.*")


@_query("envelope", f"SELECT file_id, idx, CASE (CAST(file_id AS BIGINT) + idx) % 5 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE {_TRIM.format('text')} END AS content FROM ({DEC_SQL}) d")
def _envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat completions around whole texts: one or two choices, extra keys, none, and broken ones."""
    choice = lambda x: F.struct(F.struct(F.lit("assistant").alias("role"), x.alias("content")).alias("message"), F.lit("stop").alias("finish_reason"))
    said = F.concat(F.lit(" \n"), F.col("text"), F.lit("\n"))
    bodies = [F.to_json(F.struct(F.array(choice(said)).alias("choices"))), F.to_json(F.struct(F.lit("x").alias("id"), F.array(choice(said), choice(F.lit("other"))).alias("choices"))), F.to_json(F.struct(F.array(choice(said)).alias("choices"), F.lit(1).alias("usage"))), F.lit('{"choices":[]}'), F.concat(F.lit('{"choices":'), F.col("text"))]
    body = F.get(F.array(*bodies), ((F.col("file_id").cast("long") + F.col("idx")) % len(bodies)).cast("int"))
    return dec(spark, sf_dir).select("file_id", "idx", wire.envelope_content(body).alias("content"))


def _pool_sql(rows: str, size: int) -> str:
    """CTEs that end with `told`: rows (file_id, batch_id, payload) with task, round, slot and status, in rounds of size."""
    return f"""
p AS ({rows}),
o AS (SELECT *, (CAST(file_id AS BIGINT) + batch_id) % 4 AS task, strlen(payload) % {_BAD[0]} = {_BAD[1]} AS bad FROM p),
q AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY file_id, batch_id) - 1 AS place FROM o),
r AS (SELECT *, place // {size} AS round, row_number() OVER (ORDER BY place // {size}, task, place) - 1 AS slot, min(CASE WHEN bad THEN place // {size} END) OVER () AS stop FROM q),
f AS (SELECT *, min(CASE WHEN bad AND round = stop THEN place END) OVER (PARTITION BY task) AS first_bad FROM r),
told AS (SELECT file_id, batch_id, payload, task, round, slot, CASE WHEN stop IS NULL OR round < stop THEN 'done' WHEN round > stop THEN 'cancelled' WHEN first_bad IS NULL OR place < first_bad THEN 'done' WHEN place = first_bad THEN 'failed' ELSE 'cancelled' END AS status FROM f)"""


def _refusing(options: TranslateOptions) -> Callable[[str], str]:
    def call(payload: str) -> str:
        if len(payload.encode()) % _BAD[0] == _BAD[1]:
            raise ValueError("refused")
        return payload

    return call


def _dealt() -> Column:
    return F.pmod(F.col("file_id").cast("long") + F.col("batch_id"), F.lit(4))


@_query("pool_calls", f"WITH {_pool_sql(f'SELECT * FROM ({_PAYLOADS}) x', 16)} SELECT file_id, batch_id, CAST(task AS INTEGER) AS task, CAST(round AS BIGINT) AS round, CAST(CASE WHEN status <> 'cancelled' THEN slot END AS BIGINT) AS slot, status FROM told")
def _pool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four tasks that share a rate; the first batch that is refused ends the work of all."""
    options = TranslateOptions("es", max_workers=4, rps=2000.0)
    return translating.outcomes(_keyed(spark, sf_dir, options), options, _refusing, _dealt(), 16).select("file_id", "batch_id", "task", "round", "slot", "status")


@_query("resumed_calls", f"WITH {_pool_sql(f'SELECT * FROM ({_PAYLOADS}) x QUALIFY row_number() OVER (PARTITION BY payload ORDER BY file_id, batch_id) = 1', 16)} SELECT a.file_id, a.batch_id, CASE WHEN t.status = 'done' THEN 1 ELSE 2 END AS run, CAST(len(string_split(a.payload, chr(10))) AS BIGINT) AS items FROM ({_PAYLOADS}) a JOIN told t ON t.payload = a.payload")
def _resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that a refused batch ends, and a second one with the same ledger that asks for what is left."""
    options = TranslateOptions("es", max_workers=4, rps=0)
    sent = durable(_keyed(spark, sf_dir, options))
    ledger = f"{shared_root(spark)}/ledger-{uuid.uuid4().hex}"
    try:
        translating.ask(sent, options, _refusing, ledger, _dealt(), size=16)
    except translating.BatchFailed:
        pass
    first = durable(translating.held(ledger, sent).select("key", F.lit(1).alias("run")))
    translating.ask(sent, options, lambda o: lambda payload: payload, ledger, _dealt())
    both = sent.join(translating.held(ledger, sent), "key").join(first, "key", "left")
    return both.select("file_id", "batch_id", F.coalesce("run", F.lit(2)).alias("run"), F.size("items").cast("long").alias("items"))


# Files as others write them


_ODD_LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda l: {_TRIM.format('l')}), lambda l: l <> '')"


@_query("scan_srt_odd", f"""
WITH f AS (SELECT CAST(doc_id AS VARCHAR) AS file_id, doc_id % 12 AS kind, {_ODD_LINES} AS said FROM documents),
n AS (SELECT *, CASE WHEN len(said) > 0 AND list_max(list_transform(said, lambda l: strlen(l))) >= 65536 THEN 'a line is too long'
                     WHEN kind = 3 THEN 'invalid subtitle index: x1' WHEN kind = 4 THEN 'invalid subtitle timing: 00:00 --> 1'
                     WHEN kind = 5 THEN 'could not find subtitle timing' WHEN kind = 11 THEN 'invalid subtitle timing' END AS _error FROM f)
SELECT file_id, CAST(i - 1 AS BIGINT) AS pos, CAST(i * CASE WHEN kind = 6 THEN -1 ELSE 1 END AS BIGINT) AS idx, CAST(i * 60000 + 7 AS BIGINT) AS from_ms, CAST(i * 61000 + 1005 AS BIGINT) AS to_ms,
       said[i] || CASE WHEN kind = 7 THEN chr(10) || 'and' ELSE '' END AS text, CAST(NULL AS VARCHAR) AS _error
FROM (SELECT *, unnest(range(1, len(said) + 1)) AS i FROM n WHERE _error IS NULL AND len(said) > 0) u
UNION ALL SELECT file_id, NULL, NULL, NULL, NULL, NULL, _error FROM n WHERE _error IS NOT NULL AND (len(said) > 0 OR kind IN (3, 4, 5, 11))
""")
def _scan_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of each document, a cue of each line, as editors write them: a mark before the first line, blank lines, line ends
    of two characters, cues of white lines, signs, coordinates, minutes past 59, no last line end; and broken ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("file_id"), (F.col("doc_id") % 12).alias("kind"), F.filter(F.transform(F.split("text", "\n"), text.trim), lambda x: x != "").alias("said"))
    kind = F.col("kind")
    number = lambda i: F.concat(F.when(kind == 6, "-").when(kind == 2, "+").otherwise(""), (i + 1).cast("string"))
    time = lambda i: F.concat(F.lit("at 0:"), (i + 1).cast("string"), F.lit(":0,7 --> 00:00:"), ((i + 1) * 61 + 1).cast("string"), F.lit(",005 X1:40 Y1:20"))
    more = F.when(kind == 7, "\n \t\n and").otherwise("")
    cue = F.transform("said", lambda x, i: F.concat(F.when(kind == 9, " \n\n").otherwise(""), number(i), F.lit("\n"), time(i), F.lit("\n"), x, more))
    body = F.array_join(cue, "\n\n")
    broken = F.when(kind == 3, "x1\n00:00:01,000 --> 00:00:02,000\na\n\n").when(kind == 4, "1\n00:00 --> 1\na\n\n").when(kind == 11, "1\n\n00:00:01,000 --> 00:00:02,000\na\n\n").otherwise("")
    whole = F.concat(F.when(kind == 1, "\ufeff").when(kind == 8, "\n\ufeff \n\n \ufeff").otherwise(""), broken, body, F.when(kind == 5, F.when(F.size("said") > 0, "\n\n7").otherwise("7")).when(kind == 10, "\n\n\n \n").otherwise(""))
    lines = F.when(kind.isin(2, 9), F.replace(whole, F.lit("\n"), F.lit("\r\n"))).otherwise(whole)
    return srt.parse(docs.select("file_id", lines.alias("content")))
