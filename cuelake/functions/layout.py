"""Line layout: greedy wrapping as one pattern, merging of short lines as a fold over an array. Lengths are bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuelake.functions.text import WS, clean_text, is_continuation, is_ended, is_tag_line, let, lines, one_space, trim

MAX_LINE_LENGTH, MIN_WORDS_MERGE, MAX_LINES = 70, 3, 6
_STATE = "struct<out:array<string>,line:string>"


def _start() -> Column:
    return F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("line")).cast(_STATE)


def _pushed(state: Column) -> Column:
    return F.when(state["line"] == "", state["out"]).otherwise(F.concat(state["out"], F.array(state["line"])))


def _words(line: Column) -> Column:
    return F.filter(F.split(line, rf"{WS}+", -1), lambda w: w != "")


def _flow(c: Column, most: int) -> Column:
    """Lines of words between single spaces, broken: as many words as fit, or one that is too long. Bytes are counted, so
    other than ASCII text is taken as its bytes, one character each."""

    def broken(x: Column) -> Column:
        return F.regexp_replace(x, rf"([^\n]{{1,{most}}})(?:[ \n]|\z)|([^ \n]+)(?:[ \n]|\z)", "$1$2\n")

    def flow(x: Column) -> Column:
        as_bytes = F.decode(F.encode(x, "UTF-8"), "ISO-8859-1")
        return F.when(F.octet_length(x) == F.length(x), broken(x)).otherwise(F.decode(F.encode(broken(as_bytes), "ISO-8859-1"), "UTF-8"))

    return F.btrim(let(one_space(c), flow), F.lit("\n"))


def wrap_lines(c: Column, most: int = MAX_LINE_LENGTH) -> Column:
    """Words flow to the next line where a line would be longer than `most`; breaks stay, tag lines stay whole."""

    def wrapped(x: Column) -> Column:
        by_line = F.transform(lines(x), lambda line: F.when(is_tag_line(line), line).otherwise(_flow(line, most)))
        has_tag_line = F.contains(x, F.lit("<")) & x.rlike(r"(?<![^\n])<[^\n]*>(?![^\n])")
        return F.when(has_tag_line, F.array_join(by_line, "\n")).when(F.octet_length(x) <= most, one_space(x)).otherwise(_flow(x, most))

    return let(clean_text(c), wrapped)


def merge_short_lines(c: Column, words: int = MIN_WORDS_MERGE, most: int = MAX_LINE_LENGTH) -> Column:
    """A line of up to `words` words that goes on the line before it is put on it, while the two are shorter than `most`."""

    def step(state: Column, raw: Column) -> Column:
        x, line = trim(raw), state["line"]
        fits = ~is_tag_line(x) & (F.size(_words(x)) <= words) & ((line == "") | (is_continuation(x) & ~is_ended(line)))
        joined = F.when(line == "", x).otherwise(F.concat_ws(" ", line, x))
        goes_on = fits & (F.octet_length(joined) < most)
        return F.struct(F.when(goes_on, state["out"]).otherwise(_pushed(state)).alias("out"), F.when(goes_on, joined).otherwise(x).alias("line")).cast(_STATE)

    return clean_text(F.array_join(F.aggregate(lines(c), _start(), step, _pushed), "\n"))


def lay_out(c: Column, most: int = MAX_LINE_LENGTH, words: int = MIN_WORDS_MERGE) -> Column:
    """Wrapped; if that makes more than MAX_LINES lines, short ones are merged."""
    return let(wrap_lines(c, most), lambda x: F.when(F.size(lines(x)) > MAX_LINES, merge_short_lines(x, words, most)).otherwise(x))
