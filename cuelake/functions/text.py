"""Text normalisation of cues as Column expressions: clean, decorative lines, structural lines, small string functions.

White space is Unicode White_Space unless said otherwise; lengths of the layout and batch functions are bytes of UTF-8.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters with Unicode's property White_Space.
WHITE_SPACE = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# characters beyond Latin-1 are tried within a range first: most others fail that one test
_FAR = r"[\u1680-\u3000&&[\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]]"
#: As classes of a pattern: any, any but a line break, and any but a line break and the plain space.
WS, WS_INLINE, WS_ODD = (rf"[{x}\t\x0B\f\r\x85\xA0{_FAR}]" for x in (r"\n ", " ", ""))
#: Bytes that every odd white space has one of, though other text may have them too.
_ODD_BYTES = (b"\t", b"\v", b"\f", b"\r", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
#: Fixed value: the symbols of which a decorative line repeats one.
DECORATIVE = "-:._♪♫"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_SPACE))


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def clean_text(c: Column) -> Column:
    """CRLF to LF, every line trimmed, blank lines dropped."""
    return F.array_join(F.filter(F.transform(lines(c), trim), lambda x: x != ""), "\n")


def one_space(c: Column) -> Column:
    """Runs of white space without a line break as one space. Few texts need it, and a search for bytes tells most."""
    raw = c.cast("binary")
    odd = reduce(lambda a, b: a | b, [F.contains(raw, F.lit(x)) for x in _ODD_BYTES], F.contains(c, F.lit("  ")))
    return F.when(odd, F.regexp_replace(c, rf"(?:{WS_ODD}| (?={WS_INLINE})){WS_INLINE}*+", " ")).otherwise(c)


def strip_bom(c: Column) -> Column:
    """Without one leading byte order mark."""
    return F.regexp_replace(c, "^﻿", "")


def structural_line(c: Column) -> Column:
    """An index or timing line as the parser sees it."""
    return strip_bom(clean_text(strip_bom(c)))


def is_decorative(line: Column) -> Column:
    """Only repetitions of one symbol, white space aside."""
    return line.rlike(rf"^{WS}*([-:._♪♫])(?:{WS}*\1)*{WS}*\z")


def drop_decorative(c: Column) -> Column:
    return F.array_join(F.filter(lines(c), lambda x: ~is_decorative(x)), "\n")


def is_continuation(line: Column) -> Column:
    """Empty, or begins with a lower-case letter, an ampersand or a comma."""
    return (line == "") | line.rlike(r"^(?:[&,]|\p{Ll})")


def is_ended(line: Column) -> Column:
    return F.right(line, F.lit(1)).isin(".", ">")


def is_tag_line(line: Column) -> Column:
    t = trim(line)
    return t.startswith("<") & t.endswith(">")


def is_translator_credit(c: Column) -> Column:
    return c.rlike("(?iu)traductor|traducción|traduccion|translate|translator")


def mask_key(c: Column) -> Column:
    """The first and the last character of a secret, stars between; of one or two characters less is shown."""
    n = F.length(c)
    return F.when(n == 0, "").when(n == 1, "*").when(n == 2, F.concat(F.left(c, F.lit(1)), F.lit("*"))).otherwise(F.concat(F.left(c, F.lit(1)), F.repeat(F.lit("*"), n - 2), F.right(c, F.lit(1))))


def mask_keys(c: Column, separator: str = ",") -> Column:
    """Each item of a separated list masked; an empty separator takes the whole as one."""
    if not separator:
        return mask_key(c)
    return F.array_join(F.transform(F.split(c, "\\Q" + separator + "\\E", -1), mask_key), separator)


def normalize_csv(c: Column) -> Column:
    """Items trimmed, empty ones dropped."""
    return F.array_join(F.filter(F.transform(F.split(c, ",", -1), trim), lambda x: x != ""), ",")


def abbreviate(c: Column, most: int) -> Column:
    """Trimmed, and cut to `most` bytes with an ellipsis that counts; no ellipsis where most is 3 or less. A character that
    the cut would split goes as a whole."""
    t = trim(c)
    if most <= 0:
        return t
    raw, size = t.cast("binary"), most if most <= 3 else most - 3
    # bytes 80 to BF go on a character, of which there are three at most
    splits = [F.hex(F.substring(raw, size + 1 - k, 1)).rlike("^[89AB]") if size >= k else F.lit(False) for k in range(3)]
    back = F.when(~splits[0], 0).when(~splits[1], 1).when(~splits[2], 2).otherwise(3)
    cut = F.substring(raw, F.lit(1), F.lit(size) - back).cast("string")
    return F.when(F.octet_length(t) <= most, t).otherwise(cut if most <= 3 else F.concat(cut, F.lit("...")))


def strip_code_fences(c: Column) -> Column:
    """If the text begins with three backticks: without its first line, and without what stands from the last three on."""
    t = trim(c)
    body = F.when(F.instr(t, "\n") > 0, F.regexp_replace(t, r"^[^\n]*\n", "")).otherwise(t)
    return F.when(t.startswith("```"), F.when(F.instr(body, "```") > 0, F.regexp_replace(body, r"(?s)```(?!.*```).*\z", "")).otherwise(body)).otherwise(t)
