"""The wire format of translation batches: NDJSON items {"idx":n,"text":"..."}, and tolerant reading of replies.

Encoding is built-in: to_json with the escapes that count towards a batch's size. So is the reading of sound replies; broken
ones go to a Python function through an Arrow UDF.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from cuelake.functions.text import trim

#: Characters that are written as escapes although JSON doesn't ask for it.
ESCAPES = {"<": "\\u003c", ">": "\\u003e", "&": "\\u0026", "\u2028": "\\u2028", "\u2029": "\\u2029"}
ITEMS = ArrayType(StructType([StructField("idx", LongType()), StructField("text", StringType())]))


def encode_item(idx: Column, text: Column) -> Column:
    """One line; CRLF becomes LF first."""
    out = F.to_json(F.struct(idx.cast("bigint").alias("idx"), F.replace(text, F.lit("\r\n"), F.lit("\n")).alias("text")))
    for plain, escaped in ESCAPES.items():
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return out


def item_size(idx: Column, text: Column) -> Column:
    """Bytes of the item and its line break."""
    return F.octet_length(encode_item(idx, text)) + 1


#: idx is a 64-bit number in the tables.
MAX_IDX = (1 << 63) - 1
#: Halves of a surrogate pair, as JSON escapes may leave them alone, are no characters.
_LONE = dict.fromkeys(range(0xD800, 0xE000), "\ufffd")


class WireError(ValueError):
    pass


_STRING = r'"(?:\\.|[^"\\])*"'
_MARKS = re.compile(rf'(?s){_STRING}|"|[{{}}]')
#: The text's end is a quote before a closing brace or before a comma and another key.
_END = r'"(?=[ \t\n\r]*(?:\}|,[ \t\n\r]*"))'
_IDX = re.compile(r'"idx"[^:]*:[ \t\n\r]*(-?[0-9]+)')
_TEXT = re.compile(rf'(?s)"text"[^:]*:[ \t\n\r]*"((?:\\.|(?!{_END})[^\\])*){_END}')
_BARE = re.compile(r'(?s)(\\.)|"')


def _no_constant(name: str):
    raise ValueError(f"{name} isn't JSON")


def _item(pairs) -> tuple[int, str]:
    """(idx, text) of an object's pairs: names in any case, the last of equals counts, others are ignored."""
    if not isinstance(pairs, _Pairs):
        raise WireError("an item isn't an object")
    idx, text = 0, ""
    for name, value in pairs:
        if name.lower() == "idx" and value is not None:
            if type(value) is not int:
                raise WireError("idx isn't a whole number")
            idx = value
        elif name.lower() == "text" and value is not None:
            if type(value) is not str:
                raise WireError("text isn't a string")
            text = value
    return _sound(idx), _paired(text)


def _paired(text: str) -> str:
    try:
        text.encode()
    except UnicodeEncodeError:
        return text.translate(_LONE)
    return text


def _sound(idx: int) -> int:
    if not 0 < idx <= MAX_IDX:
        raise WireError(f"invalid idx: {idx}")
    return idx


class _Pairs(list):
    pass


_DECODER = json.JSONDecoder(object_pairs_hook=_Pairs, parse_constant=_no_constant)


def _load(text: str):
    try:
        return _DECODER.decode(text)
    except (ValueError, RecursionError) as e:
        raise WireError(f"invalid JSON: {e}") from e


def objects(text: str) -> list[str]:
    """The outermost balanced {...} of a text; braces within strings don't count."""
    out, depth, start = [], 0, 0
    for m in _MARKS.finditer(text):
        if m[0] == '"':  # a string that never ends
            break
        if m[0] == "{":
            start = m.start() if depth == 0 else start
            depth += 1
        elif m[0] == "}" and depth:
            depth -= 1
            if depth == 0:
                out.append(text[start : m.end()])
    return out


def repaired(text: str) -> tuple[int, str]:
    """idx and text of an object whose text may hold bare quotes."""
    idx, said = _IDX.search(text), _TEXT.search(text)
    if not idx or not said:
        raise WireError("an object can't be repaired")
    if len(idx[1]) > 20:
        raise WireError(f"invalid idx: {idx[1][:20]}...")
    number = _sound(int(idx[1]))
    return number, _paired(_load('"' + _BARE.sub(lambda m: m[1] or '\\"', said[1]) + '"'))


def _some(items: list[tuple[int, str]]) -> list[tuple[int, str]]:
    if not items:
        raise WireError("no translated lines parsed")
    return items


def _numbered(lines: list[str], read) -> list[tuple[int, str]]:
    out = []
    for n, line in enumerate(lines, 1):
        if line.strip():
            try:
                out.append(read(line.strip()))
            except WireError as e:
                raise WireError(f"line {n}: {e}") from e
    return _some(out)


def _strict(line: str) -> tuple[int, str]:
    return _item(_load(line))


def _mended(line: str) -> tuple[int, str]:
    try:
        return _strict(line)
    except WireError:
        return repaired(line)


def unfenced(text: str) -> str:
    text = text.strip()
    if text.startswith("```"):
        text = text.partition("\n")[2] if "\n" in text else text
        text = text[: text.rindex("```")] if "```" in text else text
    return text


def parse_reply(reply: str) -> list[tuple[int, str]]:
    """Items of a model's reply. A reply that begins with a bracket must be a sound array; otherwise objects anywhere, then
    strict lines, then lines of which broken ones are mended, then mended objects; if all fail, the strict error is raised.
    Strict lines are tried first, as they give the same items as their objects and are read many times faster."""
    text = unfenced(reply.replace("\r\n", "\n")).strip()
    if not text:
        raise WireError("empty translation output")
    if text.startswith("["):
        got = _load(text)
        if not isinstance(got, list) or isinstance(got, _Pairs):
            raise WireError("not an array")
        return _some([_item(x if x is not None else _Pairs()) for x in got])
    lines = text.split("\n")
    ways = (lambda: _numbered(lines, _strict), lambda: _some([_strict(o) for o in objects(text)]), lambda: _numbered(lines, _mended), lambda: _some([repaired(o) for o in objects(text)]))
    for way in ways:
        try:
            return way()
        except WireError:
            continue
    return _numbered(lines, _strict)


#: One item alone on its line, once every escape but those of surrogates is a single "_".
_SOUND = r'^[ \t\r]*+\{[ \t]*+"idx"[ \t]*+:[ \t]*+[1-9][0-9]{0,17}[ \t]*+,[ \t]*+"text"[ \t]*+:[ \t]*+"[^"\\\x00-\x1f]*+"[ \t]*+\}[ \t\r]*+\z'
_ESCAPE = r'\\(?:["\\/bfnrt]|u(?![dD][89a-fA-F])[0-9a-fA-F]{4})'


def _let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def sound_items(reply: Column) -> Column:
    """The items of a reply with nothing to mend: one object a line, of idx and text, also in a fence; else null. The shape of a
    line is looked at without its escapes, and its values are read as a VARIANT. Whatever this reads, parse_reply() reads alike."""
    bare = trim(F.replace(reply, F.lit("\r\n"), F.lit("\n")))
    body = _let(bare, lambda x: F.when(F.startswith(x, F.lit("```")), F.regexp_extract(x, r"(?s)\A```[^\n]*+\n(.*)```\z", 1)).otherwise(x))
    item = lambda v: F.struct(F.try_variant_get(v, "$.idx", "bigint").alias("idx"), F.try_variant_get(v, "$.text", "string").alias("text"))
    one = lambda line: F.when(F.regexp_replace(line, _ESCAPE, "_").rlike(_SOUND), _let(F.try_parse_json(line), item))
    items = F.transform(F.filter(F.split(body, "\n", -1), lambda x: ~x.rlike(r"^[ \t\r]*+\z")), one)
    whole = lambda got: F.when((F.size(got) > 0) & F.forall(got, lambda i: i["idx"].isNotNull() & i["text"].isNotNull()), got)
    return _let(items, whole)


@F.pandas_udf(ITEMS)
def _parse(replies: pd.Series) -> pd.Series:
    def one(reply):
        try:
            return [{"idx": i, "text": t} for i, t in parse_reply(reply)]
        except WireError:
            return None

    return replies.map(one, na_action="ignore")


def parse_ndjson(reply: Column) -> Column:
    """The items of each reply; null where none can be read. Python sees only what sound_items() can't read."""
    sound = sound_items(reply)
    return F.coalesce(sound, _parse(F.when(sound.isNull(), reply)))


def read_replies(rows: DataFrame, reply: Column, name: str = "items") -> DataFrame:
    """rows with parse_ndjson(reply) as name; sound replies are read once."""
    read = rows.select("*", reply.alias("_reply")).select("*", sound_items(F.col("_reply")).alias("_sound"))
    items = F.coalesce("_sound", _parse(F.when(F.col("_sound").isNull(), F.col("_reply"))))
    return read.withColumn(name, items).drop("_reply", "_sound")


def envelope_content(body: Column) -> Column:
    """choices[0].message.content of a chat completion, trimmed; null if there is none or it is empty."""
    got = F.from_json(body, "choices array<struct<message:struct<content:string>>>")
    said = trim(F.get(got["choices"], F.lit(0))["message"]["content"])
    return F.when(said != "", said)
