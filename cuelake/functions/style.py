"""Removal of matched style tags such as <i>...</i>. The matching needs a stack, so this is a Python UDF; texts without
a '<' never reach it (see strip_style)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_PIECES = re.compile(r"<[^>]*>|<[^>]*\Z|[^<]+")


def _name_ok(name: str) -> bool:
    return bool(name) and name[0].isalpha() and all(ch.isalpha() or ch.isdecimal() or ch in "-:_" for ch in name[1:])


def read_tag(piece: str) -> tuple[str, str] | None:
    """(name, "open" | "close" | "self") of a piece that is a tag."""
    if len(piece) < 3 or piece[-1] != ">":
        return None
    inner = piece[1:-1].strip()
    if inner[:1] in ("!", "?"):
        return None
    closes, inner = inner.startswith("/"), inner.removeprefix("/").strip()
    alone, inner = inner.endswith("/"), inner.removesuffix("/").strip()
    name = (inner.split() or [""])[0]
    if not _name_ok(name):
        return None
    name = name.lower()
    if closes:
        return None if alone else (name, "close")
    return (name, "self" if alone or name == "br" else "open")


def strip_text(text: str) -> str:
    """An opening tag goes with its closing one if nothing unclosed stands between; single tags go; a <br> with text
    after it on its line becomes a line break. A text that loses no tag stays as it is."""
    pieces = _PIECES.findall(text)
    tags = [read_tag(p) if p[0] == "<" else None for p in pieces]
    gone: set[int] = set()
    opened: list[int] = []
    for i, tag in enumerate(tags):
        if not tag:
            continue
        if tag[1] == "self":
            gone.add(i)
        elif tag[1] == "open":
            opened.append(i)
        elif opened and tags[opened[-1]][0] == tag[0]:
            gone |= {i, opened.pop()}
    if not gone:
        return text
    out: list[str] = []
    text_follows = False  # on the rest of the line, tags aside
    for i in range(len(pieces) - 1, -1, -1):
        if tags[i] is None:
            out.append(pieces[i])
            first, broken, _ = pieces[i].partition("\n")
            text_follows = bool(first.strip()) or (not broken and text_follows)
        elif i not in gone:
            out.append(pieces[i])
        elif tags[i][0] == "br" and text_follows:
            out.append("\n")
    return "\n".join(x for x in (line.strip() for line in "".join(reversed(out)).split("\n")) if x)


# without Arrow, a worker holds 100 texts at a time in place of 10,000
@F.udf(StringType(), useArrow=False)
def _strip(text: str | None) -> str | None:
    return None if text is None else strip_text(text)


def strip_style(c: Column) -> Column:
    return F.when(F.instr(c, "<") > 0, _strip(F.when(F.instr(c, "<") > 0, c))).otherwise(c)
