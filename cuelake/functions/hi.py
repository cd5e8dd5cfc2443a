"""Removal of hearing-impaired cues: bracketed sounds, and in the standard modes speaker names and inline sounds.

A mode says which brackets count and which steps run. Steps that repeat until nothing changes are one quantified
pattern each. Patterns use ASCII white space and match to the very end of a line.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuelake.functions.text import clean_text, lines, trim

_S = r"[\t\n\f\r ]"
_SEPARATOR = rf"(?:{_S}*[:\-]{_S}*|{_S}+)"
_PAIRS = {"[]": (r"\[", r"\]", r"[^\[\]]"), "()": (r"\(", r"\)", r"[^()]"), "{}": (r"\{", r"\}", r"[^{}]")}
MODES = ("safe", "safe-plus", "standard", "standard-plus")
DEFAULT_MODE = "standard"


@dataclass(frozen=True)
class Mode:
    """brackets: pairs that enclose a sound; speakers: whether names, inline sounds and their traces go as well."""

    brackets: tuple[str, ...]
    speakers: bool

    def cue(self, inner: str = "+") -> str:
        return "(?:" + "|".join(f"{a}{x}{inner}{b}" for a, b, x in (_PAIRS[p] for p in self.brackets)) + ")"

    def block(self) -> str:
        """A pair with a line break between, from an opening to the first closing one."""
        close = {"[]": r"[^\]]", "()": "[^)]", "{}": "[^}]"}
        return "|".join(f"{_PAIRS[p][0]}{close[p]}*\\n{close[p]}*{_PAIRS[p][1]}" for p in self.brackets)


def mode(name: str) -> Mode:
    name = name.strip().lower()
    if name not in MODES:
        raise ValueError(f"unknown mode for hearing-impaired cues: {name!r}; one of {', '.join(MODES)}")
    return Mode(("[]", "()", "{}") if name.endswith("plus") else ("[]",), name.startswith("standard"))


def _sounds(m: Mode) -> Callable[[Column], Column]:
    """A line of nothing but a sound goes; then sounds behind a dash, in front, and at the end."""
    only = rf"^(?:-{_S}*)?{m.cue()}(?:{_S}*[:\-]{_S}*)?\z"
    behind_dash, front, end = rf"(?s)^-{_S}*(?:{m.cue()}{_SEPARATOR})+(?=.)", rf"(?s)^(?:{m.cue()}{_SEPARATOR})+(?=.)", rf"(?s)^(.+?)(?:{_S}+{m.cue()})+\z"

    def apply(x: Column) -> Column:
        x = F.when(x.rlike(only), "").otherwise(x)
        x = F.when(x.rlike(behind_dash), trim(F.regexp_replace(x, behind_dash, "- "))).otherwise(x)
        x = F.when(x.rlike(front), trim(F.regexp_replace(x, front, ""))).otherwise(x)
        return F.when(x.rlike(end), trim(F.regexp_replace(x, end, "$1"))).otherwise(x)

    return apply


def _speakers(m: Mode) -> Callable[[Column], Column]:
    """The dialogue dash is put aside while inline sounds, one speaker's name, and stray spaces and colons go."""

    def apply(x: Column) -> Column:
        bare = trim(F.regexp_replace(x, "^-", ""))
        bare = F.regexp_replace(bare, m.cue("*"), " ")
        bare = F.regexp_replace(bare, rf"^[A-Z][A-Z0-9 .'-]{{1,30}}:{_S}*", "")
        bare = trim(F.regexp_replace(F.regexp_replace(bare, rf"{_S}+([,.;:!?])", "$1"), rf"{_S}{{2,}}", " "))
        bare = trim(F.regexp_replace(bare, rf"^[:;]+{_S}*", ""))
        dashed = F.when(bare == "", "").otherwise(F.concat(F.lit("- "), trim(F.regexp_replace(bare, "^-", ""))))
        return F.when(x.startswith("-"), dashed).otherwise(bare)

    return apply


def strip_hi(c: Column, name: str = DEFAULT_MODE) -> Column:
    """The text without hearing-impaired cues; lines without a letter or digit go too."""
    m = mode(name)
    sounds, speakers = _sounds(m), _speakers(m)
    only = rf"^(?:-{_S}*)?{m.cue()}(?:{_S}*[:\-]{_S}*)?\z"
    text = clean_text(F.regexp_replace(c, m.block(), "\n"))
    kept = F.filter(F.transform(F.transform(lines(text), sounds), speakers) if m.speakers else F.transform(lines(text), sounds), lambda x: x.rlike(r"[\p{L}\p{Nd}]") & ~x.rlike(only))
    return clean_text(F.array_join(kept, "\n"))
