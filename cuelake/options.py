"""Options of the two pipelines, and reading them from the environment: argument, then variable, then default."""

from __future__ import annotations

import os
from dataclasses import dataclass, replace

from cuelake.functions import hi
from cuelake.functions.layout import MAX_LINE_LENGTH, MIN_WORDS_MERGE
from cuelake.functions.timing import parse_duration

#: What a flag's variable may say.
_TRUE, _FALSE = ("1", "t", "true", "y", "yes", "on"), ("0", "f", "false", "n", "no", "off")


@dataclass(frozen=True)
class FixOptions:
    """min_words_merge is the most words that a line may have to count as short. shift is in nanoseconds."""

    max_line_length: int = MAX_LINE_LENGTH
    min_words_merge: int = MIN_WORDS_MERGE
    strip_style: bool = False
    strip_hi: bool = False
    strip_hi_mode: str = hi.DEFAULT_MODE
    skip_translator: bool = True
    shift_ns: int = 0

    def __post_init__(self) -> None:
        if self.max_line_length <= 0:
            object.__setattr__(self, "max_line_length", MAX_LINE_LENGTH)
        if self.min_words_merge <= 0:
            object.__setattr__(self, "min_words_merge", MIN_WORDS_MERGE)
        object.__setattr__(self, "strip_hi_mode", self.strip_hi_mode.strip().lower() or hi.DEFAULT_MODE)
        hi.mode(self.strip_hi_mode)


@dataclass(frozen=True)
class TranslateOptions:
    target_language: str
    model: str = ""
    source_language: str = ""
    api_keys: str = ""
    base_url: str = ""
    max_batch_chars: int = 7000
    max_workers: int = 2
    rps: float = 4.0
    retry_max_attempts: int = 5
    retry_parse_max_attempts: int = 2
    request_timeout_s: float = 150.0

    def __post_init__(self) -> None:
        if not self.target_language.strip():
            raise ValueError("target_language is required")
        for name, default in (("max_batch_chars", 7000), ("max_workers", 2), ("retry_max_attempts", 5), ("retry_parse_max_attempts", 2), ("request_timeout_s", 150.0)):
            if getattr(self, name) <= 0:
                object.__setattr__(self, name, default)
        object.__setattr__(self, "api_keys", ",".join(split_keys(self.api_keys)))


def split_keys(text: str) -> list[str]:
    return [k for k in (p.strip() for p in text.split(",")) if k]


def env_text(name: str) -> str | None:
    """The variable's value without surrounding space; blank counts as unset."""
    return os.environ.get(name, "").strip() or None


def env_flag(name: str) -> bool | None:
    text = env_text(name)
    if text is None:
        return None
    if text.lower() in _TRUE + _FALSE:
        return text.lower() in _TRUE
    raise ValueError(f"{name}={text!r} is neither true nor false")


def resolved(options, prefix: str, given: set[str] = frozenset()):
    """options with the fields that weren't given taken from variables PREFIX_FIELD where those are set."""
    found = {}
    for name, old in vars(options).items():
        key = f"{prefix}_{name}".upper()
        if name in given or env_text(key) is None:
            continue
        found[name] = env_flag(key) if isinstance(old, bool) else parse_duration(env_text(key)) if name == "shift_ns" else type(old)(env_text(key))
    return replace(options, **found)
