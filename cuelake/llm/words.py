"""Distinct-word encoding: texts are split into the tokenizer's own pre-tokens, each distinct one is encoded once."""

from __future__ import annotations

import codecs
import re
from collections.abc import Collection
from contextlib import suppress

import regex
from tokenizers import Tokenizer

#: The longest words that stay in a full table.
SHORT_WORD = 10
#: Texts that are taken from a batch at a time.
TEXTS = 4

#: Byte-level vocabularies show printable Latin-1 bytes as themselves, the others from U+0100 on; 0xFF is in no UTF-8 text.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHERS = [b for b in range(256) if b not in _PLAIN]
_SHOWN = "".join(chr(b) if b in _PLAIN else chr(256 + _OTHERS.index(b)) for b in range(256))

_HELD: dict[str, "WordTable"] = {}
_EXOTIC = re.compile("[\xb2\xb3\xb9\xbc-\xbeɐ-\U0010ffff\x1c-\x1f\x85]")
#: The letters of texts that aren't exotic, and of their lower case: a plain set matches faster than its description.
_LETTER = "[" + "".join(sorted({x for n in range(0x250) for x in chr(n) + chr(n).lower() if x.isalpha()})) + "]"


class WordTable:
    """word -> (ids, ...) for one tokenizer file, filled by need, a text's new words at a time.

    limit: distinct words that a worker remembers; it bounds memory and changes no result."""

    limit = 600_000

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        # the model's own cache would only be asked for words that are new here
        self.tokenizer.model._resize_cache(0)
        self.words: dict = {}
        self.specials = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}

    def fill(self, new: set[str]) -> None:
        """Runs the tokenizer's model over the words, in the visible characters that stand for their bytes."""
        words = list(new)
        shown = codecs.charmap_decode(b"\xff".join([w.encode() for w in words]), "strict", _SHOWN)[0].split("\xff")
        model, entry, known = self.tokenizer.model.tokenize, self.entry, self.words
        for word, text in zip(words, shown, strict=True):
            known[word] = entry([t.id for t in model(text)])

    def entry(self, ids: list[int]):
        """What the table holds of a word; never None."""
        return ids

    def make_room(self, n: int) -> None:
        """A table that n new words would overfill lets its longer words go, which come again least."""
        known = self.words
        if len(known) + n > self.limit:
            short = {w: e for w, e in known.items() if len(w) <= SHORT_WORD}
            known.clear()
            if len(short) < self.limit * 3 // 4:
                known.update(short)

    def look_up(self, words: list[str]) -> list:
        """The entries of words, in their positions; new words are encoded together and learnt."""
        entries = list(map(self.words.get, words))
        holes, at = [], -1
        with suppress(ValueError):
            while True:
                at = entries.index(None, at + 1)
                holes.append(at)
        if holes:
            new = {words[i] for i in holes}
            self.make_room(len(new))
            self.fill(new)
            for i in holes:
                entries[i] = self.words[words[i]]
        return entries

    def split(self, text: str) -> list[str]:
        raise NotImplementedError

    def encode(self, text: str) -> list:
        """The entries of a text, special tokens' strings taken out first."""
        entries: list = []
        for run, special in split_specials(text, self.specials):
            entries += [self.entry([self.specials[run]])] if special else self.look_up(self.split(run))
        return entries


def held(kind: type, path: str) -> WordTable:
    """The worker's table of this kind and file; Python workers that Spark uses again keep it."""
    key = f"{kind.__name__}:{path}"
    if key not in _HELD:
        _HELD[key] = kind(path)
    return _HELD[key]


#: The byte-level vocabulary's public pre-token pattern.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same for texts of ASCII and Latin letters, for the faster matcher.
_BYTE_LATIN = re.compile(rf" ?{_LETTER}+| ?\d+|'(?:s|t|re|ve|m|ll|d)| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_BYTE_ANY = regex.compile(BYTE_PATTERN)

#: The word vocabulary's public pre-token pattern, after its normalizer has made all white space U+0020.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^ \p{L}\p{N}]+"
_WORD_LATIN = re.compile(rf"{_LETTER}+|\d|'(?:s|t|re|ve|m|ll|d)|(?:[^\s\w]|_)+")
_WORD_ANY = regex.compile(WORD_PATTERN)


def byte_words(text: str) -> list[str]:
    return (_BYTE_ANY if _EXOTIC.search(text) else _BYTE_LATIN).findall(text)


def word_words(text: str, tokenizer: Tokenizer) -> list[str]:
    if _EXOTIC.search(text):
        return _WORD_ANY.findall(tokenizer.normalizer.normalize_str(text))
    return _WORD_LATIN.findall(text.lower())


def split_specials(text: str, specials: Collection[str]) -> list[tuple[str, bool]]:
    """text in runs, with whether a run is a special token's string; the library takes those out first."""
    if not any(s in text for s in specials):
        return [(text, False)]
    cut = re.split("(" + "|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True)) + ")", text)
    return [(x, x in specials) for x in cut if x]
