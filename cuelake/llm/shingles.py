"""Five-word shingles of texts as 64-bit numbers, vectorised over the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORDS = 5
#: Bytes of text that are worked on at once; a longer text is taken alone.
CHUNK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit hangs on every input bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, 1 << 20), base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts in lower case, and n + 1 offsets; null texts are empty."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    if low.offset:
        low = pa.concat_arrays([low])
    offsets = np.frombuffer(low.buffers()[1], np.int64, len(low) + 1, low.offset * 8)
    data = low.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes in lower case, their offsets) of rows of CHUNK bytes together, or of one."""
    data, offsets = lowered(texts)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        yield at, stop, data, offsets[at : stop + 1]
        at = stop


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each word, a run of bytes that aren't ASCII white space, in order."""
    first, last = int(offsets[0]), int(offsets[-1])
    data = data[first:last]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    bounds = offsets - first
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    solid = ~_SPACE[data]
    before = np.concatenate([[False], solid[:-1]])
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.concatenate([solid[1:], [False]])
    stops = np.flatnonzero(solid & (~after | edge[1:])) + 1
    power, inverse = _powers(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power, dtype=np.uint64)])
    return np.searchsorted(bounds, starts, "right") - 1, mix((sums[stops] - sums[starts]) * inverse[starts])


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle) with repeats, in order; a text of one to four words has one shingle, of them all."""
    text, word = word_hashes(data, offsets)
    if not len(text):
        return text, word
    n = len(offsets) - 1
    counts = np.bincount(text, minlength=n)
    ends = np.cumsum(counts)
    left = ends[text] - np.arange(len(text))  # words from here to the text's end
    at = np.flatnonzero((left >= WORDS) | ((counts[text] < WORDS) & (left == counts[text])))
    total = np.zeros(len(at), np.uint64)
    padded = np.concatenate([word, np.zeros(WORDS, np.uint64)])
    for k in range(WORDS):
        total = mix(total + np.where(left[at] > k, padded[at + k], _U(0)) + _U(k + 1))
    return text[at], total


def multisets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, times), sorted by text and shingle."""
    text, key = shingles(data, offsets)
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(new)
    return text[at], key[at], np.diff(np.append(at, len(text)))


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The weighted Jaccard similarity of two multisets (sorted shingles, times)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    whole = int(a[1].sum()) + int(b[1].sum()) - common
    return common / whole if whole else 0.0
