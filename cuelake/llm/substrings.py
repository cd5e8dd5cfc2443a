"""Repeated-substring removal by a distributed merge sort of sparse suffixes.

Every byte covered by a 50-byte string (LENGTH) that also starts in a document with a smaller doc_id goes. Not all suffixes
are sorted, but those at anchors: in each 50-byte string, the 24-byte gram (GRAM) of least hash, the leftmost of equals. Equal
strings have their anchor at the same place, so the suffixes at anchors, taken with the bytes before them, show every match.

Texts are dealt once, by a hash of id and text, into runs of about RUN_BYTES, however large the input's partitions are, so a
task's memory doesn't grow with the input.

1. Copies: each run tells the digests of its texts; of equal texts only those with the least doc_id go on, the others are
   repeats as a whole.
2. Grams: each run tells its sorted gram hashes, delta-coded; grams seen in one document only are dropped.
3. Merge sort: for the rest, each run sorts its suffixes (50 bytes from the anchor, then the 26 before it, backwards),
   keeps equal ones once with their least doc_id, cuts them by gram, and sends front-coded runs. A loser tree merges the
   runs of a cut; a contender's known common prefix with the last output decides most matches, and bytes below it are never
   compared again. Neighbours that share the gram are one group; common prefixes and suffixes say which of the 27 strings
   round the anchor a smaller document has too.
4. Groups of more than HOT different contexts (the edges of a passage that very many documents share) aren't gathered:
   their strings themselves are sorted, kept once for each run, and merged by the same tree, so no task gets more of one
   string than there are runs.
5. Each run reads what concerns it and cuts its texts.

Texts and answers are dealt by the same partitioner, so their union is one partition a run, the answers first, and one Python
worker reads it. Every exchange is written once and read by all later steps; nothing is written to the shared folder. Answers
are found by content, so a run's rows may come in another order when they are read again; a mark that each run tells of its
rows makes other rows an error. Exchanges carry each string once for a run, however often it occurs there.

Null and empty texts keep nothing and lose nothing. Rows that share a doc_id remove nothing from each other. A null doc_id
counts as larger than any, and such rows remove nothing from each other. Every row gives one row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import common
from cuelake.llm.shingles import mix

LENGTH, GRAM = 50, 24
REACH = LENGTH - GRAM
HOT = 1024
#: Bytes of text that are read at once, and bytes of the input for each cut of an exchange.
CHUNK, CUT_BYTES = 1 << 17, 32 << 20
#: Bytes of text for each run; answers that a cut holds before it sends them.
RUN_BYTES, ANSWERS = 16 << 20, 1 << 16
_U = np.uint64
_LOW = _U(0xFFFFFFFF)
_LAST = 1 << 63
_PAD = 255  # in no UTF-8 text


def _hashes(raw: bytes) -> np.ndarray:
    """The hash of the gram at each place."""
    padded = np.frombuffer(raw + bytes(8), np.uint8)
    eight = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(raw),), (1,))
    m = len(raw) - GRAM + 1
    h = eight[:m] * _U(0x9E3779B97F4A7C15)
    h = (h ^ (h >> _U(32))) + eight[8 : m + 8] * _U(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> _U(29))) * _U(0xD6E8FEB86659FD93) + eight[16 : m + 16] * _U(0x165667B19E3779F9)
    return mix(h)


def anchors(raw: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, 48-bit gram hashes) of the anchors of the texts raw[bounds[i]:bounds[i + 1]], in order."""
    n = len(raw)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _hashes(raw)
    m = len(h)
    least = (h & ~_LOW) | np.arange(m, dtype=np.uint64)
    width = 1
    while 2 * width <= REACH + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if rest := REACH + 1 - width:
        least = np.minimum(least[:-rest], least[rest:])
    # strings that lie in one text
    inside = np.zeros(n + 2, np.int64)
    long = np.diff(bounds) >= LENGTH
    np.add.at(inside, bounds[:-1][long], 1)
    np.add.at(inside, bounds[1:][long] - LENGTH + 1, -1)
    at = (least[np.cumsum(inside)[: len(least)] > 0] & _LOW).astype(np.int64)
    at = at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at
    return at, h[at] >> _U(16)


def gram_hashes(grams: np.ndarray) -> np.ndarray:
    """The sorted hashes that anchors() gives these grams."""
    if not len(grams):
        return np.zeros(0, np.uint64)
    return np.unique(_hashes(grams.tobytes())[::GRAM] >> _U(16))


def contexts(raw: bytes, low: np.ndarray, high: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row for each anchor in a text raw[low:high]: LENGTH bytes from it on, then REACH before it, backwards, both filled up."""
    data = np.frombuffer(raw, np.uint8)
    ahead = at[:, None] + np.arange(LENGTH)
    behind = at[:, None] - 1 - np.arange(REACH)
    out = np.empty((len(at), LENGTH + REACH), np.uint8)
    out[:, :LENGTH] = np.where(ahead < high[:, None], data[np.minimum(ahead, len(data) - 1)], _PAD)
    out[:, LENGTH:] = np.where(behind >= low[:, None], data[np.maximum(behind, 0)], _PAD)
    return out


def places(low: np.ndarray, high: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest number of bytes by which strings may begin before each anchor."""
    return np.maximum(0, LENGTH - (high - at)), np.minimum(REACH, at - low)


def strings_round(low: np.ndarray, high: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the anchor, start) of every string round each anchor, by anchor, then from the last start to the first."""
    first, last = places(low, high, at)
    counts = np.maximum(0, last - first + 1)
    owner = np.repeat(np.arange(len(at)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return owner, at[owner] - first[owner] - nth


def strings(raw: bytes, starts: np.ndarray) -> np.ndarray:
    """The LENGTH bytes from each start on."""
    return np.frombuffer(raw, np.uint8)[starts[:, None] + np.arange(LENGTH)]


def digests(rows: np.ndarray) -> np.ndarray:
    """16 bytes for each row of bytes, as one array of strings."""
    n, width = rows.shape
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = rows
    words = words.view(np.uint64)
    out = np.empty((n, 2), np.uint64)
    for k, salt in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
        h = np.full(n, salt, np.uint64)
        for c in range(words.shape[1]):
            h = mix((h ^ words[:, c]) * _U(salt | 1))
        out[:, k] = h
    return out.view("S16").ravel()


def sorted_rows(rows: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows in order, the least doc_id of each, and whether several documents have it."""
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")
    rows, docs = rows[order], docs[order]
    at = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)])
    least = np.minimum.reduceat(docs, at)
    return rows[at], least, np.maximum.reduceat(docs, at) != least


# Sorted runs, front-coded, and their merge.


def front_code(rows: np.ndarray, docs: np.ndarray, many: np.ndarray) -> bytes:
    """Sorted distinct rows with their least doc_id and whether several documents have them."""
    known = np.zeros(len(rows), np.uint8)
    known[1:] = (rows[1:] != rows[:-1]).argmax(axis=1)
    rest = rows[np.arange(rows.shape[1]) >= known[:, None]]
    return zlib.compress(pickle.dumps((rows.shape[1], known.tobytes(), rest.tobytes(), docs.tobytes(), many.astype(np.uint8).tobytes())), 1)


def front_decode(code: bytes) -> Iterator[tuple[int, bytes, int, int]]:
    """(prefix known from the one before, string, least doc_id, in several documents)"""
    width, known, parts, docs, many = pickle.loads(zlib.decompress(code))
    at, before = 0, b""
    for k, d, m in zip(known, memoryview(docs).cast("Q"), many, strict=True):
        n = width - k
        before = before[:k] + parts[at : at + n]
        at += n
        yield k, before, d, m


def common_prefix(a: bytes, b: bytes, n: int) -> int:
    """The length of the common prefix, which is n at least."""
    top = min(len(a), len(b))
    while n < top and a[n : n + 8] == b[n : n + 8]:
        n += 8
    n = min(n, top)
    while n < top and a[n] == b[n]:
        n += 1
    return n


def merge(codes: list[bytes]) -> Iterator[tuple[int, bytes, int, int, int]]:
    """(prefix shared with the string before, string, run, least doc_id, in several) of all runs, sorted, by a loser tree."""
    runs = [front_decode(c) for c in codes]
    k = len(runs)
    size = 1 << max(0, (k - 1).bit_length())
    head: list = [None] * size  # a run's next row; None when it has ended
    text: list = [None] * size
    known = [0] * size  # prefix that a head shares with the last output

    for i, r in enumerate(runs):
        if row := next(r, None):
            head[i], text[i] = row, row[1]

    def play(i: int, j: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix is then that with the winner."""
        a, b = text[i], text[j]
        if a is None or b is None:
            return (j, i) if a is None else (i, j)
        if known[i] != known[j]:
            return (i, j) if known[i] > known[j] else (j, i)
        n = common_prefix(a, b, known[i])
        if n == len(a) or (n < len(b) and a[n] < b[n]):
            if n == len(a) == len(b) and j < i:
                i, j = j, i
            known[j] = n
            return i, j
        known[i] = n
        return j, i

    losers = [0] * size
    winners = [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    w = winners[1] if size > 1 else 0
    while text[w] is not None:
        _, s, doc, many = head[w]
        yield known[w], s, w, doc, many
        if row := next(runs[w], None):
            head[w], text[w], known[w] = row, row[1], row[0]
        else:
            head[w] = text[w] = None
        node = (w + size) >> 1
        while node:
            w, losers[node] = play(w, losers[node])
            node >>= 1


def judge(group: list[tuple[bytes, int, list]], shared: list[int]) -> list[tuple[int, int]]:
    """For each context of a gram's group the least and the greatest place before the anchor at which a string begins that
    a smaller document has too ((1, 0): none). shared: the prefix that each context has in common with the one before."""
    n = len(group)
    found = [(REACH + 1, -1)] * n
    least = [d for _, d, _ in group]
    cut = []
    for s, _, _ in group:
        x, p = s.find(_PAD, 0, LENGTH), s.find(_PAD, LENGTH)
        cut.append((s, LENGTH if x < 0 else x, REACH if p < 0 else p - LENGTH))
    if n <= 8:
        for i in range(n):
            near = len(group[i][0])
            for j in range(i + 1, n):
                near = min(near, shared[j])
                (a, x, p), (b, y, q) = cut[i], cut[j]
                ahead = min(near, x, y)
                behind = min(common_prefix(a, b, near) - LENGTH, p, q) if near >= LENGTH else min(common_prefix(a[LENGTH:], b[LENGTH:], 0), p, q)
                low, high = max(0, LENGTH - ahead), min(REACH, behind)
                if low <= high and least[i] != least[j]:
                    k = i if least[i] > least[j] else j
                    found[k] = (min(found[k][0], low), max(found[k][1], high))
        return found
    halves = [(s[:x], s[LENGTH : LENGTH + p]) for s, x, p in cut]
    for o in range(REACH + 1):
        first: dict[tuple[bytes, bytes], int] = {}
        keys = [(r[: LENGTH - o], b[:o]) if len(r) >= LENGTH - o and len(b) >= o else None for r, b in halves]
        for key, d in zip(keys, least, strict=True):
            if key and d < first.get(key, _LAST * 2):
                first[key] = d
        for i, key in enumerate(keys):
            if key and first[key] < least[i]:
                found[i] = (min(found[i][0], o), max(found[i][1], o))
    return found


ANSWER = np.dtype([("digest", "S16"), ("least", "<u8"), ("low", "u1"), ("high", "u1")])


def answer(rows: list[tuple[bytes, int, int, int]]) -> bytes:
    """(string, least doc_id, low, high) with digests for the strings."""
    out = np.empty(len(rows), ANSWER)
    out["digest"] = digests(np.frombuffer(b"".join([r[0] for r in rows]), np.uint8).reshape(len(rows), -1))
    for k, name in enumerate(ANSWER.names[1:], 1):
        out[name] = [r[k] for r in rows]
    return out.tobytes()


class Answers:
    """The answers of a cut for each run, sent whenever there are many."""

    def __init__(self, kind: str) -> None:
        self.kind, self.rows, self.count = kind, {}, 0

    def add(self, run: int, row: tuple[bytes, int, int, int]) -> None:
        self.rows.setdefault(run, []).append(row)
        self.count += 1

    def send(self) -> Iterator[tuple[int, str, bytes]]:
        for r, rows in self.rows.items():
            yield r, self.kind, answer(rows)
        self.rows, self.count = {}, 0


def merge_contexts(codes: list[tuple[int, bytes]], large: int = HOT) -> Iterator[tuple[int, str, bytes]]:
    """Answers (run, kind, payload) about one cut: context digest, its least doc_id, and the places found by judge()."""
    runs = [r for r, _ in codes]
    answers = Answers("context")
    hot: dict[int, set[bytes]] = {r: set() for r in runs}
    group: list[tuple[bytes, int, list]] = []
    shared: list[int] = []
    seen: set[int] | None = None  # the runs of a group that is too large to be gathered
    gram = b""

    def close() -> None:
        nonlocal seen
        if seen is not None:
            for r in seen:
                hot[r].add(gram)
        else:
            for (s, least, members), (low, high) in zip(group, judge(group, shared) if len(group) > 1 else [(REACH + 1, -1)] * len(group), strict=True):
                for r, doc, many in members:
                    if high >= 0 or many or doc > least:
                        answers.add(r, (s, least, low, high + 1))
        group.clear()
        shared.clear()
        seen = None

    for known, s, i, doc, many in merge([c for _, c in codes]):
        if known < GRAM:
            close()
            if answers.count >= ANSWERS:
                yield from answers.send()
            gram = s[:GRAM]
        if seen is not None:
            seen.add(runs[i])
        elif group and known == len(s) == len(group[-1][0]):
            last, least, members = group[-1]
            members.append((runs[i], doc, many))
            group[-1] = (last, min(least, doc), members)
        else:
            group.append((s, doc, [(runs[i], doc, many)]))
            shared.append(known)
            if len(group) > large:
                seen = {r for _, _, members in group for r, _, _ in members}
                group.clear()
                shared.clear()
    close()
    yield from answers.send()
    for r, grams in hot.items():
        if grams:
            yield r, "hot", b"".join(sorted(grams))


def merge_strings(codes: list[tuple[int, bytes]]) -> Iterator[tuple[int, str, bytes]]:
    """Answers about strings: digest and least doc_id, to runs that have them in a larger document."""
    runs = [r for r, _ in codes]
    answers = Answers("string")
    members: list[tuple[int, int, int]] = []
    before = b""

    def close() -> None:
        if members:
            least = min(d for _, d, _ in members)
            for r, doc, many in members:
                if many or doc > least:
                    answers.add(r, (before, least, 0, 0))
            members.clear()

    for known, s, i, doc, many in merge([c for _, c in codes]):
        if known < LENGTH:
            close()
            if answers.count >= ANSWERS:
                yield from answers.send()
            before = s
        members.append((runs[i], doc, many))
    close()
    yield from answers.send()


# What a run does, and what it is told.


def _bytes(text: str | bytes | None) -> bytes:
    return text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")


def deal_texts(runs: int):
    """Rows (id, bytes) by run, pickled; the same row always goes to the same run."""

    def deal(rows: Iterator[tuple[int | None, str | None]]) -> Iterator[tuple[int, tuple[str, bytes]]]:
        held: dict[int, list[tuple[int | None, bytes]]] = {}
        size = 0
        for key, text in rows:
            raw = _bytes(text)
            held.setdefault(zlib.crc32(_number(key).to_bytes(8, "little"), zlib.crc32(raw)) % runs, []).append((key, raw))
            size += len(raw)
            if size >= RUN_BYTES:
                for r in list(held):
                    yield r, ("texts", pickle.dumps(held.pop(r), -1))
                size = 0
        for r in list(held):
            yield r, ("texts", pickle.dumps(held.pop(r), -1))

    return deal


def texts_of(dealt: Iterator) -> Iterator[tuple[int | None, bytes]]:
    for _, (_, raw) in dealt:
        yield from pickle.loads(raw)


def told_texts(dealt: Iterator) -> Iterator[tuple[tuple[int | None, bytes], "Told | None"]]:
    """(row, its run's answers at the first one, else None) of one run, whose answers come before its texts."""
    told, ready = Told(), False
    for _, (kind, raw) in dealt:
        if kind != "texts":
            told.add(kind, raw)
            continue
        for row in pickle.loads(raw):
            yield row, None if ready else told.ready()
            ready = True


def _chunks(rows: Iterator[tuple[int | None, str | bytes | None]]) -> Iterator[tuple[list[int | None], list[bytes]]]:
    keys, texts, size = [], [], 0
    for key, text in rows:
        keys.append(key)
        texts.append(_bytes(text))
        size += len(texts[-1])
        if size >= CHUNK:
            yield keys, texts
            keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


class Told:
    """The answers that a run has got."""

    def __init__(self) -> None:
        self.rows, self.mark, self.copies, self.got = 0, 0, {}, {"grams": [], "context": [], "hot": [], "string": []}

    def add(self, kind: str, raw: bytes) -> None:
        if kind == "rows":
            self.rows, self.mark = int.from_bytes(raw[:8], "little"), int.from_bytes(raw[8:], "little")
        elif kind == "copies":
            self.copies |= {raw[i : i + 16]: int.from_bytes(raw[i + 16 : i + 24], "little") for i in range(0, len(raw), 24)}
        else:
            self.got[kind].append(undelta(raw) if kind == "grams" else raw if kind == "hot" else np.frombuffer(raw, ANSWER))

    def ready(self) -> "Told":
        self.grams = np.sort(np.concatenate([*self.got["grams"], np.zeros(0, np.uint64)]))
        self.hot = np.unique(np.frombuffer(b"".join(self.got["hot"]), f"S{GRAM}"))
        self.hot_hashes = gram_hashes(self.hot)
        self.contexts, self.strings = (np.sort(np.concatenate([*self.got[k], np.zeros(0, ANSWER)]), order="digest") for k in ("context", "string"))
        del self.got
        return self

    def are_hot(self, raw: bytes, at: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """Whether the gram at each anchor is a hot one; its hash rules most out."""
        out = _among(self.hot_hashes, grams)
        if out.any():
            rows = np.frombuffer(raw, np.uint8)[at[out][:, None] + np.arange(GRAM)]
            out[out] = _among(self.hot, np.ascontiguousarray(rows).view(f"S{GRAM}").ravel())
        return out


def look_up(answers: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each wanted digest among the answers, and whether it is there."""
    if not len(answers) or not len(wanted):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(answers["digest"], wanted), len(answers) - 1)
    return at, answers["digest"][at] == wanted


def delta(values: np.ndarray) -> bytes:
    """Sorted 48-bit values; gaps as 32-bit numbers where they fit."""
    gaps = np.diff(values, prepend=_U(0))
    narrow = not len(gaps) or int(gaps[1:].max(initial=0)) < 1 << 32
    return bytes([narrow]) + (values[:1].tobytes() + gaps[1:].astype(np.uint32).tobytes() if narrow else values.tobytes())


def undelta(raw: bytes) -> np.ndarray:
    if not raw[0]:
        return np.frombuffer(raw, np.uint64, offset=1)
    first = np.frombuffer(raw[1:9], np.uint64)
    return np.cumsum(np.concatenate([first, np.frombuffer(raw, np.uint32, offset=9).astype(np.uint64)]), dtype=np.uint64) if len(raw) > 1 else np.zeros(0, np.uint64)


def _number(key: int | None) -> int:
    return _LAST * 2 - 1 if key is None else key + _LAST


def _mark(number: int, digest: bytes) -> int:
    """A row's part in its run's mark; marks add up in any order."""
    return int.from_bytes(hashlib.md5(digest + number.to_bytes(8, "little")).digest()[:8], "little")


def tell_copies(cuts: int):
    """The digests of the run's texts with their least doc_ids, apart for those of several of its rows; its count and mark."""

    def run(i: int, rows: Iterator) -> Iterator[tuple[int, tuple[int, str, bytes]]]:
        least: dict[bytes, int] = {}
        several: set[bytes] = set()
        count = mark = 0
        for keys, texts in _chunks(rows):
            count += len(keys)
            for key, text in zip(keys, texts, strict=True):
                d, n = hashlib.md5(text).digest(), _number(key)
                mark += _mark(n, d)
                if d in least:
                    several.add(d)
                least[d] = min(n, least.get(d, n))
        parts: dict[tuple[int, str], list[bytes]] = {}
        for d, n in least.items():
            parts.setdefault((int.from_bytes(d[:4], "little") % cuts, "several" if d in several else "copies"), []).append(d + n.to_bytes(8, "little"))
        for (c, kind), p in parts.items():
            yield c, (i, kind, b"".join(p))
        yield i % cuts, (i, "rows", count.to_bytes(8, "little") + (mark % (1 << 64)).to_bytes(8, "little"))

    return run


def merge_copies(rows: Iterator) -> Iterator[tuple[int, str, bytes]]:
    """To each run the least doc_ids of the texts that it has several times or that another run has with a smaller one."""
    least: dict[bytes, int] = {}
    got = []
    for _, (i, kind, raw) in rows:
        if kind == "rows":
            yield i, kind, raw
            continue
        got.append((i, kind, raw))
        for at in range(0, len(raw), 24):
            d, n = raw[at : at + 16], int.from_bytes(raw[at + 16 : at + 24], "little")
            if n < least.get(d, _LAST * 2):
                least[d] = n
    for i, kind, raw in got:
        far = [raw[at : at + 16] + least[raw[at : at + 16]].to_bytes(8, "little") for at in range(0, len(raw), 24) if kind == "several" or least[raw[at : at + 16]] < int.from_bytes(raw[at + 16 : at + 24], "little")]
        if far:
            yield i, "copies", b"".join(far)


class Firsts:
    """The texts of a run that are no copies, chunk by chunk, with their anchors. Rows are (row, answers or None)."""

    def __init__(self, rows: Iterator) -> None:
        self.told: Told = Told()
        self.rows = rows

    def _plain(self) -> Iterator:
        for row, told in self.rows:
            if told is not None:
                self.told = told
            yield row

    def chunks(self) -> Iterator[tuple[list[int], list[int | None], list[bytes], list[bool], bytes, np.ndarray, np.ndarray, np.ndarray]]:
        """(numbers of the ids, ids, texts, which are copies, the others' bytes and bounds, their anchors and gram hashes)

        A row is a copy if a smaller id has its text, in whatever order a run's rows come. A run whose rows aren't those
        that it told of, as of an input that changes when it is read again, is an error."""
        mark = 0
        for keys, texts in _chunks(self._plain()):
            numbers, copies = [_number(k) for k in keys], []
            for n, text in zip(numbers, texts, strict=True):
                d = hashlib.md5(text).digest()
                mark += _mark(n, d)
                copies.append(self.told.copies.get(d, n) < n)
            own = [b"" if c else t for c, t in zip(copies, texts, strict=True)]
            raw = b"".join(own)
            bounds = np.concatenate([[0], np.cumsum([len(t) for t in own])])
            at, grams = anchors(raw, bounds)
            yield numbers, keys, texts, copies, raw, bounds, at, grams
        if mark % (1 << 64) != self.told.mark:
            raise ValueError("a partition gave other rows when it was read again; write the input to a table first")


def gram_edges(cuts: int) -> np.ndarray:
    """Where each cut's gram hashes begin, and their end. An anchor's hash is the least of a window's, so small ones are
    frequent: a place is an anchor if the greater hashes on both sides of it are REACH in all. Cuts get as many anchors each."""
    hashes = np.linspace(0, 1, (1 << 16) + 1)
    above = 1 - hashes
    below = 1 - ((REACH + 2) * above ** (REACH + 1) - REACH * above ** (REACH + 2)) / 2
    share = np.interp(np.arange(cuts) / cuts, below, hashes)
    return np.append((share * (1 << 48)).astype(np.uint64), _U(1 << 48))


def tell_grams(cuts: int):
    bounds_of_cuts = gram_edges(cuts)

    def run(i: int, rows: Iterator) -> Iterator[tuple[int, tuple[int, bytes, bytes]]]:
        grams, owners, base = [], [], 0
        for numbers, _, _, _, _, bounds, at, found in Firsts(rows).chunks():
            grams.append(found)
            owners.append((np.searchsorted(bounds, at, "right") - 1 + base).astype(np.uint32))
            base += len(numbers)
        if not grams:
            return
        g, o = np.concatenate(grams), np.concatenate(owners)
        order = np.argsort(g, kind="stable")
        g, o = g[order], o[order]
        new = np.r_[True, g[1:] != g[:-1]] if len(g) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        stops = np.append(at[1:], len(g)) - 1
        several = o[at] != o[stops] if len(at) else np.zeros(0, bool)
        g = g[at]
        edges = np.searchsorted(g, bounds_of_cuts)
        for c in range(cuts):
            a, b = edges[c], edges[c + 1]
            if b > a:
                yield c, (i, delta(g[a:b]), np.packbits(several[a:b]).tobytes())

    return run


def merge_grams(rows: Iterator) -> Iterator[tuple[int, str, bytes]]:
    """To each run those of its grams that more than one document has."""
    got = [(i, undelta(raw), bits) for _, (i, raw, bits) in rows]
    if not got:
        return
    every = np.concatenate([v for _, v, _ in got])
    every.sort()
    twice = every[1:][every[1:] == every[:-1]]
    inside = [v[np.unpackbits(np.frombuffer(bits, np.uint8), count=len(v)).astype(bool)] for _, v, bits in got]
    repeated = np.unique(np.concatenate([twice, *inside]))
    del every, twice, inside
    for i, v, _ in got:
        at = np.searchsorted(repeated, v)
        mine = v[(at < len(repeated)) & (repeated[np.minimum(at, len(repeated) - 1)] == v)] if len(repeated) else v[:0]
        if len(mine):
            yield i, "grams", delta(mine)


def _among(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value is one of the sorted known ones."""
    if not len(known) or not len(values):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def tell_strings(cuts: int, hot: bool):
    """Sorted front-coded runs of contexts or, for hot grams, of the strings themselves."""

    def run(i: int, rows: Iterator) -> Iterator[tuple[int, tuple[int, bytes]]]:
        found, docs = [], []
        firsts = Firsts(rows)
        for numbers, _, _, _, raw, bounds, at, grams in firsts.chunks():
            if hot and not len(firsts.told.hot):
                return
            use = _among(firsts.told.grams, grams)
            if hot:
                use[use] = firsts.told.are_hot(raw, at[use], grams[use])
            at = at[use]
            if not len(at):
                continue
            d = np.searchsorted(bounds, at, "right") - 1
            if hot:
                owner, starts = strings_round(bounds[d], bounds[d + 1], at)
                rows_, d = strings(raw, starts), d[owner]
            else:
                rows_ = contexts(raw, bounds[d], bounds[d + 1], at)
            found.append(rows_)
            docs.append(np.array(numbers, np.uint64)[d])
        if not found or not sum(map(len, found)):
            return
        every, least, many = sorted_rows(np.concatenate(found), np.concatenate(docs))
        found.clear()
        cut = _cuts_of(every, cuts, hot)
        for c in np.unique(cut).tolist():
            mine = cut == c
            yield c, (i, front_code(every[mine], least[mine], many[mine]))

    return run


def _cuts_of(rows: np.ndarray, cuts: int, hot: bool) -> np.ndarray:
    """Where rows go: by gram, so that a gram's contexts meet; strings by themselves."""
    key = digests(rows if hot else rows[:, :GRAM]).view(np.uint64)[::2]
    return (key % _U(cuts)).astype(np.int64)


def cut_texts(i: int, rows: Iterator) -> Iterator[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of each row; spans: removed (start, end) in bytes."""
    firsts = Firsts(rows)
    for numbers, keys, texts, copies, raw, bounds, at, grams in firsts.chunks():
        told = firsts.told
        use = _among(told.grams, grams)
        at, is_hot = at[use], told.are_hot(raw, at[use], grams[use])
        doc = np.searchsorted(bounds, at, "right") - 1
        number = np.array(numbers, np.uint64)
        begin, end, owner = [], [], []
        if len(cold := np.flatnonzero(~is_hot)):
            p, d = at[cold], doc[cold]
            low, high = bounds[d], bounds[d + 1]
            k, there = look_up(told.contexts, digests(contexts(raw, low, high, p)))
            p, d, low, high = p[there], d[there], low[there], high[there]
            got = told.contexts[k[there]]
            first, last = places(low, high, p)
            own = got["least"] >= number[d]  # the least document itself: what judge() found
            first = np.where(own, got["low"].astype(np.int64), first)
            last = np.where(own, got["high"].astype(np.int64) - 1, last)
            some = first <= last
            begin.append((p - last)[some])
            end.append((p - first + LENGTH)[some])
            owner.append(d[some])
        if len(warm := np.flatnonzero(is_hot)):
            p, d = at[warm], doc[warm]
            of, starts = strings_round(bounds[d], bounds[d + 1], p)
            k, there = look_up(told.strings, digests(strings(raw, starts)))
            gone = there.copy()
            gone[there] = told.strings["least"][k[there]] < number[d[of[there]]]
            begin.append(starts[gone])
            end.append(starts[gone] + LENGTH)
            owner.append(d[of[gone]])
        spans: dict[int, list[list[int]]] = {}
        if begin:
            b, e, o = np.concatenate(begin), np.concatenate(end), np.concatenate(owner)
            order = np.argsort(b, kind="stable")
            b, e, o = b[order], np.maximum.accumulate(e[order]) if len(e) else e, o[order]
            # texts lie one after another, so ends only have to be told apart where the text changes
            new = np.flatnonzero(np.r_[True, (b[1:] > e[:-1]) | (o[1:] != o[:-1])]) if len(b) else b
            for x, y, t in zip(b[new].tolist(), e[np.append(new[1:], len(b)) - 1].tolist() if len(b) else [], o[new].tolist(), strict=True):
                spans.setdefault(t, []).append([x - int(bounds[t]), y - int(bounds[t])])
        for t, (key, text) in enumerate(zip(keys, texts, strict=True)):
            gone = spans.get(t, []) if not copies[t] else [[0, len(text)]] if len(text) >= LENGTH else []
            kept, here = hashlib.sha256(), 0
            for x, y in gone:
                kept.update(text[here:x])
                here = y
            kept.update(text[here:])
            yield key, len(text), sum(y - x for x, y in gone), len(gone), kept.hexdigest(), gone


def _grouped(merge_one):
    """Runs merge_one over the codes of each cut of a partition."""

    def run(rows: Iterator) -> Iterator[tuple[int, str, bytes]]:
        cuts: dict[int, list] = {}
        for c, code in rows:
            cuts.setdefault(c, []).append(code)
        for c in sorted(cuts):
            yield from merge_one(sorted(cuts.pop(c)))

    return run


def removals(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, run_bytes: int = RUN_BYTES) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans), a row for each of df's."""
    spark = df.sparkSession
    base = df.select(id_col, text_col).rdd
    size = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    runs = max(1, base.getNumPartitions(), -(-size // run_bytes))
    cuts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // CUT_BYTES))
    identity = lambda x: x

    def answers(told: RDD, merge_one) -> RDD:
        """What merge_one makes of each cut, dealt to the runs."""
        return told.partitionBy(cuts, identity).mapPartitions(merge_one).map(lambda m: (m[0], m[1:])).partitionBy(runs, identity)

    def with_answers(*got: RDD) -> RDD:
        """Rows of the input, the first of each run with its answers."""
        both = reduce(RDD.union, [*got, texts])
        if both.getNumPartitions() != texts.getNumPartitions():
            raise ValueError("texts and answers weren't dealt alike")
        return both.mapPartitions(told_texts)

    texts = base.mapPartitions(deal_texts(runs)).partitionBy(runs, identity)
    copies = answers(texts.mapPartitions(texts_of).mapPartitionsWithIndex(tell_copies(cuts)), merge_copies)
    grams = answers(with_answers(copies).mapPartitionsWithIndex(tell_grams(cuts)), merge_grams)
    contexts = answers(with_answers(copies, grams).mapPartitionsWithIndex(tell_strings(cuts, False)), _grouped(partial(merge_contexts, large=hot)))
    strings = answers(with_answers(copies, grams, contexts).mapPartitionsWithIndex(tell_strings(cuts, True)), _grouped(merge_strings))
    rows = with_answers(copies, grams, contexts, strings).mapPartitionsWithIndex(cut_texts)
    return spark.createDataFrame(rows, f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>", verifySchema=False)


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(common.load(spark, sf_dir, "documents")).drop("spans")
