"""Language identification by rank order: a text's most frequent n-grams against each language's.

Words are runs of letters and marks, in lower case, with a space before and after; their n-grams have one to MOST_N characters.
A gram is a number, its code points side by side in 21 bits each, so shorter grams come first and equal ones are told exactly.
A language's profile is its PROFILE most frequent grams over all documents that it may learn from, counted in tasks and summed
by exchange; of equally frequent ones the smaller number. A text's profile is made in the same way. The distance of the two is
how far each of the text's grams is out of place, PROFILE if the language lacks it; the nearest language is told, of equally
near ones the first by name, and 1 - distance / greatest distance as score.

Profiles go to the tasks as postings (gram, language, rank) of PAGE languages at once, in order of their names; more languages
take a further pass over the texts each, that improves what the ones before found. So tasks hold PAGE * PROFILE postings at
most, and no language is left out.

Documents whose crc32(doc_id as text) mod 3 is 1 are held out: nothing is learnt from them, nor from null doc_ids or langs.
Null texts and texts without a letter are `und` with score 0, as is everything where nothing was learnt. Every row gives one
row, repeated rows and null ids too; other columns are ignored. Long texts are counted in pieces.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelake.llm import common

MOST_N, PROFILE = 3, 300
#: Languages whose profiles a task holds at once.
PAGE = 4096
#: Code points whose grams are counted at once.
PIECE = 1 << 20
#: Grams that a task counts before it hands them on.
HELD_GRAMS = 1 << 20
OUT_ROWS = 1 << 16
NONE = "und"
_PAD, _BITS = 32, 21


@functools.lru_cache(1)
def _kinds() -> np.ndarray:
    """For each code point 2 if it is a letter, 1 a mark, else 0."""
    return np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.int8)


def codes(text: str) -> np.ndarray | None:
    """The code points of text's words, a space around each; nothing if there is no letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = _kinds()[c]
    if not (kinds == 2).any():
        return None
    c = np.concatenate([[_PAD], np.where(kinds > 0, c, _PAD), [_PAD]]).astype(np.int64)
    return c[np.r_[True, (c[1:] != _PAD) | (c[:-1] != _PAD)]]


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, with the sum of its n."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(n, first)


def counts(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(grams in order, how often each occurs) of what codes() gives."""
    parts = []
    for at in range(0, len(c), PIECE):
        some = c[at : at + PIECE + MOST_N - 1]
        grams = []
        for n in range(1, MOST_N + 1):
            inner = some[: max(0, min(PIECE, len(some) - n + 1))]
            gram, whole = inner, inner != _PAD if n == 1 else np.ones(len(inner), bool)
            for k in range(1, n):
                follow = some[k : k + len(inner)]
                gram = gram << _BITS | follow
                if k < n - 1:
                    whole = whole & (follow != _PAD)
            grams.append(gram[whole])
        parts.append(np.unique(np.concatenate(grams), return_counts=True))
    return parts[0] if len(parts) == 1 else _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def ranked(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The PROFILE most frequent grams, in order."""
    # keys are in order, so a stable sort settles ties
    return keys[np.argsort(-n, kind="stable")[:PROFILE]]


def spelled(key: Column) -> Column:
    """A gram's characters."""
    parts = [F.shiftright(key, _BITS * k).bitwiseAND((1 << _BITS) - 1) for k in range(MOST_N - 1, -1, -1)]
    # a code point's UTF-8 by way of UTF-32
    return F.concat(*[F.when(p == 0, "").otherwise(F.decode(F.unhex(F.lpad(F.hex(p), 8, "0")), "UTF-32")) for p in parts])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def gram_counts(df: DataFrame) -> DataFrame:
    """(lang, gram, n) over df's (lang, text) with a lang."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def rows(held: dict[str, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for lang, (keys, n) in held.items():
            for at in range(0, len(keys), OUT_ROWS):
                k, m = keys[at : at + OUT_ROWS], n[at : at + OUT_ROWS]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(m)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                c = codes(text) if text else None
                if c is None:
                    continue
                got = counts(c)
                waiting.setdefault(lang.as_py(), []).append(got)
                size += len(got[0])
                if size > HELD_GRAMS:
                    for name, parts in waiting.items():
                        parts += [held[name]] if name in held else []
                        held[name] = _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                    waiting, size = {}, sum(len(k) for k, _ in held.values())
                    if size > HELD_GRAMS // 2:
                        yield from rows(held)
                        held, size = {}, 0
        for name, parts in waiting.items():
            parts += [held[name]] if name in held else []
            held[name] = _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        yield from rows(held)

    counted = df.filter(df["lang"].isNotNull()).select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def profiles(df: DataFrame) -> DataFrame:
    """(lang, rank from 0, gram, n, spelled): each language's profile. A task keeps PROFILE rows a language before they are exchanged."""
    by = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = gram_counts(df).withColumn("rank", F.row_number().over(by) - 1).filter(F.col("rank") < PROFILE)
    return top.select("lang", F.col("rank").cast("long").alias("rank"), "gram", "n", spelled(F.col("gram")).alias("spelled"))


class Postings:
    """The profiles of some languages by gram."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.langs = sorted({r[0] for r in rows})
        place = {x: i for i, x in enumerate(self.langs)}
        rows = sorted((gram, place[lang], rank) for lang, rank, gram in rows)
        gram, self.lang, self.rank = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        self.grams, self.start = np.unique(gram, return_index=True)
        self.stop = np.append(self.start[1:], len(rows))

    def nearest(self, profile: np.ndarray) -> tuple[str, float]:
        """(language, score) of a text's profile."""
        at = np.minimum(np.searchsorted(self.grams, profile), len(self.grams) - 1)
        own = np.flatnonzero(self.grams[at] == profile)
        start, size = self.start[at[own]], (self.stop - self.start)[at[own]]
        # the postings of all hits, one after the other
        post = np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if len(own) else np.zeros(0, np.int64)
        near = np.bincount(self.lang[post], PROFILE - np.abs(self.rank[post] - np.repeat(own, size)), len(self.langs))
        best = int(near.argmax())
        return self.langs[best], float(1 - (len(profile) * PROFILE - int(near[best])) / (len(profile) * PROFILE))


def _pages(known: DataFrame) -> Iterator[Postings]:
    """Postings of PAGE languages at once, in order of their names."""
    last = None
    while True:
        names = known.select("lang").distinct()
        names = [r["lang"] for r in (names if last is None else names.filter(F.col("lang") > last)).orderBy("lang").limit(PAGE).collect()]
        if not names:
            return
        last = names[-1]
        # PAGE * PROFILE rows at most
        yield Postings([tuple(r) for r in known.filter(F.col("lang").between(names[0], last)).select("lang", "rank", "gram").collect()])
        if len(names) < PAGE:
            return


def _pass(df: DataFrame, page: Postings, keep_text: bool) -> DataFrame:
    """df (doc_id, held_out, lang_pred, score, text) with what this page's languages improve."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), *([("text", pa.string())] if keep_text else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, common.BATCH_ROWS):
                part = batch.slice(at, common.BATCH_ROWS)
                found, scores = part.column(2).to_pylist(), part.column(3).to_pylist()
                for i, text in enumerate(part.column(4)):
                    text = text.as_py()
                    c = codes(text) if text else None
                    if c is None:
                        continue
                    lang, score = page.nearest(ranked(*counts(c)))
                    if scores[i] is None or score > scores[i]:
                        found[i], scores[i] = lang, score
                columns = [part.column(0).cast(pa.int64()), part.column(1), pa.array(found, pa.string()), pa.array(scores, pa.float64()), *([part.column(4).cast(pa.string())] if keep_text else [])]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return df.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double" + (", text string" if keep_text else ""))


def identify(df: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), a row for each of df's, by the profiles known. Those are read several times."""
    none = [F.lit(None).cast("string").alias("lang_pred"), F.lit(None).cast("double").alias("score")]
    out = df.select("doc_id", held_out(df["doc_id"]).alias("held_out"), *none, "text")
    pages = list(_pages(known)) if known.limit(1).count() else []
    for n, page in enumerate(pages, 1):
        out = _pass(out, page, n < len(pages))
    return out.select("doc_id", "held_out", F.coalesce("lang_pred", F.lit(NONE)).alias("lang_pred"), F.coalesce("score", F.lit(0.0)).alias("score"))


def learn(df: DataFrame) -> DataFrame:
    """profiles() of the documents that aren't held out, kept in the shared folder."""
    return common.durable(profiles(df.filter(F.crc32(df["doc_id"].cast("string")) % 3 != 1)))


def op13_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents")
    return identify(docs, learn(docs))


_CRC = "xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda r, c: list_reduce(range(8), lambda k, i: xor(k >> 1, 3988292384 * (k & 1)), xor(r, c)), 4294967295), 4294967295)"
OP13_SQL = rf"""
WITH d AS (SELECT doc_id, {_CRC} % 3 = 1 AS held_out, lang, lower(coalesce(text, '')) AS t FROM documents),
w AS (SELECT doc_id, held_out, lang, ' ' || unnest(regexp_extract_all(t, '[\p{{L}}\p{{M}}]+')) || ' ' AS word FROM d WHERE regexp_matches(t, '\p{{L}}')),
u AS (SELECT doc_id, held_out, lang, word, count(*) AS n FROM w GROUP BY ALL),
g AS (SELECT doc_id, held_out, lang, n, unnest(list_concat(
        list_transform(range(2, length(word)), lambda i: word[i]),
        list_transform(range(1, length(word)), lambda i: word[i:i + 1]),
        list_transform(range(1, length(word) - 1), lambda i: word[i:i + 2]))) AS gram FROM u),
own AS (SELECT doc_id, held_out, lang, gram, sum(n) AS n FROM g GROUP BY ALL),
placed AS (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(gram), gram) - 1 AS place FROM own QUALIFY place < {PROFILE}),
known AS (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, length(gram), gram) - 1 AS rank
          FROM own WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, gram QUALIFY rank < {PROFILE}),
sizes AS (SELECT doc_id, count(*) * {PROFILE} AS worst FROM placed GROUP BY doc_id),
near AS (SELECT p.doc_id, k.lang, sum({PROFILE} - abs(p.place - k.rank)) AS near FROM placed p JOIN known k USING (gram) GROUP BY ALL),
scored AS (SELECT s.doc_id, l.lang, s.worst, coalesce(n.near, 0) AS near FROM sizes s, (SELECT DISTINCT lang FROM known) l LEFT JOIN near n ON n.doc_id = s.doc_id AND n.lang = l.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY near DESC, lang) = 1)
SELECT d.doc_id, d.held_out, coalesce(b.lang, '{NONE}') AS lang_pred, coalesce(1 - CAST(b.worst - b.near AS DOUBLE) / CAST(b.worst AS DOUBLE), 0) AS score
FROM d LEFT JOIN best b USING (doc_id)
"""
