"""Quality rules: how far a text's character classes and common words are from those of its language.

The base rules count words (runs without ASCII white space), symbols, repeated lines and words in repeated 3-word windows.
A language has a histogram of the common words that common_words() learns from the corpus: those that most of its documents
have. The references are the mean histograms of all documents of a language that pass the base rules, in millionths, summed
as integers so that they don't depend on the order of rows. A document is rejected if its Jensen-Shannon distance (base 2,
0 to 1) to the reference is above MAX_CLASSES + CLASSES_NOISE / sqrt(words) or MAX_WORDS + WORDS_NOISE / sqrt(words): short
texts stray further by chance, and from fewer than MIN_WORDS words neither words nor distances are taken. limit() sets these
numbers from the good documents of one labelled part, with the margins below; README has both error rates on others.
Languages of few documents share one reference ("und") and have no word distance.

Null and empty texts have no words, so the base rules reject them; a null lang counts as "und"; every row gives one row,
repeated rows and null ids too; other columns are ignored by measure() and kept by keep().
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelake.llm import common
from cuelake.llm.shingles import chunks, word_hashes

#: Languages have a reference of their own, and words, from so many documents on.
LEAST_DOCS = 20
#: Words of a language's histogram.
COMMON_WORDS = 100
OTHER = "und"
CLASSES = ("upper", "lower", "digit", "space", "stop", "symbol", "other_ascii", "high")
MIN_BASE_WORDS, MAX_REPEAT = 50, 50
#: Added to what limit() gives.
WORDS_MARGIN, CLASSES_MARGIN = 0.03, 0.03
#: Above these distances a document is rejected; MIN_WORDS and the noise terms guard the histograms of short texts. They are
#: limit()'s on the labelled good documents of sf0.1 with an even doc_id that pass the base rules.
MAX_CLASSES, CLASSES_NOISE, MAX_WORDS, WORDS_NOISE, MIN_WORDS = 0.098, 1.75, 0.203, 2.35, 50

_SPACES = [32, *range(9, 14)]
_SYMBOLS = list(b"#*$%&|<>")
_OF = np.full(256, CLASSES.index("other_ascii"))
_OF[ord("A") : ord("Z") + 1], _OF[ord("a") : ord("z") + 1], _OF[ord("0") : ord("9") + 1] = 0, 1, 2
_OF[_SPACES], _OF[list(b".,;:!?'\"()-")], _OF[_SYMBOLS] = 3, 4, 5
_OF[128:192] = -1  # bytes that go on a character
_OF[192:] = 7
_CLASS = np.zeros((256, len(CLASSES)), np.int64)
_CLASS[np.arange(256)[_OF >= 0], _OF[_OF >= 0]] = 1


@dataclass(frozen=True)
class Words:
    """The common words of each language that has a reference, as sorted hashes."""

    of: dict[str, np.ndarray]

    def language(self, lang: str | None) -> str:
        return lang if lang in self.of else OTHER

    def counts(self, texts: pa.Array, langs: list[str | None]) -> list[list[int]]:
        """How often each text has each common word of its language, the rest last; nothing for other languages."""
        out: list[list[int]] = []
        for at, stop, data, offsets in chunks(texts):
            text, word = word_hashes(data, offsets)
            cut = np.searchsorted(text, np.arange(stop - at + 1))
            for lang, i, j in zip(langs[at:stop], cut[:-1], cut[1:], strict=True):
                known = self.of.get(lang) if lang is not None else None
                if known is None:
                    out.append([])
                    continue
                place = np.minimum(np.searchsorted(known, word[i:j]), len(known) - 1)
                hit = known[place] == word[i:j]
                out.append([*np.bincount(place[hit], minlength=len(known)).tolist(), int(j - i - hit.sum())])
        return out


def common_words(df: DataFrame) -> Words:
    """Learnt from all of df's documents of MIN_WORDS words or more: in each language the COMMON_WORDS words that most documents
    have. Counted in each task first; what comes to the driver is COMMON_WORDS rows for each language of LEAST_DOCS documents."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, index = np.unique(np.array([x or "" for x in batch.column(1).to_pylist()], object).astype(str), return_inverse=True) if batch.num_rows else ([], [])
            for at, stop, data, offsets in chunks(batch.column(0)):
                text, word = word_hashes(data, offsets)
                n = np.bincount(text, minlength=stop - at)
                lang = index[at:stop][text]
                order = np.lexsort((word, text))
                text, word, lang = text[order], word[order], lang[order]
                new = np.r_[True, (word[1:] != word[:-1]) | (text[1:] != text[:-1])] if len(text) else np.zeros(0, bool)
                new &= n[text] >= MIN_WORDS
                word, lang = word[new].view(np.int64), lang[new]
                order = np.lexsort((word, lang))
                word, lang = word[order], lang[order]
                first = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (lang[1:] != lang[:-1])]) if len(word) else np.zeros(0, np.int64)
                counts = np.diff(np.append(first, len(word)))
                of = np.bincount(index[at:stop][n >= MIN_WORDS], minlength=len(langs))
                some = np.flatnonzero(of)
                # a language's documents themselves stand under no word
                rows = (np.concatenate([langs[lang[first]], langs[some]]), pa.concat_arrays([pa.array(word[first], pa.int64()), pa.nulls(len(some), pa.int64())]), np.concatenate([counts, of[some]]))
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), rows[1], pa.array(rows[2], pa.int64())], schema=schema)

    counted = df.select("text", "lang").mapInArrow(run, "lang string, word long, n long").filter("lang <> ''").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = common.compact(counted)
    langs = counted.filter("word is null").filter(F.col("n") >= LEAST_DOCS).select("lang")
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    # ranked before small languages go, so that tasks hand on no more than COMMON_WORDS rows a language
    top = counted.filter("word is not null").withColumn("place", F.row_number().over(best)).filter(F.col("place") <= COMMON_WORDS).join(langs, "lang", "left_semi")
    found: dict[str, list[int]] = {}
    for r in top.select("lang", "word").collect():
        found.setdefault(r["lang"], []).append(r["word"])
    return Words({lang: np.sort(np.array(words, np.int64).view(np.uint64)) for lang, words in found.items()})


def measure_text(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class counts)"""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        times, till = Counter(windows), 0
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + 3 - max(i, till)
                till = i + 3
    return len(words), len(text) - int(hist[_SPACES].sum()), int(hist[_SYMBOLS].sum()), len(lines) - len(set(lines)), repeated, (hist @ _CLASS).tolist()


def measure(df: DataFrame, words: Words) -> DataFrame:
    """(doc_id, text_key, ref, the counts, classes, listed, base_failed), a row for each of df's."""
    numbers = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("ref", pa.string()), *((n, pa.int64()) for n in numbers), ("classes", pa.list_(pa.int64())), ("listed", pa.list_(pa.int64())), ("base_failed", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, common.BATCH_ROWS):
                part = batch.slice(at, common.BATCH_ROWS)
                langs = part.column(2).to_pylist()
                rows = [measure_text(t) for t in part.column(1).to_pylist()]
                n, repeated = (np.array([r[i] for r in rows], np.int64) for i in (0, 4))
                failed = (n < MIN_BASE_WORDS) | (100 * repeated > MAX_REPEAT * n)
                columns = [part.column(0).cast(pa.int64()), part.column(3), [words.language(x) for x in langs], *zip(*rows, strict=True), words.counts(part.column(1), langs), failed]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    kinds = ", ".join(f"{n} long" for n in numbers)
    return df.select("doc_id", "text", "lang", F.xxhash64("text").alias("text_key")).mapInArrow(run, f"doc_id long, text_key long, ref string, {kinds}, classes array<long>, listed array<long>, base_failed boolean")


def _shares(rows: np.ndarray) -> np.ndarray:
    """Millionths of each row's total, as integers."""
    return rows * 1_000_000 // np.maximum(1, rows.sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows, filled up with zeros."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy()
    return out


def references(measured: DataFrame) -> dict[str, np.ndarray]:
    """The summed shares, classes first, of all documents of each reference that pass the base rules: a row for each
    language with words and one for the rest, added up in the tasks first. The sums are whole numbers, so the order of rows doesn't matter."""
    schema = pa.schema([("ref", pa.string()), ("place", pa.int64()), ("total", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            names, index = np.unique(batch.column(0).to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
            shares = np.hstack([_shares(_matrix(batch.column(1), len(CLASSES))), _shares(_matrix(batch.column(2), COMMON_WORDS + 1))])
            for i, name in enumerate(names.tolist()):
                sums[name] = sums.get(name, 0) + shares[index == i].sum(axis=0)
        for name, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(total)), pa.array(np.arange(len(total))), pa.array(total)], schema=schema)

    passed = measured.filter(~measured["base_failed"]).select("ref", "classes", "listed")
    out: dict[str, np.ndarray] = {}
    for r in passed.mapInArrow(run, "ref string, place long, total long").groupBy("ref", "place").agg(F.sum("total").alias("total")).collect():
        out.setdefault(r["ref"], np.zeros(len(CLASSES) + COMMON_WORDS + 1, np.int64))[r["place"]] = r["total"]
    return out


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of each row of counts a to the row b; 0 if either is empty."""
    some = (a.sum(axis=1) > 0) & (b.sum() > 0)
    p, q = a / np.maximum(1, a.sum(axis=1, keepdims=True)), b / max(1, b.sum())
    both = p + q
    term = lambda x: np.where(x > 0, x * np.log2(np.where(x > 0, 2 * x / np.where(both > 0, both, 1), 1)), 0).sum(axis=1)
    return np.where(some, np.sqrt(np.maximum(0, (term(p) + term(np.broadcast_to(q, p.shape))) / 2)), 0.0)


def limit(distances: np.ndarray, n_words: np.ndarray, margin: float) -> tuple[float, float]:
    """(level, noise): of the curves level + noise / sqrt(words) over all the distances the lowest on average, then the margin."""
    roots = np.sqrt(n_words)
    curves = [(float((distances - noise / roots).max()), noise) for noise in (np.arange(61) * 0.05).round(2).tolist()]
    level, noise = min(curves, key=lambda c: float((c[0] + c[1] / roots).mean()))
    return round(level + margin, 3), noise


def verdicts(measured: DataFrame) -> DataFrame:
    """measured with class_distance, word_distance and kept. measured is read twice: keep it first."""
    known = references(measured)
    n = len(CLASSES)
    schema = pa.schema([("class_distance", pa.float64()), ("word_distance", pa.float64()), ("kept", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, common.BATCH_ROWS):
                part = batch.slice(at, common.BATCH_ROWS)
                refs = part.column("ref").to_numpy(zero_copy_only=False).astype(str)
                classes, listed = _matrix(part.column("classes"), n), _matrix(part.column("listed"), COMMON_WORDS + 1)
                far = np.zeros((2, part.num_rows))
                for name in np.unique(refs).tolist():
                    if name in known:
                        rows = refs == name
                        far[0, rows], far[1, rows] = distance(classes[rows], known[name][:n]), distance(listed[rows], known[name][n:])
                words = part.column("n_words").to_numpy()
                root = np.sqrt(np.maximum(1, words))
                bad = (words >= MIN_WORDS) & ((far[0] > MAX_CLASSES + CLASSES_NOISE / root) | (far[1] > MAX_WORDS + WORDS_NOISE / root))
                kept = ~part.column("base_failed").to_numpy(zero_copy_only=False).astype(bool) & ~bad
                columns = [*part.columns, pa.array(far[0]), pa.array(far[1]), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, *schema.names])

    return measured.mapInArrow(run, f"{', '.join(f'{c} {t}' for c, t in measured.dtypes)}, class_distance double, word_distance double, kept boolean")


def assess(df: DataFrame) -> DataFrame:
    return verdicts(common.durable(measure(df, common_words(df))))


def keep(df: DataFrame) -> DataFrame:
    """The rows of df that are kept, with df's columns. Rows are told apart by id, text and reference, so equal rows share a verdict."""
    words = common_words(df)
    good = verdicts(common.durable(measure(df, words))).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("ref").alias("_ref")).distinct()
    ref = F.when(df["lang"].isin(list(words.of)), df["lang"]).otherwise(OTHER)
    return df.join(good, df["doc_id"].eqNullSafe(good["_id"]) & (F.xxhash64(df["text"]) == good["_key"]) & (ref == good["_ref"]), "left_semi")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(common.load(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"))
