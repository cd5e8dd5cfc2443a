"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

Words are runs of letters and digits, in lower case. For each mask and position the hash covers only the words at the
mask's places, so a substituted word at an ignored place changes nothing. Hashes of all positions of all documents are
joined with those of the benchmark; round each hit the document's words are laid over the item's, without gaps, and the
equal ones are counted. A document overlaps an item if WINDOW words in a row have LEAST equal ones or more, or, for items
shorter than that, if SHARE of the item's words are equal. Any WINDOW words with two substitutions keep a hit of the first
mask, and short items with as many as SHARE allows one of SHORT_MASKS (the tests try them all); items of fewer than
LEAST_WORDS words match nothing.

A text's hits are places of items' first words, each kept once and without the text: a word that fills a document and an item
gives a place for each position, not for each pair. The places then meet the text's words once, in one row.

A benchmark of up to BROADCAST_WORDS words, counted beforehand, is broadcast whole, so that documents are read once for each
mask, and once more where hits are checked, and don't move unless those are many. A larger one meets the documents' seeds by an
exchange, in one pass too; a seed that very many positions share is on the streamed side there, which Spark splits. Documents
are told by id and a 64-bit hash of the text: repeated rows share a result row, null ids are kept. Null and empty texts
overlap nothing; null items are ignored, repeated ones count once; other columns are ignored by overlaps() and kept by clean().
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import common

#: Places of a seed that count; the rest of its span is ignored. Five words.
MASKS = ((0, 1, 3, 6, 7),)
#: (mask, longest item) of four words each, for items shorter than WINDOW: two of them reach all lengths but five.
SHORT_MASKS = (((0, 1, 2, 3), 12), ((0, 1, 3, 4), 12), ((0, 1, 2, 4), 5), ((0, 2, 3, 4), 5))
WINDOW, LEAST, SHARE = 13, 11, 0.8
#: Items of fewer words match nothing, as they are no passages; overlaps() takes another number, and those match verbatim.
LEAST_WORDS = 5
#: Words of a text whose positions one row is exploded to.
PIECE = 1024
#: Words of a benchmark that are broadcast at most, with a seed each: some 100 MB; also words and places of found items.
BROADCAST_WORDS = 1_000_000


def _split(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(df: DataFrame, words: str, mask: tuple[int, ...], at: str, starts: str) -> DataFrame:
    """df with a row for each position `at` (from 0) where the mask fits, the hash `seed` of the words that count there, and
    whether it `starts` a run: whether those of the position before differ, or there is none."""
    last = F.size(words) - F.lit(mask[-1] + 1)
    placed = df.filter(last >= 0).select("*", F.explode(F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).alias(at))
    word = lambda o: F.get(F.col(words), F.col(at) + F.lit(o))
    same = reduce(lambda a, b: a & b, [F.coalesce(word(o) == word(o - 1), F.lit(False)) for o in mask])
    return placed.withColumns({"seed": F.xxhash64(*[word(o) for o in mask]), starts: ~same})


def items(benchmark: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(item_id, item bigint, item_words array<bigint>, item_n): distinct items with least_words or more."""
    got = benchmark.filter(benchmark["text"].isNotNull()).select("item_id", _hashed(_split(benchmark["text"])).alias("item_words")).distinct()
    return got.select("item_id", F.xxhash64("item_id", "item_words").alias("item"), "item_words", F.size("item_words").alias("item_n")).filter(F.col("item_n") >= least_words)


def _misses(words: Column, item: Column, first: Column) -> Column:
    """The item's places whose word isn't the document's there, when the item's first word lies at first."""
    places = F.sequence(F.lit(0), F.size(item) - 1)
    return F.filter(places, lambda i: ~F.coalesce(F.get(words, first + i) == F.get(item, i), F.lit(False)))


def _enough(misses: Column, n: Column) -> Column:
    """Whether so many misses, and where they are, still make an overlap. A window with WINDOW - LEAST misses lies between a miss
    (or the item's start) and one some places on (or its end)."""
    ends = F.concat(F.array(F.lit(-1)), misses)
    wide = F.exists(F.sequence(F.lit(0), F.size(ends) - 1), lambda i: F.coalesce(F.get(misses, i + (WINDOW - LEAST)), n) - F.get(ends, i) > WINDOW)
    return F.when(n >= WINDOW, wide).otherwise(n - F.size(misses) >= F.ceil(n * SHARE))


def _hits(docs: DataFrame, known: DataFrame, mask: tuple[int, ...], small: bool) -> DataFrame:
    """(doc_id, text_key, item, first): where an item's first word lies in a document, for each seed that the two share. Of a
    run of equal seeds that meets another one, only pairs with a start are needed: any overlap of the two runs has one."""
    seeds = _seeds(known, "item_words", mask, "item_at", "item_starts").select("seed", "item_at", "item_starts", "item")
    # pieces of a text, so that what one row is exploded to is bounded; hashing them is a step of its own
    base = F.explode(F.sequence(F.lit(0), F.greatest(F.size("split") - 1, F.lit(0)), F.lit(PIECE))).alias("base")
    pieces = docs.filter(F.size("split") > mask[-1]).select("doc_id", "text_key", "split", base)
    pieces = pieces.select("doc_id", "text_key", "base", _hashed(F.slice("split", F.col("base") + 1, F.lit(PIECE + mask[-1]))).alias("words"))
    placed = _seeds(pieces, "words", mask, "doc_at", "doc_starts").select("seed", "doc_id", "text_key", (F.col("base") + F.col("doc_at")).alias("doc_at"), "doc_starts")
    met = placed.join(F.broadcast(seeds) if small else seeds.hint("merge"), (placed["seed"] == seeds["seed"]) & (F.col("doc_starts") | F.col("item_starts")))
    return met.select("doc_id", "text_key", "item", (F.col("doc_at") - F.col("item_at")).alias("first"))


def overlaps(documents: DataFrame, benchmark: DataFrame, broadcast_words: int = BROADCAST_WORDS, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, text_key, item_id, item_words, equal_words, first_word): the best place of each item in each document."""
    known = items(benchmark, least_words)
    total, shortest = known.agg(F.sum("item_n"), F.min("item_n")).first()
    small = (total or 0) <= broadcast_words
    texts = documents.filter(documents["text"].isNotNull()).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    docs = texts.select("doc_id", "text_key", _split(F.col("text")).alias("split"))
    short = [(mask, 5, longest) for mask, longest in SHORT_MASKS] + [(tuple(range(n)), n, n) for n in range(1, 5)]
    masks = [(MASKS[0], known), *[(mask, known.filter(F.col("item_n").between(low, high))) for mask, low, high in short if shortest is not None and shortest <= high]]
    hits = reduce(DataFrame.unionByName, [_hits(docs, some, mask, small) for mask, some in masks])
    # a document's places, each once, with the items' words: what is looked at of a text is all in one row, its words once
    places = hits.groupBy("doc_id", "text_key", "item").agg(F.collect_set("first").alias("firsts"))
    held = places.join(F.broadcast(known) if small else known.hint("merge"), "item").groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("item_id", "item_words", "firsts")).alias("found"))
    held = common.durable(held.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "found"))
    size = held.agg(F.sum(F.aggregate("found", F.lit(0).cast("long"), lambda n, f: n + F.size(f["firsts"]) + F.size(f["item_words"])))).first()[0] or 0
    both = texts.join(F.broadcast(held) if size <= broadcast_words else held.hint("merge"), texts["doc_id"].eqNullSafe(held["_id"]) & (texts["text_key"] == held["_key"]))
    worded = both.select("doc_id", "text_key", _hashed(_split(F.col("text"))).alias("words"), "found")

    def best(f: Column) -> Column:
        n = F.size(f["item_words"])
        tried = F.transform(f["firsts"], lambda first: F.struct(first.alias("first"), _misses(F.col("words"), f["item_words"], first).alias("misses")))
        sound = F.transform(F.filter(tried, lambda t: _enough(t["misses"], n)), lambda t: F.struct((n - F.size(t["misses"])).alias("equal_words"), (-t["first"]).alias("back")))
        return F.struct(f["item_id"].alias("item_id"), n.alias("item_words"), F.array_max(sound).alias("place"))

    found = worded.select("doc_id", "text_key", F.explode(F.transform("found", best)).alias("f")).filter("f.place IS NOT NULL")
    one = found.groupBy("doc_id", "text_key", "f.item_id").agg(F.max(F.struct("f.place.equal_words", "f.place.back", "f.item_words")).alias("best"))
    whole = lambda c: F.col(f"best.{c}").cast("long")
    return one.select("doc_id", "text_key", "item_id", whole("item_words").alias("item_words"), whole("equal_words").alias("equal_words"), (-whole("back")).alias("first_word"))


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents that overlap no item, with all their columns."""
    bad = overlaps(documents, benchmark).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    return documents.join(bad, documents["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(documents["text"]) == bad["_key"]), "left_anti")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(common.load(spark, sf_dir, "documents"), common.load(spark, sf_dir, "benchmark")).drop("text_key")
