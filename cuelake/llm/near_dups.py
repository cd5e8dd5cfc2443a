"""Near-duplicate classes by BagMinHash: signatures of weighted shingle multisets, bands, and verified overlaps.

A text is the multiset of its five-word shingles (words in lower case, runs without ASCII white space). Integer weights are
discretised at 1, 2, 4, 8, ...: each dyadic interval of a shingle has a Poisson process whose rate is the interval's
length, whose points fall on a register and a place in the interval; points above the shingle's weight don't count. A
register's value is the time of its first point, so two signatures agree at a register with the multisets' weighted
Jaccard similarity as probability. A text's processes run until no open one can still lower a register.

Texts with equal multisets count as copies; the row with the smallest doc_id represents them under a number of its own. Representatives that share a band
(ROWS registers; BANDS of them: a pair at 0.8 meets but for 5 in a million) are compared in two steps. First each member of
a band with the most central one (whose bands hold the most members, then the smallest id) and with the smallest, so a band
gives pairs in proportion to its members; pairs whose overlap is THRESHOLD or more are links. Then the members of the bands
whose other members aren't in one connected part yet meet by an exact prefix filter (rest_pairs()), and what it can't prove
to be below THRESHOLD or in one part already is compared. So of all pairs that share a band, each is compared, in one
class, or provably below THRESHOLD. Classes are the connected parts, found by label propagation with pointer jumping over
checkpointed tables.

Null texts are empty; texts without words are copies of each other and in no band. A row is told by its doc_id and the hash
of its text: rows that share a doc_id but not their text are rows of their own, each with its text's class. Rows without
doc_id take part; their class_id is null where no row of the class has one. Every row gives one row, repeated rows too;
other columns are ignored by classes() and kept by one_of_each().
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelake.llm import common
from cuelake.llm.shingles import chunks, lowered, mix, multisets, overlap

ROWS, BANDS, THRESHOLD = 4, 24, 0.8
REGISTERS = ROWS * BANDS
#: Counters that order shingles by rarity; any order is right, a good one leaves fewer pairs to compare.
COUNTERS = 1 << 18
#: Pairs by the prefix filter are compared in rounds: one of so many, leaving out those that are in one part by then.
ROUNDS = (16, 1)
_U = np.uint64
_ALL = (1 << 64) - 1


def _intervals(text: np.ndarray, key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, seed, length, part of the interval below the weight) of each dyadic interval that a weight reaches."""
    rows = [(text, mix(key), np.ones(len(key)), np.ones(len(key)))]
    level, length = 1, 1
    at = np.flatnonzero(times > 1)
    while len(at):
        reach = np.minimum(times[at] - length, length) / length
        rows.append((text[at], mix(key[at] ^ _U(level * 0x9E3779B97F4A7C15 & _ALL)), np.full(len(at), float(length)), reach))
        level, length = level + 1, 2 * length
        at = at[times[at] > length]
    return tuple(np.concatenate(c) for c in zip(*rows, strict=True))


def signatures(n: int, text: np.ndarray, key: np.ndarray, times: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """(n, registers) first times; infinite for texts without shingles. Text numbers ascend from 0."""
    first = np.full(n * registers, np.inf)
    text, seed, length, reach = _intervals(text, key, times)
    clock = np.zeros(len(text))
    step = 0
    while len(text):
        step += 1
        draw = mix(seed + _U(2 * step * 0xD1342543DE82EF95 & _ALL))
        place = mix(draw ^ _U(0xA0761D6478BD642F))
        clock = clock - np.log(((draw >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / length
        register = (place % _U(registers)).astype(np.int64)
        counts = ((place >> _U(11)).astype(np.float64) * 2.0**-53 < reach)
        np.minimum.at(first, text[counts] * registers + register[counts], clock[counts])
        latest = first.reshape(n, registers).max(axis=1)
        going = clock < latest[text]
        if not going.all():
            text, seed, length, reach, clock = text[going], seed[going], length[going], reach[going], clock[going]
    return first.reshape(n, registers)


def sign(df: DataFrame) -> DataFrame:
    """(doc_id, text_key, k1, k2, bands array<bigint>), a row for each of df's; k1 and k2 identify the multiset, text_key is
    Spark's 64-bit hash of the text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, stop, data, offsets in chunks(batch.column(1)):
                n = stop - at
                text, key, times = multisets(data, offsets)
                firsts = signatures(n, text, key, times).view(np.uint64).reshape(n, BANDS, ROWS)
                band = np.zeros((n, BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
                for r in range(ROWS):
                    band = mix(band * _U(0x9E3779B97F4A7C15) + firsts[:, :, r])
                named = []
                for salt in (3, 5):
                    total = np.zeros(n, np.uint64)
                    np.add.at(total, text, mix(key ^ _U(salt)) * times.astype(np.uint64))
                    named.append(pa.array(total.view(np.int64)))
                some = np.bincount(text, minlength=n) > 0
                lists = [b if s else [] for b, s in zip(band.view(np.int64), some, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n).cast(pa.int64()), batch.column(2).slice(at, n), *named, pa.array(lists, schema.field(4).type)], schema=schema)

    return df.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, "doc_id long, text_key long, k1 long, k2 long, bands array<bigint>")


def representatives(signed: DataFrame) -> DataFrame:
    """(rep, k1, k2, doc_id, text_key, bands), kept: a number for each distinct multiset, and the row that stands for it, that
    with the smallest doc_id (none is larger than any)."""
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    reps = signed.groupBy("k1", "k2").agg(F.min(row).alias("row"), F.first("bands").alias("bands"))
    return common.compact(reps.select(F.monotonically_increasing_id().alias("rep"), "k1", "k2", "row.doc_id", "row.text_key", "bands"))


def banded(reps: DataFrame) -> DataFrame:
    """(band, rep, least, n) of the bands with two members or more, from (rep, bands)."""
    rows = reps.select("rep", F.explode("bands").alias("band"))
    sizes = rows.groupBy("band").agg(F.count("*").alias("n"), F.min("rep").alias("least")).filter("n > 1")
    return common.compact(rows.join(sizes, "band"))


def hubs(shared: DataFrame) -> DataFrame:
    """(band, centre): the most central member of each band."""
    weight = shared.groupBy("rep").agg(F.sum("n").alias("weight"))
    return common.compact(shared.join(weight, "rep").groupBy("band").agg((-F.max(F.struct("weight", -F.col("rep")))["col2"]).alias("centre")))


def star_pairs(shared: DataFrame, centre: DataFrame) -> DataFrame:
    """(a, b), a < b, distinct: each member of a band with its centre and its smallest."""
    pairs = shared.join(centre, "band").select("rep", F.explode(F.array("centre", "least")).alias("other")).filter("other <> rep")
    return pairs.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()


def unsettled(shared: DataFrame, centre: DataFrame, labels: DataFrame) -> DataFrame:
    """(rep, label) of the members, hubs aside, of bands where those are in two parts or more. Hubs were compared with all."""
    others = shared.filter("n > 2").join(centre, "band").filter("rep <> centre and rep <> least")
    named = others.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("band", "rep", F.coalesce("label", "rep").alias("label"))
    split = named.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    return named.join(split, "band").select("rep", "label").distinct()


def rest_pairs(texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b), a < b, distinct, from (rep, label, text): pairs of two labels that may reach the threshold; none that does is left out.

    A shingle's k-th copy is a token; every text has its tokens in one order, rare ones first. Texts of x <= y tokens whose
    similarity is t have t / (1 + t) * (x + y) tokens in common or more. So their first common token is among the first
    x - 2t / (1 + t) * x + 1 of the one and y - t * y + 1 of the other, and enough tokens follow it in both.
    """
    share = threshold / (1 + threshold)

    def bags(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple]:
        for batch in batches:
            for at, stop, data, offsets in chunks(batch.column(column)):
                yield batch.slice(at, stop - at), *multisets(data, offsets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for _, _, key, _ in bags(batches, 0):
            total += np.bincount((key % _U(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["counter", "n"])

    counted = texts.select("text").mapInArrow(count, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    counts = counted.toArrow()
    often = np.zeros(COUNTERS, np.int64)
    often[counts.column("counter").to_numpy()] = counts.column("n").to_numpy()
    schema = pa.schema([("token", pa.int64()), ("rep", pa.int64()), ("label", pa.int64()), ("n", pa.int64()), ("at", pa.int64())])

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text, key, times in bags(batches, 2):
            first = np.cumsum(times) - times
            copy = np.arange(int(times.sum())) - np.repeat(first, times)
            text, key = np.repeat(text, times), np.repeat(key, times)
            order = np.lexsort((copy, key, often[(key % _U(COUNTERS)).astype(np.int64)], text))
            text, token = text[order], mix(key[order] + copy[order].astype(np.uint64) * _U(0x9E3779B97F4A7C15))
            sizes = np.bincount(text, minlength=batch.num_rows)
            at, n = np.arange(len(text)) - (np.cumsum(sizes) - sizes)[text], sizes[text]
            keep = np.flatnonzero(at <= n - np.ceil(threshold * n - 1e-6))
            who = pa.array(text[keep])
            yield pa.RecordBatch.from_arrays([pa.array(token[keep].view(np.int64)), batch.column(0).take(who), batch.column(1).take(who), pa.array(n[keep]), pa.array(at[keep])], schema=schema)

    found = common.compact(texts.select("rep", "label", "text").mapInArrow(tokens, "token long, rep long, label long, n long, at long"))
    y = found.select(*(F.col(c).alias(f"{c}_y") for c in found.columns))
    x = found.filter(F.col("at") <= F.col("n") - F.ceil(2 * share * F.col("n") - 1e-6))
    enough = (F.col("n") - F.col("at") >= share * (F.col("n") + F.col("n_y")) - 1e-6) & (F.col("n_y") - F.col("at_y") >= share * (F.col("n") + F.col("n_y")) - 1e-6)
    smaller = (F.col("n") < F.col("n_y")) | ((F.col("n") == F.col("n_y")) & (F.col("rep") < F.col("rep_y")))
    met = x.join(y, (F.col("token") == F.col("token_y")) & smaller & (F.col("label") != F.col("label_y")) & (F.col("n") >= threshold * F.col("n_y") - 1e-6) & enough)
    return met.select(F.least("rep", "rep_y").alias("a"), F.greatest("rep", "rep_y").alias("b")).distinct()


def verified(pairs: DataFrame, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, similarity) of the pairs whose texts' exact overlap is at least the threshold. docs: (rep, text)."""
    kinds = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def bags(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        text, key, times = multisets(*lowered(texts))
        cut = np.searchsorted(text, np.arange(len(texts) + 1))
        return [(key[i:j], times[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, common.BATCH_ROWS):
                part = batch.slice(at, common.BATCH_ROWS)
                near = np.array([overlap(x, y) for x, y in zip(bags(part.column(2)), bags(part.column(3)), strict=True)])
                keep = np.flatnonzero(near >= threshold)
                if len(keep):
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep)), part.column(1).take(pa.array(keep)), pa.array(near[keep])], schema=kinds)

    left = pairs.join(docs.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(docs.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, similarity double")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of the links (a, b): label is the smallest node of its connected part."""
    edges = common.compact(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = common.compact(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        seen = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(seen, "node").select("node", "label", F.least("label", "near").alias("next"))
        # pointer jumping: a label's own label is in the same part and no larger
        jumped = lower.join(labels.select(F.col("node").alias("next"), F.col("label").alias("beyond")), "next", "left")
        new = common.compact(jumped.select("node", F.least("next", "beyond").alias("new"), "label"))
        labels = new.select("node", F.col("new").alias("label"))
        if new.filter("new <> label").isEmpty():
            return labels


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """pairs (a, b) of two parts, with their parts: (a, b, label_a, label_b)."""
    for side in ("a", "b"):
        named = labels.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}"))
        pairs = pairs.join(named, side, "left").withColumn(f"label_{side}", F.coalesce(f"label_{side}", side))
    return pairs.filter("label_a <> label_b").select("a", "b", "label_a", "label_b")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after more links (label_a, label_b) between parts: parts that are linked become one."""
    parts = components(links.select(F.least("label_a", "label_b").alias("a"), F.greatest("label_a", "label_b").alias("b")).distinct())
    named = labels.join(parts.select(F.col("node").alias("label"), F.col("label").alias("lower")), "label", "left").select("node", F.coalesce("lower", "label").alias("label"))
    return common.compact(named.unionByName(parts.join(labels, "node", "left_anti").select("node", "label")))


def texts_of(df: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """(rep, text), kept, of the representatives in the pairs."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    rows = reps.select("rep", F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).join(wanted, "rep")
    own = df.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    # repeated rows give their text once
    return common.durable(own.join(rows, own["doc_id"].eqNullSafe(rows["_id"]) & (own["text_key"] == rows["_key"])).groupBy("rep").agg(F.max("text").alias("text")))


def parts(df: DataFrame, reps: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(rep, label) of the representatives that have a near duplicate: label is the smallest number of the class."""
    shared = banded(reps)
    centre = hubs(shared)
    pairs = common.compact(star_pairs(shared, centre))
    texts = texts_of(df, reps, pairs)  # of all that are compared: a band's members are compared with its hubs
    labels = components(common.compact(verified(pairs, texts, threshold)).select("a", "b"))
    members = common.compact(unsettled(shared, centre, labels))
    if not members.isEmpty():
        rest = common.compact(rest_pairs(texts.join(members, "rep"), threshold).join(pairs, ["a", "b"], "left_anti").withColumn("turn", F.xxhash64("a", "b")))
        for n, one_of in enumerate(ROUNDS):
            turn = rest.filter(F.pmod("turn", F.lit(one_of)) == 0)
            for before in ROUNDS[:n]:
                turn = turn.filter(F.pmod("turn", F.lit(before)) != 0)
            more = common.compact(apart(turn.select("a", "b"), labels))
            new = common.compact(verified(more, texts, threshold).select("a", "b").join(more, ["a", "b"]))
            if not new.isEmpty():
                labels = merged(labels, new)
    return labels.select(F.col("node").alias("rep"), "label")


def labelled(df: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(df's signed rows; the representatives with their label, each class with its first row): both kept."""
    signed = common.durable(sign(df))
    reps = representatives(signed)
    named = reps.drop("bands").join(parts(df, reps, threshold), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    first = named.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first"))
    return signed, common.compact(named.join(first, "label").select("k1", "k2", "label", "first.doc_id", "first.text_key"))


def classes(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id), a row for each of df's: class_id is the smallest doc_id of the row's class."""
    signed, named = labelled(df, threshold)
    return signed.select("doc_id", "k1", "k2").join(named.select("k1", "k2", F.col("doc_id").alias("class_id")), ["k1", "k2"]).select("doc_id", "class_id")


def one_of_each(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, with df's columns: that with the smallest doc_id; rows without one stay only where the class has
    no other. Of rows with equal doc_id and text one stays, whatever their other columns hold."""
    _, named = labelled(df, threshold)
    none, key, text = common.free_names(df, "none", "key", "text_key")
    first = named.select(F.col("doc_id").isNull().alias(none), F.coalesce("doc_id", F.lit(0)).alias(key), F.col("text_key").alias(text)).distinct()
    rows = df.withColumns({none: df["doc_id"].isNull(), key: F.coalesce(df["doc_id"], F.lit(0)).cast("long"), text: F.xxhash64(df["text"])})
    return rows.join(first, [none, key, text], "left_semi").dropDuplicates([none, key, text]).select(*[rows[c] for c in df.columns])


def op9_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(common.load(spark, sf_dir, "documents"))
