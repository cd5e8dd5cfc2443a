"""Batches of cues for translation: greedy by encoded size, their payloads, checks of what comes back, and joining it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions.wire import encode_item, item_size
from cuelake.operators.kept import durable

#: Batches whose bytes a stretch of a file holds: one row holds its cues, whatever the file's length.
STRETCH = 256
_POWERS = tuple(1 << k for k in range(31))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _powers(below: Column, down: bool = False) -> Column:
    return F.filter(F.expr(f"array({', '.join(map(str, _POWERS[::-1] if down else _POWERS))})"), lambda p: p < below)


def _at_most(ends: Column, bound: Column) -> Column:
    """How many of the rising ends are bound or less, by halving."""
    steps = _powers(F.size(ends) + 1, down=True)
    return F.aggregate(steps, F.lit(0), lambda n, p: F.when(F.coalesce(F.get(ends, n + p - 1) <= bound, F.lit(False)), n + p).otherwise(n))


def _jumps(rows: Column, ends: Column, most: int) -> Column:
    """For each cue the place of the one that begins the next batch, if it begins one itself; null if that is beyond the stretch."""

    def jump(row: Column, i: Column) -> Column:
        return _with(F.greatest(_at_most(ends, row["starts"] + F.lit(most)), i + 1), lambda k: F.when(k < F.size(ends), k))

    return F.transform(rows, jump)


def _heads(jumps: Column, entry: Column) -> Column:
    """The places of a stretch that begin a batch, given the first: known ones jump, and jumps double."""
    state = F.struct(F.filter(F.array(entry), lambda h: h < F.size(jumps)).alias("heads"), jumps.alias("jumps"))

    def double(acc: Column, step: Column) -> Column:
        more = F.filter(F.transform(acc["heads"], lambda h: F.get(acc["jumps"], h)), lambda h: h.isNotNull())
        return F.struct(F.concat(acc["heads"], more).alias("heads"), F.transform(acc["jumps"], lambda j: F.get(acc["jumps"], j)).alias("jumps"))

    return F.array_sort(F.aggregate(_powers(F.size(jumps)), state, double, lambda acc: acc["heads"]))


def _lasts(jumps: Column) -> Column:
    """For each place the last one that begins a batch if it begins one, and how many do: array<struct<last, n>>."""
    start = F.transform(jumps, lambda j, i: F.struct(F.coalesce(j, i).alias("last"), F.when(j.isNull(), 0).otherwise(1).alias("n")))

    def double(acc: Column, step: Column) -> Column:
        return F.transform(acc, lambda x: _with(F.get(acc, x["last"]), lambda y: F.struct(y["last"].alias("last"), (x["n"] + y["n"]).alias("n"))))

    return F.transform(F.aggregate(_powers(F.size(jumps) + 1), start, double), lambda x: F.struct(x["last"].alias("last"), (x["n"] + 1).alias("n")))


def _entries(stretches: DataFrame, most: int) -> DataFrame:
    """(file_id, stretch, entry, before): of files of several stretches, where the first batch of each begins and how many are
    before it. The ways from each place that may be one to the next stretch's are doubled until all are reached."""
    near = F.filter("rows", lambda r: r["starts"] <= F.get("rows", F.lit(0))["starts"] + F.lit(most))
    by = Window.partitionBy("file_id").orderBy("stretch")
    slim = stretches.select("file_id", "stretch", F.transform("rows", lambda r: F.struct(r["starts"].alias("starts"), r["size"].alias("size"))).alias("rows"))
    told = slim.withColumns({"next": F.lead("stretch").over(by), "ahead": F.lead(near).over(by), "near": F.size(near)}).filter("next IS NOT NULL")
    ends = F.transform("rows", lambda r: r["starts"] + r["size"])
    lasts = _with(ends, lambda e: _lasts(_jumps(F.col("rows"), e, most)))
    told = told.select("file_id", "stretch", "next", "rows", F.transform("ahead", lambda r: r["starts"] + r["size"]).alias("ends"), F.posexplode(F.slice(lasts, F.lit(1), F.col("near"))).alias("entry", "way"))
    leaves = F.get("rows", F.col("way.last"))["starts"] + F.lit(most)
    ways = durable(told.select("file_id", "stretch", "entry", "next", _at_most(F.col("ends"), leaves).alias("onto"), F.col("way.n").cast("long").alias("n")))
    first = Window.partitionBy("file_id")
    known = ways.withColumn("_first", F.min("stretch").over(first)).filter("stretch = _first AND entry = 0").select("file_id", "stretch", F.lit(0).alias("entry"), F.lit(0).cast("long").alias("before"))
    found = durable(known)
    while True:
        more = durable(found.join(ways, ["file_id", "stretch", "entry"]).select("file_id", F.col("next").alias("stretch"), F.col("onto").alias("entry"), (F.col("before") + F.col("n")).alias("before")))
        if more.isEmpty():
            return found
        found = durable(found.union(more))
        on = ways.select("file_id", F.col("stretch").alias("next"), F.col("entry").alias("onto"), F.col("next").alias("_next"), F.col("onto").alias("_onto"), F.col("n").alias("_n"))
        ways = durable(ways.join(on, ["file_id", "next", "onto"]).select("file_id", "stretch", "entry", F.col("_next").alias("next"), F.col("_onto").alias("onto"), (F.col("n") + F.col("_n")).alias("n")))


def build_batches(cues: DataFrame, max_batch_chars: int = 7000, stretch: int = STRETCH) -> DataFrame:
    """(file_id, idx, text, batch_id): as many cues as fit, one at least. Running sums of sizes tell where each cue's batch would
    end if it began one; doubling these jumps from a file's first cue marks those that do. A row holds a stretch of a file, of
    `stretch` batches' bytes; from stretch to stretch the same is done by joins, for files that have several."""
    by = Window.partitionBy("file_id").orderBy("pos")
    sized = cues.select(F.col("file_id").cast("string").alias("file_id"), "pos", F.col("idx").cast("long").alias("idx"), "text", item_size(F.col("idx"), F.col("text")).cast("long").alias("size"))
    placed = sized.withColumn("starts", F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    width = stretch * max_batch_chars
    # an item takes six bytes for one of its text at most, and less than 64 besides
    most = cues.groupBy("file_id").agg(F.sum(F.octet_length("text") * 6 + 64).alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= width:
        placed = placed.withColumn("stretch", F.lit(0).cast("long"))
    else:
        placed = durable(placed.withColumn("stretch", F.floor(F.col("starts") / F.lit(width)).cast("long")))
    stretches = placed.groupBy("file_id", "stretch").agg(F.sort_array(F.collect_list(F.struct("starts", "size", "idx", "text"))).alias("rows"))
    if most <= width:
        entered = stretches.withColumns({"entry": F.lit(0), "before": F.lit(0).cast("long")})
    else:
        found = _entries(stretches, max_batch_chars)
        entered = stretches.join(found, ["file_id", "stretch"], "left").withColumns({"entry": F.coalesce("entry", F.lit(0)), "before": F.coalesce("before", F.lit(0).cast("long"))})
    ends = F.transform("rows", lambda r: r["starts"] + r["size"])
    heads = _with(ends, lambda e: _with(_jumps(F.col("rows"), e, max_batch_chars), lambda j: _heads(j, F.col("entry"))))

    def dealt(h: Column) -> Column:
        """Batches aligned with rows: those before the first head go on the batch before."""
        n = F.size("rows")
        own = F.transform(h, lambda at, k: F.array_repeat(F.col("before") + k, F.coalesce(F.get(h, k + 1), n) - at))
        return F.flatten(F.concat(F.array(F.array_repeat(F.col("before") - 1, F.coalesce(F.get(h, F.lit(0)), n))), own))

    rows = entered.select("file_id", F.explode(F.arrays_zip("rows", _with(heads, dealt).alias("batch"))).alias("row"))
    return rows.select("file_id", "row.rows.idx", "row.rows.text", F.col("row.batch").alias("batch_id"))


def payloads(batched: DataFrame) -> DataFrame:
    """(file_id, batch_id, payload): NDJSON in the order of idx; an idx below 1 is an error."""
    checked = F.when(F.col("idx") > 0, encode_item(F.col("idx"), F.col("text"))).otherwise(F.raise_error(F.lit("idx must be positive")).cast("string"))
    lines = batched.select("file_id", "batch_id", "idx", checked.alias("line")).groupBy("file_id", "batch_id").agg(F.sort_array(F.collect_list(F.struct("idx", "line"))).alias("rows"))
    return lines.select("file_id", "batch_id", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("payload"))


def batch_stats(batched: DataFrame) -> DataFrame:
    """(file_id, batches, cues)"""
    return batched.groupBy("file_id").agg(F.countDistinct("batch_id").alias("batches"), F.count("*").alias("cues"))


def validate_batch(expected: DataFrame, parsed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, idx, problem) of items that are missing, unexpected or repeated; none for a sound reply."""
    key = [*keys, "idx"]
    want = expected.select(*key).distinct().withColumn("_want", F.lit(True))
    got = parsed.groupBy(*key).agg(F.count("*").alias("_n"))
    both = want.join(got, key, "full_outer")
    problem = F.when(F.col("_n").isNull(), "missing").when(F.col("_want").isNull(), "unexpected").when(F.col("_n") > 1, "repeated")
    return both.select(*key, problem.alias("problem")).filter("problem IS NOT NULL")


def apply_translations(cues: DataFrame, translated: DataFrame) -> DataFrame:
    """cues with their text replaced where (file_id, idx) has a translation."""
    new = translated.select("file_id", "idx", F.col("text").alias("_new"))
    return cues.join(new, ["file_id", "idx"], "left").withColumn("text", F.coalesce("_new", "text")).drop("_new")
