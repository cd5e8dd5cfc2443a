"""What filters remove together and alone, in every order: a histogram of failure masks, and all permutations from its cells.

Native expressions give each document a mask with a bit for each filter that it fails. Whether an earlier document has its
text takes one grouping by the text's digest, for the smallest doc_id; a document that is that one passes. The masks are
counted in 2 ** filters cells a part, with the good and the toxic documents in each. What a filter removes in an order, at
its step, is the sum of the cells that hold its bit and none of those before; so the corpus is read once, and all orders
cost a few sums over a part's cells.

Copies of a text are told by SHA-256, and combine before they are exchanged; texts don't move. A null text is empty and a
null source the part ''. A null doc_id is no smaller one, has none, and has no label. Rows equal in doc_id and text are
smaller than neither. Of several labels of a doc_id any counts. Other columns are ignored. An empty table has no parts, so
no rows.
"""

from __future__ import annotations

import itertools
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import common

#: The limits of the filters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
#: The filter that fails texts which a smaller doc_id has.
COPY = "E"
FILTERS = "ABCDE"


def failing(text: Column) -> dict[str, Column]:
    """The filters that look at a text alone: few words, few distinct ones, many capitals, symbols."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
        "C": 100 * capitals > MOST_CAPITALS * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def masks(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, mask, good, toxic), a row for each of documents. Bit i of mask: the i-th of FILTERS fails."""
    text = F.coalesce(documents["text"], F.lit(""))
    own = reduce(lambda a, b: a.bitwiseOR(b), [F.when(bad, 1 << FILTERS.index(f)).otherwise(0) for f, bad in failing(text).items()])
    told = documents.select("doc_id", F.coalesce(documents["source"], F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), own.alias("own"))
    # read twice: 60 bytes a document
    told = common.kept_table(told, "audit")
    firsts = told.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("digest", "doc_id", F.lit(True).alias("first"))
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    mask = F.col("own").bitwiseOR(F.when(copy, 1 << FILTERS.index(COPY)).otherwise(0))
    known = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marked = told.join(firsts, ["digest", "doc_id"], "left").select("doc_id", "part", mask.alias("mask")).join(known, "doc_id", "left")
    return marked.select("doc_id", "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def cells(masked: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part with each mask that occurs."""
    ones = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    return masked.groupBy("part", "mask").agg(F.count("*").alias("n"), ones("good"), ones("toxic"))


def audit(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """All orders of the filters, from the cells: a row for each part, order and step. Of the orders of a mask's bits each bit
    comes first in equally many, so a filter's Shapley sum is that of its cells' counts over their bits, times all orders."""
    bits = {f: 1 << i for i, f in enumerate(filters)}
    orders = ["".join(o) for o in itertools.permutations(filters)]
    steps = [{"filter_order": o, "step": n + 1, "bit": bits[f], "before": sum(bits[x] for x in o[:n])} for o in orders for n, f in enumerate(o)]
    every = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,bit:int,before:int>>")
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 2 ** filters at most
    rows = parts.select("part", "cells", F.inline(every))
    bit, before = F.col("bit"), F.col("before")

    def total(where, what=lambda c: c["n"]) -> Column:
        return F.aggregate(F.filter("cells", where), F.lit(0).cast("long"), lambda acc, c: acc + what(c))

    fails = lambda c: c["mask"].bitwiseAND(bit) != 0
    gone = lambda c: c["mask"].bitwiseAND(before) != 0
    removed = lambda c: fails(c) & ~gone(c)
    columns = {
        "kept": total(lambda c: c["mask"].bitwiseAND(bit.bitwiseOR(before)) == 0),
        "removed": total(removed),
        "redundant": total(lambda c: fails(c) & gone(c)),
        "unique_fails": total(lambda c: c["mask"] == bit),
        "good_lost": total(removed, lambda c: c["good"]),
        "toxic_lost": total(removed, lambda c: c["toxic"]),
        "shapley": total(fails, lambda c: c["n"] * F.floor(len(orders) / F.bit_count(c["mask"]))),
    }
    return rows.select("part", "filter_order", "step", *[c.alias(n) for n, c in columns.items()])


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(cells(masks(common.load(spark, sf_dir, "documents"), common.load(spark, sf_dir, "labels"))))


_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
OP11_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {_WORDS} AS words, doc_id > min(doc_id) OVER (PARTITION BY t) AS copied FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             MAP {{'A': len(words) < 50, 'B': 100 * len(list_distinct(words)) < 65 * len(words),
                  'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), 'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(copied, false)}} AS fails
      FROM w LEFT JOIN l USING (doc_id)),
h AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || e.x || g.x AS filter_order FROM letters a, letters b, letters c, letters e, letters g
           WHERE len(list_distinct([a.x, b.x, c.x, e.x, g.x])) = 5),
steps AS (SELECT filter_order, step, filter_order[step] AS own, string_split(filter_order[1:step - 1], '') AS before FROM orders, (SELECT unnest(range(1, 6)) AS step) s),
marked AS (SELECT h.*, filter_order, step, own, fails[own] AS failed, len(list_filter(before, lambda x: x <> '' AND fails[x])) > 0 AS gone,
                  len(list_filter(map_values(fails), lambda v: v)) AS n_fails
           FROM h, steps),
summed AS (SELECT part, filter_order, step, own,
       coalesce(sum(n) FILTER (NOT failed AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (failed AND NOT gone), 0) AS removed,
       coalesce(sum(n) FILTER (failed AND gone), 0) AS redundant, coalesce(sum(n) FILTER (failed AND n_fails = 1), 0) AS unique_fails,
       coalesce(sum(good) FILTER (failed AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (failed AND NOT gone), 0) AS toxic_lost
FROM marked GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM summed
"""
