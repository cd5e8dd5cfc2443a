"""The filter audit against its SQL, and against a plain walk through all orders on odd rows."""

import itertools
import os
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from cuelake.llm import filter_audit, queries

SF = "/root/testdata/sf0.001"
PROSE = " ".join(f"word{n}" for n in range(60))


def walk(rows, labels):
    """{(part, order, step): counts} by applying the filters one after the other to the rows that are left."""
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)

    def fails(d, text):
        words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
        capitals = sum("A" <= c <= "Z" for c in text)
        return {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * capitals > 5 * len(text), "D": bool(set(text) & set("#$%&*|")), "E": d is not None and least[text] < d}

    known = [(s or "", fails(d, t or ""), any(q == 1 for i, q, _ in labels if i == d and d is not None), any(x == 1 for i, _, x in labels if i == d and d is not None)) for d, t, s in rows]
    out, shapley = {}, Counter()
    for part in {k[0] for k in known}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [k for k in known if k[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                now = [k for k in left if k[1][f]]
                left = [k for k in left if not k[1][f]]
                alone = sum(k[1][f] and sum(k[1].values()) == 1 for k in known if k[0] == part)
                out[part, order, step] = [len(left), len(now), sum(k[1][f] for k in gone), alone, sum(k[2] for k in now), sum(k[3] for k in now)]
                gone += now
                shapley[part, f] += len(now)
    return {key: (*v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def told(df):
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = df.collect()
    assert len(rows) == len({(r["part"], r["filter_order"], r["step"]) for r in rows})
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in columns) for r in rows}


def test_op11_sql(spark):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    got = queries.QUERIES["op11_filter_audit"](spark, SF)
    columns = sorted(got.columns)
    want = db.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES['op11_filter_audit']}) q").fetchall()
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want)


def test_op11_odd_rows(spark):
    """Nulls in any column, empty and very long texts, repeated rows and doc_ids, copies across parts, columns that clash."""
    rows = [
        (1, PROSE, "a"), (2, PROSE, "a"), (3, PROSE, "b"), (3, PROSE, "b"), (1, PROSE, "b"), (1, PROSE, "a"), (None, PROSE, "a"), (None, PROSE + "#", None),
        (4, None, "a"), (5, "", None), (6, "", "a"), (None, None, None), (7, "A B C #", "c"), (8, "the " * 60, "c"), (9, PROSE.upper() + "|", "a"), (10, "é " * 200_000, "b"),
        (11, "x " * 60, "b"), (12, "x\x0b\x0c\r" * 60 + "&", "b"), (13, "X" * 20, "A"),
    ]
    labels = [(1, 1, 0), (1, 0, 1), (3, 1, None), (4, None, 1), (None, 1, 1), (7, 1, 1), (7, 1, 1), (99, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for extra in ("part", "digest", "own", "first", "mask", "good", "toxic", "n", "cells"):
        df = df.withColumn(extra, F.lit("7"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert told(filter_audit.audit(filter_audit.cells(filter_audit.masks(df.repartition(3), marks)))) == walk(rows, labels)
    assert filter_audit.masks(df, marks).count() == len(rows)


def test_op11_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.cells(filter_audit.masks(none, marks))).count() == 0
    one = spark.createDataFrame([(1, "a", None)], none.schema)
    assert told(filter_audit.audit(filter_audit.cells(filter_audit.masks(one, marks)))) == walk([(1, "a", None)], [])


def test_op11_plan(spark):
    """Neither texts nor rows of a hot text move: what is exchanged are digests and cells, counted in the tasks first."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    plan = filter_audit.cells(filter_audit.masks(docs, labels))._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan and "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
