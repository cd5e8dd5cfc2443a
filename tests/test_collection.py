"""Files published into a collection: what is written, what readers see, and what failed runs leave."""

import pytest
from pyspark.sql import functions as F

from cuelake.sources import collection


def table(spark, rows):
    return spark.createDataFrame(rows, "file_id string, content string")


def told(df):
    return {r.file_id: r.status for r in df.collect()}


def held(spark, root, age=0):
    return {r.file_id: r.content for r in collection.files(spark, root, age).collect()}


def test_only_what_changed_is_written(spark, tmp_path):
    root = str(tmp_path / "c")
    assert told(collection.publish(table(spark, [("a", "1"), ("b", "2"), ("c", None)]), root)) == {"a": "written", "b": "written", "c": "kept"}
    assert told(collection.publish(table(spark, [("a", "1"), ("b", "3"), ("d", "")]), root)) == {"a": "unchanged", "b": "written", "d": "kept"}
    assert held(spark, root) == {"a": "1", "b": "3"}
    assert held(spark, root, 1) == {"b": "2"}
    # a file that would lose everything stays, also when it is there
    assert told(collection.publish(table(spark, [("a", ""), ("b", None)]), root)) == {"a": "kept", "b": "kept"}
    assert held(spark, root) == {"a": "1", "b": "3"}
    # contents of the second run: the changed file's alone
    runs = spark.read.parquet(f"{root}/files").filter("content IS NOT NULL").groupBy("run").count().collect()
    assert sorted(r["count"] for r in runs) == [1, 2]


def test_dry_runs_and_runs_without_changes_commit_nothing(spark, tmp_path):
    root = str(tmp_path / "c")
    assert told(collection.publish(table(spark, [("a", "1")]), root, dry_run=True)) == {"a": "written"}
    assert held(spark, root) == {}
    collection.publish(table(spark, [("a", "1")]), root)
    collection.publish(table(spark, [("a", "1")]), root)
    assert spark.read.parquet(f"{root}/commits").count() == 1
    assert told(collection.publish(table(spark, []), root)) == {}


def test_readers_never_see_a_failed_run(spark, tmp_path):
    """A job that fails midway, and one whose files are all written but not its commit."""
    root = str(tmp_path / "c")
    collection.publish(table(spark, [("a", "1")]), root)
    rows = spark.range(8).select(F.concat(F.lit("f"), "id").alias("file_id"), F.when(F.col("id") == 7, F.raise_error(F.lit("no"))).otherwise(F.lit("x")).cast("string").alias("content"))
    with pytest.raises(Exception, match="no"):
        collection.publish(rows, root)
    for twice in ([("a", "2"), ("b", "1"), ("b", "2")], [(None, "2"), ("a", "3")]):
        with pytest.raises(ValueError):
            collection.publish(table(spark, twice), root)
    assert held(spark, root) == {"a": "1"}
    assert told(collection.publish(table(spark, [("a", "1"), ("b", "1")]), root)) == {"a": "unchanged", "b": "written"}


def test_tasks_that_run_again_leave_nothing(spark, tmp_path):
    """Every task's first try fails after it has written rows; the files hold each row once."""
    import pandas as pd
    from pyspark import TaskContext

    tries = str(tmp_path / "tries")

    def flaky(frames):
        import os

        me = TaskContext.get()
        os.makedirs(tries, exist_ok=True)
        mark = os.path.join(tries, str(me.partitionId()))
        yield from frames
        if not os.path.exists(mark):
            open(mark, "x").close()
            raise RuntimeError("lost")
        yield pd.DataFrame({"file_id": pd.Series([], dtype=str), "content": pd.Series([], dtype=str)})

    # local mode doesn't try again, so the job fails whole and is started again, as a driver's retry does
    root = str(tmp_path / "c")
    rows = spark.range(0, 40, 1, 2).select(F.col("id").cast("string").alias("file_id"), F.lit("x").alias("content")).mapInPandas(flaky, "file_id string, content string")
    for _ in range(3):
        try:
            out = collection.publish(rows, root)
            break
        except Exception as e:
            assert "lost" in str(e)
    assert set(told(out).values()) == {"written"}
    assert held(spark, root) == {str(i): "x" for i in range(40)}
    assert collection.versions(spark, root).count() == 40


def test_two_publishers_at_once_are_told(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "c")
    collection.publish(table(spark, [("a", "1")]), root)
    real = collection.told

    def late(new, have):
        # another run commits between this run's look at the collection and its commit
        monkeypatch.setattr(collection, "told", real)
        collection.publish(table(spark, [("b", "2")]), root)
        return real(new, have)

    monkeypatch.setattr(collection, "told", late)
    collection.publish(table(spark, [("a", "2")]), root)
    assert held(spark, root) == {"a": "2", "b": "2"}
    monkeypatch.setattr(collection, "_next", lambda commits: 2)
    with pytest.raises(collection.Conflict):
        collection.publish(table(spark, [("c", "3")]), root)


def test_extra_columns_and_listing_without_contents(spark, tmp_path):
    root = str(tmp_path / "c")
    new = table(spark, [("a", "1")]).withColumn("status", F.lit("x")).withColumn("digest", F.lit("y"))
    assert told(collection.publish(new, root)) == {"a": "written"}
    plan = collection.versions(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
