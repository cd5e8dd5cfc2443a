"""A collection of files in any store that Spark writes: what changed is written, and seen all at once or not at all.

Under the root, `files/run=.../status=.../` holds a row for each file of a run, with its content where it was written, and
`commits` a row for each run that counts. Tasks write through Spark's committer, so one that runs again leaves nothing of
its first try; a run that fails has no commit, and readers never see it. No file is renamed or replaced: an older version
of a file stays as its backup. One publisher at a time; of two that take the same number each is told.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_FILES = "file_id string, digest string, content string, run string, status string"
_COMMITS = "number long, run string"


class Conflict(RuntimeError):
    pass


def _tables(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(_FILES).parquet(f"{root}/files"), spark.read.schema(_COMMITS).parquet(f"{root}/commits")


def _begun(spark: SparkSession, root: str) -> None:
    """Both tables are there afterwards, empty if they weren't."""
    spark.createDataFrame([], _FILES).write.mode("append").partitionBy("run", "status").parquet(f"{root}/files")
    spark.createDataFrame([], _COMMITS).write.mode("append").parquet(f"{root}/commits")


def versions(spark: SparkSession, root: str) -> DataFrame:
    """(file_id, digest, run, age): every version that was committed; the newest of a file has age 0. Contents aren't read."""
    files, commits = _tables(spark, root)
    rows = files.filter("status = 'written'").select("file_id", "digest", "run").join(commits, "run")
    age = F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("number"), F.desc("run"))) - 1
    return rows.select("file_id", "digest", "run", age.alias("age"))


def files(spark: SparkSession, root: str, age: int = 0) -> DataFrame:
    """(file_id, content) of the collection as it is; with an age, of the versions so many before, of files that have them."""
    held = versions(spark, root).filter(F.col("age") == age).select("file_id", "run")
    return _tables(spark, root)[0].filter("status = 'written'").join(held, ["file_id", "run"]).select("file_id", "content")


def told(new: DataFrame, held: DataFrame) -> DataFrame:
    """new (file_id, content) with digest and status, against held (file_id, digest): "kept" where the content is null or empty,
    so that a file that would lose all it has stays; "unchanged" where held has the same; else "written"."""
    rows = new.select(F.col("file_id").cast("string").alias("file_id"), "content", F.sha2("content", 256).alias("digest"))
    old = held.select("file_id", F.col("digest").alias("_old"))
    status = F.when(F.coalesce("content", F.lit("")) == "", "kept").when(F.col("_old") == F.col("digest"), "unchanged").otherwise("written")
    return rows.join(old, "file_id", "left").select("file_id", "digest", "content", status.alias("status"))


def publish(new: DataFrame, root: str, dry_run: bool = False) -> DataFrame:
    """(file_id, status) of new (file_id, content), after the files that changed are in the collection. Files that new doesn't
    name stay as they are. A dry run tells without writing into the collection. ValueError, and nothing is committed, if a
    file_id is null or comes twice. A run in which nothing changed has no commit."""
    spark = new.sparkSession
    _begun(spark, root)
    marked = told(new, versions(spark, root).filter("age = 0"))
    if dry_run:
        return marked.select("file_id", "status")
    run = f"r{uuid.uuid4().hex}"
    path = f"{root}/files/run={run}"
    # one pass over new: contents are kept of what is written, the others only tell
    marked.withColumn("content", F.when(F.col("status") == "written", F.col("content"))).write.partitionBy("status").parquet(path)
    out = spark.read.schema("file_id string, status string").parquet(path)
    wrong = out.groupBy("file_id").count().filter("count > 1 OR file_id IS NULL").take(1)
    if wrong:
        raise ValueError(f"no file_id, or one that comes twice: {wrong[0]['file_id']}")
    if not out.filter("status = 'written'").isEmpty():
        _commit(spark, root, run)
    return out.select("file_id", "status")


def _next(commits: DataFrame) -> int:
    return commits.agg(F.coalesce(F.max("number") + 1, F.lit(0))).first()[0]


def _commit(spark: SparkSession, root: str, run: str) -> None:
    """One row in one file: the store shows it or it doesn't."""
    number = _next(spark.read.schema(_COMMITS).parquet(f"{root}/commits"))
    spark.range(1).coalesce(1).select(F.lit(number).cast("long").alias("number"), F.lit(run).alias("run")).write.mode("append").parquet(f"{root}/commits")
    if spark.read.schema(_COMMITS).parquet(f"{root}/commits").filter(F.col("number") == number).count() > 1:
        raise Conflict(f"another run was committed as number {number} at the same time; both are in the collection")
