"""What the corpus operators share: reading tables, the shared folder, and mapping rows in Arrow batches."""

from __future__ import annotations

import hashlib
import math
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

#: Rows of an output batch; bounds what a Python worker holds beside its input batch.
BATCH_ROWS = 512
#: What compact() puts into a file, by what a row's columns take: 8 bytes, or for strings and lists these.
FILE_BYTES = 2 << 20
WIDTHS = {"string": 24, "binary": 24, "array": 160}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or in local mode a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = tempfile.mkdtemp(prefix="corpus-")
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that later reads survive lost executors."""
    spark = df.sparkSession
    root = shared_root(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint(eager=True)


def compact(df: DataFrame) -> DataFrame:
    """durable() in as many files as df's rows need, computed in df's own partitions first: those of small tables may be many,
    and where Hadoop has no native library, each file that an executor writes costs processes that start as copies of its JVM.
    The rows stand on the executors' disks meanwhile, and are computed anew where one is lost."""
    held = df.persist(StorageLevel.DISK_ONLY)
    try:
        width = sum(WIDTHS.get(t.partition("<")[0], 8) for _, t in df.dtypes)
        return durable(held.coalesce(max(1, math.ceil(held.count() * width / FILE_BYTES))))
    finally:
        held.unpersist()


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until no column of df is called so, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def map_rows(df: DataFrame, columns: list[str], row: Callable, schema: str, fields: list[tuple[str, pa.DataType]]) -> DataFrame:
    """One output row for each input row: row(*values) gives the values of fields. Whole values, streamed in batches."""
    kinds = pa.schema([pa.field(n, t) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                rows = [row(*values) for values in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    return df.select(*[df[c] for c in columns]).mapInArrow(run, schema)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def tokenizer_path(name: str, given: str | None = None) -> str:
    """given, or name as the installed package of public vocabularies places it."""
    if given:
        return given
    import public_tokenizers

    return public_tokenizers.path(name)


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
