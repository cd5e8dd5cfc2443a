"""Token ids in binary shards: one concatenated id array, with Elias-Fano coded document boundaries and document ids.

A shard is self-contained bytes: MAGIC, five little-endian 64-bit counts (documents, null ids, ids, bytes of the boundary
code, bytes of the id code), the two codes, then the ids as little-endian 16-bit integers (32-bit where the vocabulary
needs it, which the magic tells). A code keeps the low bits of its n non-decreasing values packed and the high bits in
unary; select over the unary part, sampled every 64 ones, returns a value without a table of 64-bit offsets.

Documents are range-partitioned by doc_id and sorted, nulls first, so shards follow each other in ascending order. A shard
holds SHARD_IDS ids at most, or one longer document. Shards are rows (part, shard, base, ids, content) of a table in the shared
folder, which executors can write on any store; export() writes them as files. Null and empty texts have the end id only;
repeated rows and equal doc_ids each have their place, in any order among equals; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import common
from cuelake.llm.words import TEXTS, WordTable, byte_words, held

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
SHARD_IDS = 1 << 20
MAGIC = {2: b"TOKEF2\0\0", 4: b"TOKEF4\0\0"}
_HEAD = struct.Struct("<8s5Q")
_STEP = 64


class EliasFano:
    """Non-decreasing non-negative values in n * (2 + log2(u / n)) bits and the samples."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray) -> None:
        self.n, self.bits, self.low, self.high = n, bits, low, high
        # how many ones stand before each byte of the unary part, kept for every 64th one
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        self.samples = np.searchsorted(ones, np.arange(0, max(n, 1), _STEP) + 1, side="left") - 1
        self.before = ones[self.samples]

    @classmethod
    def code(cls, values: np.ndarray) -> "EliasFano":
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        v = values.astype(np.uint64)
        low = np.packbits(((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        places = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        unary[places] = 1
        return cls(n, bits, low, np.packbits(unary, bitorder="little"))

    def to_bytes(self) -> bytes:
        return struct.pack("<QQQ", self.n, self.bits, len(self.low)) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> "EliasFano":
        n, bits, low = struct.unpack_from("<QQQ", raw)
        return cls(n, bits, np.frombuffer(raw, np.uint8, low, 24), np.frombuffer(raw, np.uint8, offset=24 + low))

    def select(self, i: int) -> int:
        """The i-th value, from one sample and at most a few bytes after it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, seen = int(self.samples[i // _STEP]), int(self.before[i // _STEP])
        while seen + int(self.high[at]).bit_count() <= i:
            seen += int(self.high[at]).bit_count()
            at += 1
        byte = int(self.high[at])
        for _ in range(i - seen):
            byte &= byte - 1
        high = at * 8 + (byte & -byte).bit_length() - 1 - i
        p = i * self.bits
        low = int.from_bytes(self.low[p >> 3 : (p + self.bits + 7) >> 3].tobytes(), "little") >> (p & 7)
        return high << self.bits | low & (1 << self.bits) - 1

    def values(self) -> np.ndarray:
        """All values at once, as sequential readers want them."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.bits)
        low = np.unpackbits(self.low, bitorder="little")[: self.n * self.bits].reshape(self.n, self.bits).astype(np.uint64)
        return high | (low << np.arange(self.bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


class IdTable(WordTable):
    """word -> its ids as little-endian bytes."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        top = max(self.tokenizer.get_vocab(with_added_tokens=True).values())
        self.kind = np.dtype("<u2" if top < 1 << 16 else "<u4")
        self.coded = [i.to_bytes(self.kind.itemsize, "little") for i in range(top + 1)]

    def entry(self, ids: list[int]) -> bytes:
        return self.coded[ids[0]] if len(ids) == 1 else b"".join([self.coded[i] for i in ids])

    def split(self, text: str) -> list[str]:
        return byte_words(text)

    def ids(self, text: str) -> bytes:
        return b"".join(self.encode(text))


def shard_bytes(keys: list[int | None], lengths: list[int], ids: bytes, width: int) -> bytes:
    """A shard. Keys ascend, nulls first; lengths are numbers of ids. Negative keys are kept by an offset."""
    known = np.array([k for k in keys if k is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    ends = EliasFano.code(np.cumsum(lengths, dtype=np.int64)).to_bytes()
    names = struct.pack("<q", least) + EliasFano.code((known - least).view(np.uint64)).to_bytes()
    return _HEAD.pack(MAGIC[width], len(keys), len(keys) - len(known), len(ids) // width, len(ends), len(names)) + ends + names + ids


def read_shard(raw: bytes) -> tuple[list[int | None], EliasFano, np.ndarray]:
    """(doc ids, ends of the documents, ids)"""
    magic, n, nulls, count, ends, names = _HEAD.unpack_from(raw)
    width = {m: w for w, m in MAGIC.items()}[magic]
    at = _HEAD.size
    code = EliasFano.from_bytes(raw[at : at + ends])
    least = struct.unpack_from("<q", raw, at + ends)[0]
    keys = EliasFano.from_bytes(raw[at + ends + 8 : at + ends + names]).values().view(np.int64) + least
    ids = np.frombuffer(raw, np.dtype(f"<u{width}"), count, at + ends + names)
    if code.n != n:
        raise ValueError("a shard's boundaries don't fit its header")
    return [None] * nulls + keys.tolist(), code, ids


def write_shards(df: DataFrame, vocabulary: str | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """df's texts as shards, kept in the shared folder: (part, shard, base, ids, content), base the ids of the part before."""
    path = common.tokenizer_path(VOCABULARY, vocabulary)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, keys, lengths, texts, count, shard, part, base = held(IdTable, path), [], [], [], 0, 0, 0, 0
        width = table.kind.itemsize
        end = np.array([END_ID], table.kind).tobytes()

        def full():
            rows = [[part], [shard], [base], [count], [shard_bytes(keys, lengths, b"".join(texts), width)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["part", "shard", "base", "ids", "content"])

        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                some = [c.to_pylist() for c in batch.slice(at, TEXTS).columns]
                for key, text, part in zip(*some, strict=True):
                    got = table.ids(text or "") + end
                    if keys and count + len(got) // width > shard_ids:
                        yield full()
                        keys, lengths, texts, count, shard, base = [], [], [], 0, shard + 1, base + count
                    keys.append(key)
                    lengths.append(len(got) // width)
                    texts.append(got)
                    count += lengths[-1]
        if keys:
            yield full()

    ordered = df.select("doc_id", "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    shards = ordered.withColumn("part", F.spark_partition_id()).mapInArrow(run, "part int, shard int, base long, ids long, content binary")
    return common.kept_table(shards, "token-shards")


def read_documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), read back from the shards."""
    # one row for each partition that wrote; its shards tell their own places in it
    totals = shards.groupBy("part").agg(F.sum("ids").alias("part_ids"))
    sizes = {r["part"]: r["part_ids"] for r in totals.collect()}
    bases, at = {}, 0
    for p in sorted(sizes):
        bases[p], at = at, at + sizes[p]
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base, raw in zip(*(batch.column(i) for i in range(3)), strict=True):
                keys, ends, ids = read_shard(raw.as_py())
                stops = np.array([ends.select(i) for i in range(ends.n)], np.int64)
                starts = np.concatenate([[0], stops[:-1]])
                wide = ids.astype("<u4")
                sums = [zlib.crc32(wide[a:b]) for a, b in zip(starts, stops, strict=True)]
                first = bases[part.as_py()] + base.as_py()
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts + first, pa.int64()), pa.array(stops - starts, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("part", "base", "content").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def export(shards: DataFrame, folder: str) -> list[str]:
    """The shards as files in a folder of this machine, one after another; their names in order."""
    from pathlib import Path

    Path(folder).mkdir(parents=True, exist_ok=True)
    names = []
    for row in shards.orderBy("part", "shard").toLocalIterator():
        names.append(str(Path(folder, f"{row['part']:06d}-{row['shard']:06d}.tokef")))
        Path(names[-1]).write_bytes(row["content"])
    return names


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(write_shards(common.load(spark, sf_dir, "documents")))
