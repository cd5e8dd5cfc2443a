"""SubRip files as cues and back: a whole-text scan with built-in functions, and a data source named "srt".

scan() reads many files, one row each, and parses them natively: a cue never spans an empty line, so files split into
blocks, a block into index, timing and text. A malformed cue fails its file: FAILFAST raises, PERMISSIVE gives one row with
_error and no cues. files are the unit of a task; a line of 64 KiB or more is an error.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from cuelake.functions import text, timing
from cuelake.sources import files as single
from cuelake.sources.files import publish  # noqa: F401

SCHEMA = "file_id string, pos long, idx long, from_ms long, to_ms long, text string, _error string"
MAX_LINE = 65_536


def parse(files: DataFrame) -> DataFrame:
    """SCHEMA from (file_id, content); a file with a malformed cue has one row with _error.

    A step's columns are made once and only then used: blocks, their lines, the two structural lines, the timing's numbers.
    """
    body = F.regexp_replace(F.col("content"), r"\r?\n\z|\r(?=\n)|\r\z", "")
    whole = files.select("file_id", body.alias("_body"))
    # most files are shorter than the limit as a whole, so their lines needn't be looked at
    long_line = F.when(F.octet_length("_body") < MAX_LINE, F.lit(False)).otherwise(F.exists(F.split("_body", "\n", -1), lambda x: F.octet_length(x) >= MAX_LINE))
    blocks = whole.select("file_id", long_line.alias("_long"), F.split("_body", "\n{2,}", -1).alias("_blocks")).select("file_id", "_long", (F.size("_blocks") - 1).alias("_last"), F.posexplode("_blocks").alias("_block", "_raw"))
    # leading lines that are blank as structural lines are skipped; the first other one is the index
    space = rf"{text.WS_INLINE}*+"
    blank = rf"^(?:\x{{FEFF}}?{space}\x{{FEFF}}?{space}\n)+"
    rows = blocks.select("file_id", "_long", "_last", "_block", F.split(F.regexp_replace("_raw", blank, ""), "\n", 3).alias("_lines"))
    heads = rows.select("file_id", "_long", "_last", "_block", "_lines", *[text.structural_line(F.get("_lines", F.lit(i))).alias(n) for i, n in ((0, "_index"), (1, "_time"))]).filter("_long OR _index <> ''")
    file = Window.partitionBy("file_id")
    timed = heads.select("file_id", "_long", "_block", "_lines", "_index", "_time", timing.time_parts(F.col("_time")).alias("_parts"), ((F.size("_lines") > 1) | (F.col("_block") < F.col("_last"))).alias("_more"))
    start, stop = timing.from_parts(F.col("_parts"))
    number = F.when(F.col("_index").rlike(r"^[+-]?[0-9]+\z"), F.col("_index").try_cast("bigint"))
    error = (
        F.when(F.col("_long"), "a line is too long")
        .when(F.col("idx").isNull(), F.concat(F.lit("invalid subtitle index: "), "_index"))
        .when((F.size("_lines") < 2) & ~F.col("_more"), "could not find subtitle timing")
        .when(F.size("_lines") < 2, "invalid subtitle timing")
        .when(F.size("_parts") < 8, F.concat(F.lit("invalid subtitle timing: "), "_time"))
        .when(F.col("from_ms").isNull() | F.col("to_ms").isNull(), "a subtitle time is out of range")
    )
    said = text.clean_text(F.coalesce(F.get("_lines", F.lit(2)), F.lit("")))
    cues = timed.select("file_id", "_block", "_long", "_lines", "_index", "_time", "_parts", "_more", number.alias("idx"), start.alias("from_ms"), stop.alias("to_ms"), said.alias("text")).withColumn("_error", error)
    cues = cues.select("file_id", "_block", "idx", "from_ms", "to_ms", "text", "_error")
    cues = cues.withColumn("_bad", F.min(F.when(F.col("_error").isNotNull(), F.col("_block"))).over(file)).filter("_bad IS NULL OR _block = _bad")
    keep = lambda c: F.when(F.col("_bad").isNull(), F.col(c)).alias(c)
    pos = F.row_number().over(file.orderBy("_block")).cast("long") - 1
    return cues.select("file_id", F.when(F.col("_bad").isNull(), pos).alias("pos"), keep("idx"), keep("from_ms"), keep("to_ms"), keep("text"), "_error")


def scan(spark: SparkSession, paths: str | list[str], mode: str = "FAILFAST") -> DataFrame:
    """The cues of all files under paths, in any store that Spark reads; "-" (standard input) isn't a path here. file_id is the
    file's URI, and a filter on it is answered by the listing, so other files aren't opened."""
    if "-" in ([paths] if isinstance(paths, str) else paths):
        raise ValueError("standard input can't be read; give files or folders")
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file_id"), F.col("value").alias("content"))
    cues = parse(files)
    if mode == "PERMISSIVE":
        return cues
    failed = F.raise_error(F.concat_ws(": ", "file_id", "_error")).cast("string")
    return cues.withColumn("text", F.when(F.col("_error").isNotNull(), failed).otherwise(F.col("text"))).drop("_error")


def render(cues: DataFrame) -> DataFrame:
    """(file_id, content): the cues of each file in the order of pos, numbered from 1, texts cleaned."""
    nth = F.row_number().over(Window.partitionBy("file_id").orderBy("pos"))
    block = F.concat(nth.cast("string"), F.lit("\n"), timing.format_timing(F.col("from_ms"), F.col("to_ms")), F.lit("\n"), text.clean_text(F.col("text")), F.lit("\n\n"))
    blocks = cues.select("file_id", nth.alias("_nth"), block.alias("_text"))
    return blocks.groupBy("file_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_nth", "_text"))), lambda x: x["_text"]), "").alias("content"))


def or_original(rendered: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, content, was_empty, changed): files that lost every cue keep their content."""
    new = rendered.select("file_id", F.col("content").alias("_new"))
    both = files.select("file_id", "content").join(new, "file_id", "left")
    empty = F.col("_new").isNull() | (F.col("_new") == "")
    return both.select("file_id", F.when(empty, F.col("content")).otherwise(F.col("_new")).alias("content"), empty.alias("was_empty"), (~empty & (F.col("_new") != F.col("content"))).alias("changed"))


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root = root
        self.only: set | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Conditions on file_id choose files; the others are left to Spark."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("file_id",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = asked if self.only is None else self.only & asked
            else:
                yield f

    def partitions(self) -> list[_File]:
        at = Path(self.root)
        found = (str(p) for p in (sorted(at.rglob("*.srt")) if at.is_dir() else [at]))
        return [_File(p) for p in found if self.only is None or p in self.only]

    def read(self, partition: _File | None) -> Iterator[tuple]:
        # where there are no files, Spark asks for one part all the same
        if partition is not None:
            yield from read_cues(partition.path, Path(partition.path).read_bytes().decode("utf-8"))


@dataclass
class _Parts(WriterCommitMessage):
    """(part, goal) of the files that a task has written."""

    names: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    """A file for each file_id, which must not be there yet. Rows of a file have to be in one partition. Tasks write parts
    of their own, so a task that runs again meets none of the first try's; the files get their names when all are done."""

    def __init__(self, root: str) -> None:
        self.root = root

    def write(self, rows: Iterator) -> WriterCommitMessage:
        files: dict[str, list] = {}
        for row in rows:
            files.setdefault(str(row["file_id"]), []).append(row)
        Path(self.root).mkdir(parents=True, exist_ok=True)
        done: list[tuple[str, str]] = []
        try:
            for name, cues in files.items():
                goal = Path(self.root, Path(name).name).with_suffix(".srt")
                blocks = [f"{n}\n{_clock(c['from_ms'])} --> {_clock(c['to_ms'])}\n{_clean(c['text'])}\n\n" for n, c in enumerate(sorted(cues, key=lambda c: c["pos"]), 1)]
                done.append((str(single.write_part(goal, "".join(blocks))), str(goal)))
        except BaseException:
            _remove(part for part, _ in done)
            raise
        return _Parts(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        names = [x for m in messages if m is not None for x in m.names]
        goals = [goal for _, goal in names]
        twice = {g for g in goals if goals.count(g) > 1} if len(set(goals)) < len(goals) else set()
        there = [g for g in goals if Path(g).exists()]
        if twice or there:
            _remove(part for part, _ in names)
            raise FileExistsError(f"already there, or written twice: {sorted({*twice, *there})[0]}")
        for part, goal in names:
            single.put_new(Path(part), Path(goal))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        _remove(part for m in messages if m is not None for part, _ in m.names)


def _remove(parts: Iterable[str]) -> None:
    for part in parts:
        Path(part).unlink(missing_ok=True)


class SrtDataSource(DataSource):
    """spark.read.format("srt").load(folder) and df.write.format("srt").save(folder), for folders that all executors see;
    scan() reads any store that Spark reads."""

    @classmethod
    def name(cls) -> str:
        return "srt"

    def schema(self) -> str:
        return SCHEMA.removesuffix(", _error string")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    """Spark hands filters to sources in Python only where the session says so."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SrtDataSource)


def _clock(ms: int) -> str:
    return f"{ms // 3_600_000:02d}:{ms // 60_000 % 60:02d}:{ms // 1000 % 60:02d},{ms % 1000:03d}"


def _clean(said: str) -> str:
    return "\n".join(x for x in (line.strip() for line in said.replace("\r\n", "\n").split("\n")) if x)


def read_cues(name: str, content: str) -> Iterator[tuple]:
    """(file_id, pos, idx, from_ms, to_ms, text) of one file, row by row; ValueError at the first malformed cue."""
    import re

    plain = lambda x: _clean(x.removeprefix("﻿")).removeprefix("﻿")
    lines = [x.removesuffix("\r") for x in content.split("\n")]
    if any(len(x.encode()) >= MAX_LINE for x in lines):
        raise ValueError(f"{name}: a line is too long")
    at, pos = 0, 0
    while True:
        while at < len(lines) and not plain(lines[at]):
            at += 1
        if at >= len(lines):
            return
        index = plain(lines[at])
        if not re.fullmatch(r"[+-]?[0-9]+", index):
            raise ValueError(f"{name}: invalid subtitle index: {index}")
        if at + 1 >= len(lines) or (at + 2 == len(lines) and not lines[at + 1]):
            raise ValueError(f"{name}: could not find subtitle timing")
        time = re.search(timing.TIMING, plain(lines[at + 1]))
        if not time:
            raise ValueError(f"{name}: invalid subtitle timing: {lines[at + 1]}")
        stop = at + 2
        while stop < len(lines) and lines[stop]:
            stop += 1
        h = [int(x) for x in time.groups()]
        ends = [((a * 60 + b) * 60 + c) * 1000 + d for a, b, c, d in (h[:4], h[4:])]
        yield name, pos, int(index), *ends, _clean("\n".join(lines[at + 2 : stop]))
        at, pos = stop + 1, pos + 1
