"""Overlap merge: a cue that begins before the one before it ends is joined to it.

The merge is a fold over a file's cues, whose state is the open cue. Files are cut into pieces all the same: cues are dealt by
ranges of (file_id, pos), so a piece is a partition, and a file may go over many of them. Each piece is folded as if its first
cue began an island, and tells what it ends with and its first cues, up to one that begins an island in any case (it
begins after the cue before ends, and isn't short). From a file's pieces in order follows what is open where each begins:
the true fold goes through a piece's first cues until it begins an island where the assumed one does; from there both are
one. Then every piece is folded once more, from what is open there. What moves between pieces is one open cue; no task holds
a file. Where the first cues that are told don't suffice, more are told.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.functions import layout
from cuelake.operators import filters
from cuelake.operators.kept import durable
from cuelake.options import FixOptions

SHORT_MS = 150
#: First cues that a piece tells at most, at first.
LEAD = 64
#: Rows that a task hands on at once.
ROWS = 4096
_OUT = "file_id string, pos long, nth long, from_ms long, to_ms long, text string"
_TOLD = "file_id string, piece int, cut boolean, lead array<struct<from_ms:long,to_ms:long,text:string,opens:boolean,late:boolean>>, more boolean, opened long, late boolean, from_ms long, to_ms long, text string"


@dataclass(frozen=True)
class Open:
    """A cue that may still grow; islands before it in its file, and those of them with text."""

    from_ms: int
    to_ms: int
    text: str
    before: int = 0
    told: int = 0

    def opens(self, start: int, stop: int, said: str) -> tuple[bool, bool]:
        """Whether the next cue begins an island, and whether it does as it ends before this one begins."""
        if stop < self.from_ms:
            return True, True
        return start >= self.to_ms and not (stop - start < SHORT_MS and said in self.text), False

    def with_cue(self, start: int, stop: int, said: str) -> Open:
        return replace(self, to_ms=stop, text=f"{self.text}\n{said}" if start < self.to_ms else self.text)

    def then(self, start: int, stop: int, said: str) -> Open:
        return Open(start, stop, said, self.before + 1, self.told + self.has_text)

    @property
    def has_text(self) -> bool:
        return bool(self.text.strip("\n"))


def fold(cues: Iterable[tuple[int, int, str]]) -> tuple[list[list], bool]:
    """[from, to, text] of the merged cues in order, and whether a cue ended before the one it follows began."""
    out: list[list] = []
    late, now = False, None
    for cue in cues:
        begins, behind = now.opens(*cue) if now else (True, False)
        late |= behind
        if now and begins:
            out.append([now.from_ms, now.to_ms, now.text])
        now = (now.then(*cue) if now else Open(*cue)) if begins else now.with_cue(*cue)
    return out + ([[now.from_ms, now.to_ms, now.text]] if now else []), late


def _rows(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[int, str, tuple[int, int, str]]]:
    for part in parts:
        for piece, file_id, start, stop, said in zip(*(part[c].tolist() for c in ("piece", "file_id", "from_ms", "to_ms", "text")), strict=True):
            yield piece, file_id, (start, stop, said)


def _summaries(pieces: DataFrame, most: int) -> DataFrame:
    """_TOLD: of the files at a piece's ends, cut or not, and of others that are out of order. opened counts islands after the lead's."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file_id, now, first = None, None, True
        rows: list[tuple] = []

        def tell(cut: bool) -> None:
            # of a file that isn't cut only that it is out of order matters
            rows.append((file_id, piece, cut, lead if cut else [], more, opened, late, now.from_ms, now.to_ms, now.text if cut else ""))

        def told() -> pd.DataFrame:
            return pd.DataFrame(rows, columns=["file_id", "piece", "cut", "lead", "more", "opened", "late", "from_ms", "to_ms", "text"])

        for piece, name, cue in _rows(parts):
            if name != file_id:
                if now is not None:
                    if first or late or any(x["late"] for x in lead):
                        tell(first)
                    if len(rows) >= ROWS:
                        yield told()
                        rows.clear()
                    first = False
                file_id, now = name, None
                lead, more, opened, late, closed = [], False, 0, False, False
            if now is None:
                begins, behind, sure = True, False, False
            else:
                begins, behind = now.opens(*cue)
                sure = cue[0] >= now.to_ms and cue[1] - cue[0] >= SHORT_MS
            if not closed and len(lead) < most:
                lead.append({"from_ms": cue[0], "to_ms": cue[1], "text": cue[2], "opens": begins, "late": behind})
                closed = sure
            else:
                more = True
                opened += begins
                late |= behind
            now = (now.then(*cue) if now else Open(*cue)) if begins else now.with_cue(*cue)
        if now is not None:
            tell(True)
            yield told()

    return pieces.mapInPandas(run, _TOLD)


def _joined(told: list) -> tuple[list[tuple[int, Open | None, bool]], bool | None]:
    """Of a file's summaries in order: (piece, what is open where it begins, whether the file goes on after it), and whether the
    file is out of order; None if a lead was too short to tell."""
    out: list[tuple[int, Open | None, bool]] = []
    now: Open | None = None
    late = False
    for k, t in enumerate(told):
        out.append((t["piece"], now, k + 1 < len(told)))
        met = -1  # the place in the lead from which the assumed fold is the true one
        for i, cue in enumerate(t["lead"]):
            said = (cue["from_ms"], cue["to_ms"], cue["text"])
            begins, behind = now.opens(*said) if now else (True, False)
            late |= behind
            now = (now.then(*said) if now else Open(*said)) if begins else now.with_cue(*said)
            if begins and cue["opens"]:
                met = i
                break
        if met < 0:
            if t["more"]:
                return [], None
            continue
        rest = t["lead"][met + 1 :]
        late |= t["late"] or any(c["late"] for c in rest)
        opened = sum(c["opens"] for c in rest) + t["opened"]
        # an island without text is a file's first, if any
        now = Open(t["from_ms"], t["to_ms"], t["text"], now.before + opened, now.told + (opened and opened - 1 + _has_text(now, rest)))
    return out, late


def _has_text(now: Open, rest: list) -> bool:
    """Whether the island that now is of has text when it ends."""
    for cue in rest:
        if cue["opens"]:
            break
        now = now.with_cue(cue["from_ms"], cue["to_ms"], cue["text"])
    return now.has_text


def _replayed(pieces: DataFrame, at: dict[int, tuple[str, Open | None]], goes_on: dict[int, str]) -> DataFrame:
    """_OUT: the islands of each piece, the first file's from what is open there; the last one's open cue is left to the next
    piece if the file goes on there."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        file_id, now, piece = None, None, None

        def close() -> None:
            rows.append((file_id, now.before + 1, now.told + 1, now.from_ms, now.to_ms, now.text))

        for part in parts:
            for piece, name, cue in _rows(iter([part])):
                if name != file_id:
                    if now is not None:
                        close()
                    held = at.get(piece)
                    now = held[1] if file_id is None and held and held[0] == name else None
                    file_id = name
                if now is None:
                    now = Open(*cue)
                elif now.opens(*cue)[0]:
                    close()
                    now = now.then(*cue)
                else:
                    now = now.with_cue(*cue)
            yield pd.DataFrame(rows, columns=["file_id", "pos", "nth", "from_ms", "to_ms", "text"])
            rows.clear()
        if now is not None and goes_on.get(piece) != file_id:
            close()
            yield pd.DataFrame(rows, columns=["file_id", "pos", "nth", "from_ms", "to_ms", "text"])

    return pieces.mapInPandas(run, _OUT)


def merged(rows: DataFrame, lead: int = LEAD, pieces: int | None = None) -> DataFrame:
    """(file_id, pos, nth, from_ms, to_ms, text, out_of_order) from what filters.survivors() gives: pos counts a file's islands,
    nth those with text. pieces: how many, else as many as the rows need."""
    cues = rows.select(F.col("file_id").cast("string").alias("file_id"), "pos", "from_ms", "to_ms", F.coalesce("text", F.lit("")).alias("text"))
    dealt = cues.repartitionByRange(pieces, "file_id", "pos") if pieces else cues.repartitionByRange("file_id", "pos")
    held = durable(dealt.sortWithinPartitions("file_id", "pos")).select(F.spark_partition_id().alias("piece"), "file_id", "from_ms", "to_ms", "text")
    while True:
        told = durable(_summaries(held, lead))

        def join(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            found, late = _joined(part.sort_values("piece").to_dict("records"))
            rows = [(key[0], late, p, o.from_ms if o else None, o.to_ms if o else None, o.text if o else None, o.before if o else None, o.told if o else None, on) for p, o, on in found]
            names = ["file_id", "late", "piece", "from_ms", "to_ms", "text", "before", "told", "goes_on"]
            whole = dict.fromkeys(["piece", "from_ms", "to_ms", "before", "told"], "Int64") | {"late": "boolean", "goes_on": "boolean"}
            return pd.DataFrame(rows or [(key[0], *[None] * 8)], columns=names).astype(whole)

        # a row for each piece that a file has an end in: two a partition
        schema = "file_id string, late boolean, piece int, from_ms long, to_ms long, text string, before long, told long, goes_on boolean"
        ends = durable(told.filter("cut").groupBy("file_id").applyInPandas(join, schema))
        if ends.filter("late IS NULL").isEmpty():
            break
        lead *= 16
    at: dict[int, tuple[str, Open | None]] = {}
    goes_on: dict[int, str] = {}
    # a row for each piece at most, with the cue that is open there
    for r in ends.filter("goes_on OR from_ms IS NOT NULL").collect():
        if r["from_ms"] is not None:
            at[r["piece"]] = r["file_id"], Open(r["from_ms"], r["to_ms"], r["text"], r["before"], r["told"])
        if r["goes_on"]:
            goes_on[r["piece"]] = r["file_id"]
    late = ends.filter("late").select("file_id").union(told.filter("NOT cut").select("file_id")).distinct()
    return _replayed(held, at, goes_on).join(late.withColumn("_late", F.lit(True)), "file_id", "left").withColumn("out_of_order", F.col("_late").isNotNull()).drop("_late")


def laid_out(cues: DataFrame, options: FixOptions) -> DataFrame:
    """Merged cues with their lines laid out, those without text dropped, numbered from 1."""
    text = layout.lay_out(F.col("text"), options.max_line_length, options.min_words_merge)
    out = cues.withColumn("text", text).filter("text <> ''")
    return out.withColumns({"pos": F.col("nth"), "idx": F.col("nth")}).drop("nth")


def merge_cues(df: DataFrame, options: FixOptions | None = None) -> DataFrame:
    """One pass: (file_id, pos, idx, from_ms, to_ms, text, out_of_order)."""
    options = options or FixOptions()
    return laid_out(merged(filters.survivors(df, options)), options)


def merge_again(once: DataFrame, options: FixOptions) -> DataFrame:
    """The second pass over merge_cues(), kept before: files out of order are sorted and merged once more, normalisation
    included; the others stay as they are."""
    late = once.filter("out_of_order")
    if late.isEmpty():
        return once
    # the order of times is that of the second pass, whose places need not be whole numbers from 1
    placed = late.withColumn("pos", F.struct("from_ms", "to_ms", "idx"))
    return once.filter("NOT out_of_order").unionByName(merge_cues(placed, options).withColumn("out_of_order", F.lit(True)))
