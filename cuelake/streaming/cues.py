"""Cue streams: normalisation row by row, and an incremental overlap merge with one open cue per file as state.

Beyond the batch surface: rows have to come in order within a file, and a cue is given out when the next one begins a new
island or the file has been silent for the timeout. There is no second pass for cues out of order; they open an island.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cuelake.operators import filters
from cuelake.operators.merge import fold
from cuelake.options import FixOptions

_OUT = "file_id string, from_ms long, to_ms long, text string"
_STATE = "from_ms long, to_ms long, text string"


def normalized(stream: DataFrame, options: FixOptions | None = None) -> DataFrame:
    """The row-level part of fix(): normalised texts, without empty and inverted cues."""
    return filters.normalized(stream, options or FixOptions()).filter("text <> '' AND from_ms <= to_ms")


def _advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        held, rows = [state.get], []
        state.remove()
        out = held
    else:
        held = [state.get] if state.exists else []
        rows = [r for p in parts for r in p.sort_values("pos")[["from_ms", "to_ms", "text"]].itertuples(index=False, name=None)]
        merged, _ = fold([*held, *((int(a), int(b), t) for a, b, t in rows)])
        *out, last = merged
        state.update(tuple(last))
        state.setTimeoutDuration(60_000)
    yield pd.DataFrame([(key[0], *c) for c in out], columns=["file_id", "from_ms", "to_ms", "text"])


def merged(stream: DataFrame) -> DataFrame:
    """(file_id, from_ms, to_ms, text) of closed islands, from an ordered stream of (file_id, pos, from_ms, to_ms, text)."""
    return stream.groupBy("file_id").applyInPandasWithState(_advance, _OUT, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
