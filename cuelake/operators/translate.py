"""Translating cues: batches go to a pool of tasks that call a service, replies are read, checked, kept in a ledger and joined back.

The pool is a barrier stage, so its tasks run at the same time and can speak to each other. They go in rounds. Before each,
every task tells all how many batches it takes, whether one failed and what its clock says; from that all know when and in
which order the round's calls begin, spaced by the rate that they share, whoever has work. Once a batch has failed for good
its task asks no more, and nobody begins another round. Speaking takes up to a second, so a round is some seconds of calls:
at no rate a task takes as many as it would have made in that time at the last round's pace.

The ledger is a Parquet table with the items of each payload that was answered, by a digest of payload, languages and model.
What it holds isn't asked again, so a run after a failed one calls only what is left; equal payloads are asked once.
translate_fn(payload) -> reply is created once for each task by make_fn(options), so clients with connections or counters
stay on their executor. A batch that fails fails the translation, after what the others got is in the ledger.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.functions.wire import WireError, parse_reply
from cuelake.operators import batches
from cuelake.operators.client import ChatClient, Limiter, backoff
from cuelake.operators.kept import durable, shared_root
from cuelake.options import TranslateOptions

#: Seconds of calls between two rounds; at no rate batches of a task's first round, and characters of any.
ROUND_S, ROUND, ROUND_CHARS = 10, 256, 1 << 25
#: Batches whose outcomes a task holds.
HANDED = 2048
#: Tasks hear of what all have told within so many seconds.
HEARD_S = 1.1
_ITEM = "array<struct<idx:long,text:string>>"
_OUTCOME = f"key string, file_id string, batch_id long, task int, round long, slot long, status string, error string, items {_ITEM}"
_OUTCOME_ARROW = pa.schema([("key", pa.string()), ("file_id", pa.string()), ("batch_id", pa.int64()), ("task", pa.int32()), ("round", pa.int64()), ("slot", pa.int64()), ("status", pa.string()), ("error", pa.string()), ("items", pa.list_(pa.struct([("idx", pa.int64()), ("text", pa.string())])))])
_LEDGER = f"key string, items {_ITEM}"


class BatchFailed(RuntimeError):
    """A batch failed for good; the others were stopped."""


def check_items(expected: list[int], items: list[tuple[int, str]]) -> None:
    """Every expected idx once and no other."""
    got = [i for i, _ in items]
    if len(got) != len(expected):
        raise WireError(f"{len(got)} items instead of {len(expected)}")
    if extra := set(got) - set(expected):
        raise WireError(f"unexpected idx {min(extra)}")
    if len(set(got)) < len(got):
        raise WireError("an idx is repeated")


def run_batch(expected: list[int], payload: str, translate_fn: Callable[[str], str], limiter: Limiter, attempts: int, sleep: Callable[[float], None] = time.sleep) -> list[tuple[int, str]]:
    """Waits for the limiter once, then asks until a reply passes, `attempts` times at most."""
    limiter.wait()
    for n in range(1, max(1, attempts) + 1):
        try:
            items = parse_reply(translate_fn(payload))
            check_items(expected, items)
            return items
        except WireError:
            if n >= attempts:
                raise
            sleep(backoff(n, 0.25, 3.0, 0.2))
    raise AssertionError


def outcomes(sent: DataFrame, options: TranslateOptions, make_fn: Callable[[TranslateOptions], Callable[[str], str]], deal: Column | None = None, size: int | None = None) -> DataFrame:
    """(key, file_id, batch_id, task, round, slot, status, error, items) of sent (key, file_id, batch_id, payload): a batch is done,
    failed or, as another one failed before its turn, cancelled. slot: its call's place among all calls. deal: the task of each
    batch, a number below max_workers; else by its key. There are no more tasks than run at the same time. size: batches that a
    task takes for a round."""
    spark = sent.sparkSession
    workers = max(1, min(options.max_workers, spark.sparkContext.defaultParallelism))
    gap = 1.0 / options.rps if options.rps > 0 else 0.0
    paced = not (size or gap)
    size = size or (max(1, math.ceil(ROUND_S * options.rps / workers)) if gap else ROUND)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, fn, free = BarrierTaskContext.get(), make_fn(options), Limiter(0)
        me, turn, before, failed, start, most = context.partitionId(), 0, 0, False, 0.0, size
        rows = (r for part in parts for r in zip(*(part.column(c).to_pylist() for c in ("key", "file_id", "batch_id", "payload")), strict=True))
        while True:
            mine = taken(rows, most)
            told = [json.loads(x) for x in context.allGather(json.dumps([len(mine), failed, time.time()]))]
            calls = sum(n for n, _, _ in told)
            if not calls or any(bad for _, bad, _ in told):
                break
            first, out = sum(n for n, _, _ in told[:me]), []
            start, spent = max(start, max(t for _, _, t in told) + HEARD_S), 0.0
            began = time.monotonic()
            for k, (key, file_id, batch_id, payload) in enumerate(mine, first):
                if failed:
                    out.append((key, file_id, batch_id, me, turn, None, "cancelled", None, None))
                    continue
                if gap:
                    time.sleep(max(0.0, start + k * gap - time.time()))
                try:
                    got = run_batch([i for i, _ in parse_reply(payload)], payload, fn, free, options.retry_parse_max_attempts)
                    out.append((key, file_id, batch_id, me, turn, before + k, "done", None, [{"idx": i, "text": t} for i, t in got]))
                except Exception as e:
                    failed = True
                    out.append((key, file_id, batch_id, me, turn, before + k, "failed", f"{type(e).__name__}: {e}"[:1000], None))
                if len(out) == HANDED:
                    spent += time.monotonic() - began
                    yield _handed(out)
                    out, began = [], time.monotonic()
            yield _handed(out)
            spent += time.monotonic() - began
            if paced and mine:
                most = max(1, min(16 * most, int(ROUND_S * len(mine) / max(spent, 1e-3))))
            start, before, turn = start + calls * gap, before + calls, turn + 1
        # what is left has not been asked
        while mine:
            yield _handed([(*row[:3], me, turn, None, "cancelled", None, None) for row in mine])
            turn, mine = turn + 1, taken(rows, most)

    task = F.pmod(F.xxhash64("key"), F.lit(workers)) if deal is None else deal
    dealt = sent.select("key", "file_id", "batch_id", "payload", task.cast("int").alias("_task")).repartitionById(workers, F.col("_task")).sortWithinPartitions("file_id", "batch_id").drop("_task")
    return dealt.mapInArrow(run, _OUTCOME, barrier=True)


def taken(rows: Iterator[tuple], most: int) -> list[tuple]:
    """The next rows, `most` at most, and no more once their payloads have ROUND_CHARS."""
    out, chars = [], 0
    while len(out) < most and chars < ROUND_CHARS and (row := next(rows, None)):
        out.append(row)
        chars += len(row[3] or "")
    return out


def _handed(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_OUTCOME_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUTCOME_ARROW, strict=True)], schema=_OUTCOME_ARROW)


def keyed(sent: DataFrame, options: TranslateOptions) -> DataFrame:
    """sent with `key`, by which the ledger knows an answer."""
    parts = [F.lit(x) for x in (options.model, options.base_url, options.source_language, options.target_language)]
    return sent.withColumn("key", F.sha2(F.to_json(F.array(*parts, F.col("payload"))), 256))


def held(ledger: str, like: DataFrame) -> DataFrame:
    """The ledger's (key, items), a row for each key; an empty one is begun if there is none."""
    spark = like.sparkSession
    spark.createDataFrame([], _LEDGER).write.mode("append").parquet(ledger)
    return spark.read.schema(_LEDGER).parquet(ledger).groupBy("key").agg(F.any_value("items").alias("items"))


def ask(sent: DataFrame, options: TranslateOptions, make_fn: Callable, ledger: str, deal: Column | None = None, wave: int | None = None, size: int | None = None) -> None:
    """Puts into the ledger what it lacks of sent (key, file_id, batch_id, payload), `wave` batches at a time: no more than that is
    lost with a job. BatchFailed if one failed; all that was answered is in the ledger then."""
    once = durable(sent.groupBy("key").agg(F.min(F.struct("file_id", "batch_id", "payload")).alias("one")).select("key", "one.*"))
    while True:
        left = once.join(held(ledger, sent).select("key"), "key", "left_anti")
        left = left.limit(wave) if wave else left
        got = durable(outcomes(left, options, make_fn, deal, size))
        got.filter("status = 'done'").select("key", "items").write.mode("append").parquet(ledger)
        failed = got.filter("status = 'failed'").orderBy("slot").select("file_id", "batch_id", "error").take(1)
        if failed:
            raise BatchFailed(f"batch {failed[0]['batch_id']} of {failed[0]['file_id']}: {failed[0]['error']}")
        if not wave or got.isEmpty():
            return


def translated_items(cues: DataFrame, options: TranslateOptions, make_fn: Callable[[TranslateOptions], Callable[[str], str]] = ChatClient, ledger: str | None = None, wave: int | None = None) -> DataFrame:
    """(file_id, batch_id, idx, text) for every cue."""
    sent = durable(keyed(batches.payloads(batches.build_batches(cues, options.max_batch_chars)), options))
    ledger = ledger or f"{shared_root(cues.sparkSession)}/ledger-{uuid.uuid4().hex}"
    ask(sent, options, make_fn, ledger, wave=wave)
    got = sent.select("key", "file_id", "batch_id").join(held(ledger, sent), "key")
    return got.select("file_id", "batch_id", F.inline("items"))


def translate(cues: DataFrame, options: TranslateOptions, make_fn: Callable = ChatClient, ledger: str | None = None, wave: int | None = None) -> DataFrame:
    """cues with translated texts. make_fn(options) gives the function that a task calls with each payload; ledger: where answers
    are kept for later runs, in any store that Spark writes."""
    return batches.apply_translations(cues, translated_items(cues, options, make_fn, ledger, wave))
