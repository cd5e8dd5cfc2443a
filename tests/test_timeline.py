"""Filters, merge, order, source and pipelines on authored cues and random files."""

import random
import time
import uuid

import pytest
from pyspark.sql import functions as F

from cuelake.operators import batches, filters, merge, order
from cuelake.operators import translate as translating
from cuelake.operators.translate import run_batch, translate
from cuelake.operators.client import Limiter
from cuelake.functions.wire import WireError
from cuelake.options import FixOptions, TranslateOptions
from cuelake.plans import pipeline
from cuelake.sources import files as single
from cuelake.sources import srt

CUE = "file_id string, pos long, idx long, from_ms long, to_ms long, text string"


def cues(spark, rows, name="f"):
    return spark.createDataFrame([(name, i, i + 1, *r) for i, r in enumerate(rows)], CUE)


def fixed(spark, rows, **options):
    got = pipeline.fix(cues(spark, rows), FixOptions(**options)).orderBy("pos").collect()
    assert [r["idx"] for r in got] == list(range(1, len(got) + 1))
    return [(r["from_ms"], r["to_ms"], r["text"]) for r in got]


def test_overlap_takes_the_later_cues_end(spark):
    assert fixed(spark, [(0, 5000, "a"), (1000, 2000, "b"), (2000, 3000, "c")]) == [(0, 2000, "a\nb"), (2000, 3000, "c")]


def test_short_repeat_stretches(spark):
    assert fixed(spark, [(0, 1000, "hello you"), (600_000, 600_100, "hello"), (700_000, 700_100, "other")]) == [(0, 600_100, "hello you"), (700_000, 700_100, "other")]


def test_first_cue_is_special(spark):
    # a copy of the first cue overlaps it and is joined; the third is dropped as a copy of the second
    assert fixed(spark, [(0, 1000, "A"), (0, 1000, "A"), (0, 1000, "A")]) == [(0, 1000, "A\nA")]
    assert fixed(spark, [(0, 1000, ""), (500, 900, "b")]) == [(0, 900, "b")]
    assert fixed(spark, [(5000, 1000, "inverted"), (6000, 5500, "gone"), (7000, 8000, "x")]) == [(5000, 1000, "inverted"), (7000, 8000, "x")]


def test_copies_and_credits(spark):
    assert fixed(spark, [(0, 1, "Translator: me"), (1, 2, "TRADUCCIÓN x"), (1000, 2000, "a"), (3000, 4000, "b"), (5000, 6000, "translate this"), (3000, 4000, "b")]) == [(1000, 2000, "a"), (3000, 4000, "b"), (5000, 6000, "translate this")]


def test_out_of_order_files_are_merged_twice(spark):
    got = fixed(spark, [(10_000, 11_000, "NORA: OLAF: hi"), (1000, 2000, "first")], strip_hi=True)
    assert got == [(1000, 2000, "first"), (10_000, 11_000, "hi")]


def test_shift(spark):
    rows = [(1000, 2000, "a")]
    assert fixed(spark, rows, shift_ns=2 * 10**9) == [(3000, 4000, "a")]
    assert fixed(spark, rows, shift_ns=-1) == [(999, 1999, "a")]
    with pytest.raises(Exception, match="negative"):
        fixed(spark, rows, shift_ns=-2 * 10**9)
    assert order.shift_time(cues(spark, rows), -2 * 10**9, "PERMISSIVE").count() == 0


def odd_files(rng, files, most):
    """Files with cues that overlap, repeat shortly, have no text or come late, some long."""
    rows = []
    for f in range(files):
        at = 0
        for p in range(rng.randint(1, most)):
            at += rng.choice([0, 100, 500, 2000]) if f % 2 else rng.choice([-3000, 0, 500, 2000])
            rows.append((f"f{f}", 3 * p, p + 1, at, at + (rng.choice([200, 900, 3000]) if f % 3 else rng.choice([50, 100, 900, 3000])), "" if p == 0 and f % 4 == 0 else rng.choice(["a", "b", "c", "a b"])))
    return rows


@pytest.mark.parametrize(("lead", "pieces"), [(64, None), (64, 13), (2, 40), (3, 7)])
def test_pieces_give_what_the_fold_gives(spark, lead, pieces):
    """Files cut into pieces at any place, with leads that suffice at once or don't."""
    rng = random.Random(lead + (pieces or 0))
    df = filters.survivors(spark.createDataFrame(odd_files(rng, 40, 25) + [("long", p, p, 100 * p, 100 * p + 50, rng.choice("abcdefgh")) for p in range(400)], CUE), FixOptions())
    got = merge.merged(df, lead, pieces).toPandas()
    for name, part in df.toPandas().groupby("file_id"):
        part = part.sort_values("pos")
        want, late = merge.fold(zip(part["from_ms"], part["to_ms"], part["text"], strict=True))
        mine = got[got["file_id"] == name].sort_values("pos")
        assert mine[["from_ms", "to_ms", "text"]].to_numpy().tolist() == want and (mine["out_of_order"] == late).all()
        assert mine["pos"].tolist() == list(range(1, len(want) + 1))
        told = [bool(t.strip()) for _, _, t in want]
        assert [n for n, t in zip(mine["nth"], told, strict=True) if t] == list(range(1, sum(told) + 1))


def test_one_file_over_many_tasks(spark):
    """No task holds more of a file than its piece, and no plan has a window or a group of a file's cues."""
    rng = random.Random(9)
    rows = [("one", p, p + 1, 300 * p + rng.choice([0, 0, -2000]), 300 * p + rng.choice([100, 250, 700]), rng.choice(["x", "y", "x y", "z"])) for p in range(3000)]
    df = spark.createDataFrame(rows, CUE)
    out = merge.merged(filters.survivors(df, FixOptions()), pieces=8)
    per_task = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) >= 2
    tasks = spark.createDataFrame(rows, CUE).repartitionByRange(8, "file_id", "pos").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == 8 and max(r["count"] for r in tasks) < 800
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "collect_list" not in plan
    want, late = merge.fold((r["from_ms"], r["to_ms"], r["text"]) for r in filters.survivors(df, FixOptions()).orderBy("pos").collect())
    assert [[r["from_ms"], r["to_ms"], r["text"]] for r in out.orderBy("pos").collect()] == want
    assert out.filter("out_of_order").count() == (len(want) if late else 0)


def test_first_file_without_text(spark):
    """An island without text, cut from what follows, isn't counted."""
    rows = [("f", 0, 1, 0, 1000, ""), ("f", 1, 2, 2000, 3000, "a"), ("f", 2, 3, 4000, 5000, "b"), ("g", 0, 1, 0, 1000, ""), ("g", 1, 2, 500, 3000, "a"), ("g", 2, 3, 4000, 5000, "b")]
    for pieces in (1, 3, 6):
        got = merge.merged(filters.survivors(spark.createDataFrame(rows, CUE), FixOptions()), 2, pieces).filter("text <> ''").orderBy("file_id", "nth").collect()
        assert [(r["file_id"], r["pos"], r["nth"], r["text"]) for r in got] == [("f", 2, 1, "a"), ("f", 3, 2, "b"), ("g", 1, 1, "\na"), ("g", 2, 2, "b")]


def test_numbering(spark):
    df = cues(spark, [(0, 1, "a"), (2, 3, "b"), (4, 5, "c")])
    assert order.validate_idx(df).count() == 0
    odd = df.withColumn("idx", F.col("idx") * 10)
    assert [tuple(r) for r in order.validate_idx(odd).collect()] == [("f", 1, 10)]
    assert [r["idx"] for r in order.reindex(odd).orderBy("pos").collect()] == [1, 2, 3]


BLOCK = "1\n00:00:01,000 --> 00:00:02,500\n"


@pytest.mark.parametrize(
    ("content", "want"),
    [
        ("7\r\n0:61:1,25 --> 2:0:0,9 X1:3\r\n\tlow tide \r\n mud\r\n\r\n\r\n\r\n-8\r\n00:00:01,000 --> 00:00:02,500\r\nboats", [(7, 3_661_025, 7_200_009, "low tide\nmud"), (-8, 1000, 2500, "boats")]),
        ("﻿" + BLOCK + "x\n", [(1, 1000, 2500, "x")]),
        ("\n\n ﻿" + BLOCK + "﻿x", [(1, 1000, 2500, "﻿x")]),
        (BLOCK + "Hello\n   \nWorld\n\n", [(1, 1000, 2500, "Hello\nWorld")]),
        (BLOCK + "\n2\n00:00:03,000 --> 00:00:04,000\nb\n\n", [(1, 1000, 2500, ""), (2, 3000, 4000, "b")]),
        ("", []),
        (" \n\n", []),
        ("x\n" + BLOCK, None),
        ("1\n", None),
        ("1\n\n00:00:01,000 --> 00:00:02,500\nx\n", None),
        ("1.5\n00:00:01,000 --> 00:00:02,500\nx\n", None),
        (BLOCK + "y" * 70_000, None),
    ],
)
def test_scan(spark, content, want):
    rows = srt.parse(spark.createDataFrame([("f", content)], "file_id string, content string")).orderBy("pos").collect()
    if want is None:
        assert [r["_error"] is not None for r in rows] == [True]
        with pytest.raises(ValueError):
            list(srt.read_cues("f", content))
    else:
        assert [(r["idx"], r["from_ms"], r["to_ms"], r["text"]) for r in rows] == want
        assert [r[2:] for r in srt.read_cues("f", content)] == want


def test_files(spark, tmp_path):
    srt.register(spark)
    rows = cues(spark, [(1000, 2000, "a\nb"), (3000, 4000, "c")]).coalesce(1)
    rows.write.format("srt").mode("append").save(str(tmp_path / "out"))
    assert (tmp_path / "out" / "f.srt").read_text() == "1\n00:00:01,000 --> 00:00:02,000\na\nb\n\n2\n00:00:03,000 --> 00:00:04,000\nc\n\n"
    back = spark.read.format("srt").load(str(tmp_path / "out")).orderBy("pos").collect()
    native = srt.scan(spark, str(tmp_path / "out")).orderBy("pos").collect()
    assert [r[1:] for r in back] == [r[1:] for r in native] == [(0, 1, 1000, 2000, "a\nb"), (1, 2, 3000, 4000, "c")]
    with pytest.raises(ValueError):
        srt.scan(spark, "-")


def test_files_that_are_asked_for_are_opened_alone(spark, tmp_path):
    """By a path that only Spark opens, too: other files would fail, as they are malformed."""
    for name in "abc":
        (tmp_path / f"{name}.srt").write_text("x\n" if name != "b" else "1\n00:00:01,000 --> 00:00:02,000\nyes\n")
    spark.conf.set("fs.viewfs.mounttable.cues.link./store", tmp_path.as_uri())
    for folder in (str(tmp_path), "viewfs://cues/store"):
        found = srt.scan(spark, folder)
        ids = [r[0] for r in spark.read.text(folder, wholetext=True).select("_metadata.file_path").distinct().collect()]
        assert len(ids) == 3
        got = found.filter(F.col("file_id") == next(x for x in ids if x.endswith("b.srt")))
        assert [r.text for r in got.collect()] == ["yes"]
        with pytest.raises(Exception, match="invalid subtitle index"):
            found.collect()
    srt.register(spark)
    own = spark.read.format("srt").load(str(tmp_path))
    assert [r.text for r in own.filter(F.col("file_id").isin(str(tmp_path / "b.srt"), "z") & (F.col("pos") == 0)).collect()] == ["yes"]
    assert own.filter(F.col("file_id") == "z").count() == 0


def test_fix_files(spark, tmp_path):
    heard = "1\n00:00:01,000 --> 00:00:02,000\n[APPLAUSE]\n\n2\n00:00:03,000 --> 00:00:04,000\nIt was late [bell rings]\n\n3\n00:00:05,000 --> 00:00:06,000\n- [Mr. Finch] Nobody came.\n\n\n"
    style = '1\n00:00:01,000 --> 00:00:02,000\n<font size="9">Left<br/>Right</font>\n\n\n'
    files = spark.createDataFrame([("a", heard), ("b", BLOCK + "-\n\n")], "file_id string, content string")
    got = {r["file_id"]: r for r in pipeline.fix_files(files, FixOptions(strip_hi=True, strip_hi_mode="safe")).collect()}
    assert got["a"]["content"] == "1\n00:00:03,000 --> 00:00:04,000\nIt was late\n\n2\n00:00:05,000 --> 00:00:06,000\n- Nobody came.\n\n" and got["a"]["changed"]
    assert got["b"]["content"] == BLOCK + "-\n\n" and got["b"]["was_empty"] and not got["b"]["changed"]
    one = pipeline.fix_files(spark.createDataFrame([("a", style)], "file_id string, content string"), FixOptions(strip_style=True, shift_ns=10**9)).first()
    assert one["content"] == "1\n00:00:02,000 --> 00:00:03,000\nLeft\nRight\n\n"
    path = tmp_path / "x.srt"
    path.write_text(style)
    path.chmod(0o640)
    (tmp_path / "x.srt.bak").write_text("older")
    assert not srt.publish(str(path), one["content"], dry_run=True) and path.read_text() == style
    (tmp_path / "link.srt").symlink_to(path)
    assert srt.publish(str(tmp_path / "link.srt"), one["content"]) and (tmp_path / "x.srt.bak").read_text() == style
    assert path.read_text() == one["content"] and path.stat().st_mode & 0o777 == 0o640
    assert not srt.publish(str(path), one["content"])
    assert srt.publish(str(path), "new", target=tmp_path / "y.srt") and path.read_text() == one["content"] and not (tmp_path / "y.srt.bak").exists()
    assert sorted(x.name for x in tmp_path.iterdir()) == ["link.srt", "x.srt", "x.srt.bak", "y.srt"]


def test_targets(tmp_path):
    goal = tmp_path / "new.srt"
    assert single.check_new(goal) == single.resolved(goal) and not list(tmp_path.iterdir())
    assert single.create(goal, "a\n").read_text() == "a\n"
    with pytest.raises(FileExistsError):
        single.create(goal, "b")
    assert goal.read_text() == "a\n" and [x.name for x in tmp_path.iterdir()] == ["new.srt"]
    assert single.check_writable(goal) == goal
    for bad, error in ((tmp_path / "none" / "x", NotADirectoryError), (tmp_path, IsADirectoryError), ("", ValueError)):
        with pytest.raises(error):
            single.check_writable(bad)
    (tmp_path / "again").symlink_to(goal)
    assert single.same_file(goal, tmp_path / "again") and not single.same_file(goal, "") and single.same_file("/no/a/../b", "/no/b")


def test_writer_commits_whole_or_not_at_all(spark, tmp_path):
    srt.register(spark)
    root = tmp_path / "out"
    rows = [("a", 0, 1, 0, 1, "x"), ("b", 0, 1, 0, 1, "y")]
    write = lambda r: spark.createDataFrame(r, CUE).coalesce(1).write.format("srt").mode("append").save(str(root))
    write(rows)
    for again in ([("c", 0, 1, 0, 1, "z"), ("a", 0, 1, 0, 1, "other")], [("d", 0, 1, 0, 1, "z"), ("e", 0, 1, 0, 1, None)]):
        with pytest.raises(Exception):
            write(again)
        assert sorted(x.name for x in root.iterdir()) == ["a.srt", "b.srt"] and "x" in (root / "a.srt").read_text()
    writer = srt._Writer(str(root))
    first, second = (writer.write(iter([{"file_id": "f", "pos": 0, "from_ms": 0, "to_ms": 1, "text": "t"}])) for _ in range(2))  # a task and its second try
    writer.abort([first, None])
    writer.commit([second])
    assert sorted(x.name for x in root.iterdir()) == ["a.srt", "b.srt", "f.srt"]


def test_batches(spark):
    df = cues(spark, [(0, 1, "x" * 10), (2, 3, "y" * 10), (4, 5, "z" * 500), (6, 7, "w")])
    got = [r["batch_id"] for r in batches.build_batches(df, 70).orderBy("idx").collect()]
    assert got == [0, 0, 1, 2]
    with pytest.raises(Exception, match="positive"):
        batches.payloads(batches.build_batches(df.withColumn("idx", F.lit(0)), 70)).collect()


def greedy(sizes, most):
    out, batch, filled = [], 0, 0
    for n in sizes:
        if filled and filled + n > most:
            batch, filled = batch + 1, 0
        filled += n
        out.append(batch)
    return out


@pytest.mark.parametrize("stretch", [1, 2, 7, 256])
def test_batches_by_doubling(spark, stretch):
    """Files of one stretch and of many, with cues beyond the limit, beyond a stretch, and a last one that goes on a batch."""
    rng, most = random.Random(stretch), 120
    texts = {f"f{n}": ["x" * rng.choice([1, 5, 20, 60, 110, 400 if n % 3 else 2]) for _ in range(rng.randint(1, 60))] for n in range(25)}
    texts["long"] = ["y" * rng.randint(1, 70) for _ in range(900)]
    texts["tail"] = ["z" * 60] * 13 + ["z"]
    rows = [(f, 5 * i, i + 1, 0, 1, t) for f, ts in texts.items() for i, t in enumerate(ts)]
    got = {}
    for r in batches.build_batches(spark.createDataFrame(rows, CUE).repartition(5), most, stretch).collect():
        got.setdefault(r["file_id"], {})[r["idx"]] = (r["batch_id"], r["text"])
    for f, ts in texts.items():
        sizes = [len('{"idx":,"text":""}') + len(str(i + 1)) + len(t) + 1 for i, t in enumerate(ts)]
        assert [got[f][i + 1] for i in range(len(ts))] == list(zip(greedy(sizes, most), ts, strict=True)), f


def test_batches_without_python(spark):
    plan = batches.build_batches(cues(spark, [(0, 1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_translate(spark):
    def reply_upper(options):
        import json

        return lambda payload: "\n".join(json.dumps({"idx": (d := json.loads(x))["idx"], "text": d["text"].upper()}) for x in payload.split("\n"))

    df = cues(spark, [(0, 1000, "Hello"), (2000, 3000, "Bye <i>")])
    got = translate(df, TranslateOptions("es", rps=0), reply_upper).orderBy("pos").collect()
    assert [(r["from_ms"], r["text"]) for r in got] == [(0, "HELLO"), (2000, "BYE <I>")]
    answers = iter(["nonsense", '{"idx":1,"text":"Hola"}'])
    assert run_batch([1], "p", lambda p: next(answers), Limiter(0), 2, lambda s: None) == [(1, "Hola")]
    for bad in ('{"idx":2,"text":"x"}', '{"idx":1,"text":"x"} {"idx":1,"text":"y"}'):
        with pytest.raises(WireError):
            run_batch([1], "p", lambda p, b=bad: b, Limiter(0), 2, lambda s: None)


def numbered_payloads(spark, n):
    rows = [(f"k{i:03}", f"f{i:03}", 0, '{"idx":%d,"text":"t%d"}' % (i + 1, i)) for i in range(n)]
    return spark.createDataFrame(rows, "key string, file_id string, batch_id long, payload string")


def test_pool_keeps_one_rate(spark):
    """Calls of four tasks are spaced by one rate, also when only one of them has work left."""
    options = TranslateOptions("es", max_workers=4, rps=40.0)

    def service(options):
        return lambda payload: payload.replace(':"t', f':"{time.time()} ')

    task = F.when(F.substring("file_id", 2, 3).cast("int") < 20, F.substring("file_id", 2, 3).cast("int") % 4).otherwise(3)
    got = translating.outcomes(numbered_payloads(spark, 40), options, service, task, 4).collect()
    assert {r["status"] for r in got} == {"done"} and sorted(r["slot"] for r in got) == list(range(40))
    began = [float(r["items"][0]["text"].split()[0]) for r in sorted(got, key=lambda r: r["slot"])]
    gaps = [b - a for a, b in zip(began, began[1:], strict=False)]
    assert min(gaps) > 0.015 and began[-1] - began[0] >= 39 / 40 - 0.02
    assert max(r["round"] for r in got if r["task"] == 0) == 1 and max(r["round"] for r in got if r["task"] == 3) == 6


def test_rounds_follow_the_calls_pace(spark, monkeypatch):
    """At no rate a task's rounds grow while calls are fast, as speaking takes a second each, and shrink when they are slow."""

    def service(seconds):
        return lambda options: lambda payload: time.sleep(seconds) or payload

    def rounds(n, seconds):
        got = translating.outcomes(numbered_payloads(spark, n), TranslateOptions("es", max_workers=1, rps=0), service(seconds)).collect()
        assert {r["status"] for r in got} == {"done"} and sorted(r["slot"] for r in got) == list(range(n))
        assert all(r["items"][0]["text"] == f"t{int(r['file_id'][1:])}" for r in got)
        return [sum(r["round"] == k for r in got) for k in range(max(r["round"] for r in got) + 1)]

    monkeypatch.setattr(translating, "ROUND", 4)
    assert len(rounds(200, 0)) <= 5
    monkeypatch.setattr(translating, "ROUND_S", 0.25)
    first, *others = rounds(9, 0.1)
    assert first == 4 and max(others) <= 2


def test_a_round_holds_so_many_characters():
    rows = iter([("k", "f", n, "x" * (translating.ROUND_CHARS // 2)) for n in range(5)])
    assert [[r[2] for r in translating.taken(rows, most)] for most in (9, 1, 9, 9)] == [[0, 1], [2], [3, 4], []]


def test_first_failure_stops_all(spark):
    options = TranslateOptions("es", max_workers=4, rps=0)

    def service(options):
        def call(payload):
            if '"t13"' in payload:
                raise ValueError("refused")
            return payload

        return call

    got = {r["file_id"]: r for r in translating.outcomes(numbered_payloads(spark, 80), options, service, F.substring("file_id", 2, 3).cast("int") % 4, 2).collect()}
    assert len(got) == 80 and got["f013"]["status"] == "failed" and got["f013"]["error"] == "ValueError: refused"
    # f013 is its task's fourth; each round has two of each task
    want = {f"f{n:03}": "failed" if n == 13 else "done" if n < 16 else "cancelled" for n in range(80)}
    assert {f: r["status"] for f, r in got.items()} == want
    assert all((r["slot"] is None) == (r["status"] == "cancelled") for r in got.values())


def test_a_second_run_asks_what_is_left(spark, tmp_path):
    """Answers outlive a failed run; equal payloads are asked once, and waves end when nothing is left."""
    asked = tmp_path / "asked"
    asked.mkdir()

    def service(bad):
        def make(options):
            def call(payload):
                (asked / uuid.uuid4().hex).write_text(payload)
                if bad and "stop" in payload:
                    raise ValueError("refused")
                return payload.replace("say", "dicen")

            return call

        return make

    rows = [(f"f{n:02}", 0, 1, 0, 1, "say stop" if n == 30 else f"say {n // 2}") for n in range(40)]
    df = spark.createDataFrame(rows, CUE)
    options, ledger = TranslateOptions("es", max_workers=2, rps=0), str(tmp_path / "ledger")
    with pytest.raises(translating.BatchFailed, match="refused"):
        translate(df, options, service(True), ledger).collect()
    first = [p.read_text() for p in asked.iterdir()]
    got = {r["file_id"]: r["text"] for r in translate(df, options, service(False), ledger, wave=4).collect()}
    assert got == {r[0]: r[5].replace("say", "dicen") for r in rows}
    every = [p.read_text() for p in asked.iterdir()]
    assert len(set(every)) == 21 and sorted(every) == sorted([*set(every), *[p for p in first if "stop" in p]])
    assert translate(df, options, service(True), ledger).count() == 40 and len(list(asked.iterdir())) == len(every)
    assert translate(df, TranslateOptions("fr", rps=0), service(False), ledger).count() == 40 and len(list(asked.iterdir())) == len(every) + 21


def test_stream(spark, tmp_path):
    from cuelake.streaming import cues as stream

    cues(spark, [(0, 1000, " a "), (500, 2000, "b"), (5000, 6000, "c"), (9000, 9500, "")]).coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(CUE).parquet(str(tmp_path / "in"))
    query = stream.merged(stream.normalized(live)).writeStream.format("memory").queryName("islands").outputMode("append").start()
    for _ in range(60):  # batches go on without data, as timeouts are due in processing time
        if spark.sql("SELECT * FROM islands").count():
            break
        time.sleep(1)
    query.stop()
    assert [tuple(r) for r in spark.sql("SELECT * FROM islands").collect()] == [("f", 0, 2000, "a\nb")]


def test_empty_tables(spark):
    none = spark.createDataFrame([], CUE)
    assert pipeline.fix(none).count() == 0 and batches.build_batches(none).count() == 0 and srt.render(none).count() == 0


def test_fold_in_python():
    assert merge.fold([]) == ([], False)


def test_second_pass_leaves_sound_files_alone(spark):
    """A file in order isn't normalised again, whatever a second pass would do to its text; one out of order is."""
    sound = [("a", 0, 1, 1000, 2000, "NORA: OLAF: hi"), ("a", 1, 2, 3000, 4000, "Translator: me"), ("a", 2, 3, 3000, 4000, "x" * 80 + " y")]
    late = [("b", 0, 1, 9000, 9500, "NORA: OLAF: hi"), ("b", 1, 2, 1000, 2000, "KAY: ANN: yes")]
    rows = pipeline.fix(spark.createDataFrame(sound + late, CUE), FixOptions(strip_hi=True)).orderBy("file_id", "pos").collect()
    assert [(r["file_id"], r["idx"], r["from_ms"], r["text"]) for r in rows] == [("a", 1, 1000, "OLAF: hi"), ("a", 2, 3000, "Translator: me\n" + "x" * 80 + "\ny"), ("b", 1, 1000, "yes"), ("b", 2, 9000, "hi")]


def test_numbered(spark):
    df = cues(spark, [(0, 1, "a"), (2, 3, "b")], "f").unionByName(cues(spark, [(0, 1, "a"), (2, 3, "b")], "g").withColumn("idx", F.col("idx") + 1))
    assert [(r["file_id"], r["idx"], r["was_misnumbered"]) for r in order.numbered(df).orderBy("file_id", "pos").collect()] == [("f", 1, False), ("f", 2, False), ("g", 1, True), ("g", 2, True)]


def test_input_is_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(parts):
        for part in parts:
            seen.add(len(part))
            yield part

    df = cues(spark, [(1000, 2000, "a"), (3000, 4000, "b"), (0, 500, "c")])
    assert pipeline.fix(df.mapInPandas(count, CUE)).count() == 3
    assert seen.value == 3
