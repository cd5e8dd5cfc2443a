"""Scalar functions against tables of cases and, where a loop defines them, against the loop."""

import random
import re
import threading
import time

import pytest
from pyspark.sql import functions as F

from cuelake import sql
from cuelake.functions import hi, language, layout, style, text, timing, wire
from cuelake.operators import client
from cuelake.options import FixOptions, TranslateOptions, resolved


def apply(spark, column, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v string").select("i", column(F.col("v")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


def check(spark, column, cases):
    assert apply(spark, column, [a for a, _ in cases]) == [b for _, b in cases]


def test_clean_text(spark):
    check(spark, text.clean_text, [("\t\n ferry\t\r\n ", "ferry"), (" north\tpier \nat dawn", "north\tpier\nat dawn"), ("one\n\n \n\ntwo\nthree", "one\ntwo\nthree"), (" gulls \r\n\r\n ropes\r\n", "gulls\nropes"), ("", ""), (" x　", "x"), (None, None)])


def test_structural_line(spark):
    check(spark, text.structural_line, [("﻿1", "1"), (" ﻿1", "1"), ("﻿ ﻿7 ", "7"), ("   ", "")])


def test_decorative(spark):
    yes = ["-", "- - -", ":::", "...", "____", "♪", "♪ ♪ ♪", "♫", "♫ ♫", " - -"]
    no = ["-:_", "♪ ♫", "- Night", "NORA:", "Night", "", "  ", "-\u0085x"]
    assert apply(spark, text.is_decorative, yes + no) == [True] * len(yes) + [False] * len(no)
    check(spark, text.drop_decorative, [("Left\n____\nRight", "Left\nRight"), ("-", "")])


def test_small_strings(spark):
    check(spark, text.mask_keys, [("tide42,harbour", "t****2,h*****r"), ("q,no,", "*,n*,"), (",,", ",,"), ("", "")])
    check(spark, lambda c: text.mask_keys(c, ""), [("tide42,moor", "t*********r")])
    check(spark, text.normalize_csv, [("rope , , oar,sail ,", "rope,oar,sail"), (" , ,", "")])
    check(spark, lambda c: text.abbreviate(c, 5), [("  abcdef ", "ab..."), ("abcde", "abcde"), ("", "")])
    check(spark, lambda c: text.abbreviate(c, 3), [("abcdef", "abc"), ("éé", "é"), ("♪♪", "♪"), ("😀x", "")])
    check(spark, lambda c: text.abbreviate(c, 10), [("éééééééé", "ééé..."), ("😀😀😀", "😀..."), ("aé♪😀é♪😀", "aé♪...")])
    check(spark, lambda c: text.abbreviate(c, 0), [(" abc ", "abc")])
    check(spark, text.strip_code_fences, [("```json\na\nb\n```", "a\nb\n"), ("```a```", "```a"), ("x ```", "x ```"), ("```\na```b```c", "a```b"), ("", "")])


@pytest.mark.parametrize(
    ("mode", "cases"),
    [
        ("safe", [("[on the phone]: NORA: Wait [glass breaks]", "NORA: Wait"), ("[wind howls]:", ""), ("- [dog barks] -[Ann coughs]", ""), ("- [Mr. Finch] Sit here.", "- Sit here."), ("(yawns) Night", "(yawns) Night"), ("...", "")]),
        ("standard", [("[on the phone]: NORA: Wait [glass breaks]", "Wait"), ("- Good night.", "- Good night."), ("-foo", "- foo"), ("-- foo", "- foo"), ("[x] - hi", "hi"), ("(yawns)", "(yawns)"), ("NORA: OLAF: hi", "OLAF: hi"), ("NORA: ♪ (coughs) sing! [bell rings]", "♪ (coughs) sing!")]),
        ("safe-plus", [("(coughs) NORA: Wait {bell rings}", "NORA: Wait")]),
        ("standard-plus", [("(coughs) NORA: Wait {bell rings}", "Wait"), ("NORA: ♪ {tired} (coughs) sing! [bell rings]", "♪ sing!"), ("Get down,\n[static\ncrackling]\nQuick!", "Get down,\nQuick!"), ("a (b\nc] d", "a (b\nc] d")]),
    ],
)
def test_hi_modes(spark, mode, cases):
    check(spark, lambda c: hi.strip_hi(c, mode), cases)


def test_hi_loops(spark):
    """The quantified patterns give what repeating the single step gives."""
    rng = random.Random(5)
    lines = ["".join(rng.choice(["[a]", "[b c]", "-", " ", ":", "x", "Y1", "[", "]"]) for _ in range(rng.randint(1, 8))).strip() for _ in range(3000)]
    cue, sep = r"\[[^\[\]]+\]", r"(?:\s*[:\-]\s*|\s+)"
    only = re.compile(rf"^(?:-\s*)?{cue}(?:\s*[:\-]\s*)?\Z")

    def loop(line):
        if only.match(line):
            line = ""
        for pattern, to in ((rf"^-\s*{cue}{sep}(.+)\Z", "- {}"), (rf"^{cue}{sep}(.+)\Z", "{}"), (rf"^(.+?)\s+{cue}\Z", "{}")):
            while m := re.match(pattern, line):
                line = to.format(m[1].strip())
        line = line.strip()
        return line if any(c.isalnum() for c in line) and not only.match(line) else ""

    assert apply(spark, lambda c: hi.strip_hi(c, "safe"), lines) == [loop(x) for x in lines]


def test_modes_are_checked():
    with pytest.raises(ValueError):
        FixOptions(strip_hi=False, strip_hi_mode="loudest")
    assert FixOptions(strip_hi_mode=" SAFE ").strip_hi_mode == "safe"
    assert FixOptions(max_line_length=0, min_words_merge=-1) == FixOptions()


def test_style(spark):
    cases = [('<font size="9">Left<br/>Right</font>', "Left\nRight"), ("<FONT>Alone<br></FONT>", "Alone"), ("<i><b>nested</b></i>", "nested"), ("<font>Left open", "<font>Left open"), ("a < b > c", "a < b > c"), ("<i>a<b>b</i>", "<i>a<b>b</i>"), ("<!-- x --><i>y</i>", "<!-- x -->y"), ("x<", "x<"), ("", ""), (None, None)]
    check(spark, style.strip_style, cases)
    assert style.strip_text("<i>a<br><b></b>\nb</i>") == "a\nb"


def test_style_holds_few_texts_at_a_time(spark):
    """Whole pages go to Python by 100 rows, also in sessions that turn other UDFs to Arrow, whose batches have 10,000."""
    spark.conf.set("spark.sql.execution.pythonUDF.arrow.enabled", "true")
    try:
        text = F.when(F.col("id") % 3 > 0, F.concat(F.lit("<i>"), F.col("id").cast("string"), F.lit("</i>")))
        got = spark.range(0, 300, 1, 1).select("id", style.strip_style(text).alias("t"))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "Arrow" not in plan
        assert [r["t"] for r in got.collect()] == [str(n) if n % 3 else None for n in range(300)]
    finally:
        spark.conf.unset("spark.sql.execution.pythonUDF.arrow.enabled")


def test_layout(spark):
    check(spark, lambda c: layout.wrap_lines(c, 10), [("aaaa bbbb cccc", "aaaa bbbb\ncccc"), ("aaaaaaaaaaaaaa b", "aaaaaaaaaaaaaa\nb"), ("éééé éééé", "éééé\néééé"), ("<i aaaa bbbb cccc>", "<i aaaa bbbb cccc>"), ("", "")])
    check(spark, layout.merge_short_lines, [("Hola\nque tal\nBien.\ny tu", "Hola que tal\nBien.\ny tu"), ("One long line of words here\n, and on", "One long line of words here , and on"), ("A\nB\nC", "A\nB\nC")])
    many = "\n".join(["Uno", "dos", "tres", "Cuatro", "cinco", "seis", "Siete"])
    check(spark, layout.lay_out, [(many, "Uno dos tres\nCuatro cinco seis\nSiete"), ("a\nb\nc", "a\nb\nc")])


def test_timing(spark):
    rows = spark.createDataFrame([("x 1:02:03,5 --> 00:00:61,1000 X1:3",), ("00:00:01.000 --> 00:00:02.000",), ("99999999999999999999:0:0,0 --> 0:0:0,0",)], "v string")
    got = [tuple(r) for r in rows.select(*timing.parse_timing(F.col("v"))).collect()]
    assert got == [(3_723_005, 62_000), (None, None), (None, 0)]
    shown = spark.createDataFrame([(0, 360_000_000), (3_723_004, 59_999)], "a long, b long").select(timing.format_timing(F.col("a"), F.col("b")).alias("t")).collect()
    assert [r["t"] for r in shown] == ["00:00:00,000 --> 100:00:00,000", "01:02:03,004 --> 00:00:59,999"]
    assert [timing.parse_duration(x) for x in ("500ms", "-2s", "1s250ms", "0", "1.5h", "+3us")] == [500_000_000, -2 * 10**9, 1_250_000_000, 0, 5400 * 10**9, 3000]
    for bad in ("", "5", "s", "1x", "--1s"):
        with pytest.raises(ValueError):
            timing.parse_duration(bad)


def test_language(spark):
    cases = [("EN_gb", ("en-GB", "English (UK)")), ("  es_MX  ", ("es-MX", "Spanish (Neutral Latin American)")), ("es-419", ("es-419", "Spanish (Neutral Latin American)")), ("FR-CA", ("fr-CA", "fr-CA")), ("es-ES", ("es-ES", "Spanish (Spain)")), ("es--es", ("es-ES", "Spanish (Spain)")), ("", ("", ""))]
    check(spark, language.language_tag, [(a, b[0]) for a, b in cases])
    check(spark, language.language_label, [(a, b[1]) for a, b in cases])
    assert [client.plain_label(a) for a, _ in cases] == [b[1] for _, b in cases]


def test_wire_encoding(spark):
    got = spark.createDataFrame([(1, "a\r\n<b> & \"c\" \u2028é")], "i long, t string").select(wire.encode_item(F.col("i"), F.col("t")).alias("x")).first()["x"]
    assert got == '{"idx":1,"text":"a\\n\\u003cb\\u003e \\u0026 \\"c\\" \\u2028é"}'


def test_replies():
    item = '{"idx":1,"text":"a"}'
    assert wire.parse_reply(f"```json\n{item}\n```") == [(1, "a")]
    assert wire.parse_reply(f'{item} {{"IDX":2,"Text":"b","x":{{}}}} tail') == [(1, "a"), (2, "b")]
    assert wire.parse_reply('[{"idx":3,"text":"c"}]') == [(3, "c")]
    assert wire.parse_reply('{"idx":10,"text":"They said "wait", then left"}') == [(10, 'They said "wait", then left')]
    assert wire.parse_reply(f'{item}\n{{"idx":2,"text":"x "y" z"}}\n{{"idx":3,"text":"{{c}}"}}') == [(1, "a"), (2, 'x "y" z'), (3, "{c}")]
    # a broken number is cut where it stops being whole, as mending reads digits only
    assert wire.parse_reply('{"idx":1.5,"text":"a"}') == [(1, "a")]
    for bad in ("", "```\n```", "[1]", '[{"idx":1,"text":"a"', '{"idx":0,"text":"a"}', '{"idx":1,"text":2}', "no items", '{"idx":1,"text":"never ends'):
        with pytest.raises(wire.WireError):
            wire.parse_reply(bad)


def test_sound_lines_are_read_as_they_are(monkeypatch):
    """One sound object a line is read without looking for objects; the items are those of the objects."""
    replies = ['{"idx":1,"text":"a {b} \\" c"}\n\n {"text":"\u00bb d","idx":2,"x":{"y":[{}]}} \n', '```json\n{"IDX":3,"Text":"\\ud800e\\ud83d\\ude00"}\n```', '{"idx":4}']
    want = [[wire._strict(o) for o in wire.objects(wire.unfenced(r).strip())] for r in replies]
    assert want == [[(1, 'a {b} " c'), (2, "\u00bb d")], [(3, "\ufffde\U0001f600")], [(4, "")]]
    two = '{"idx":1,"text":"a"} {"idx":2,"text":"b"}\n{"idx":3,\n"text":"c"}'
    assert wire.parse_reply(two) == [(1, "a"), (2, "b"), (3, "c")]
    monkeypatch.setattr(wire, "objects", lambda text: pytest.fail("looked for objects"))
    assert [wire.parse_reply(r) for r in replies] == want


def test_odd_replies(spark):
    for bad in ('{"idx":99999999999999999999,"text":"a"}', '{"idx":9223372036854775808,"text":"a"}', "[" * 100_000, '{"idx":1' + "0" * 5000 + ',"text":"a "b" c"}'):
        with pytest.raises(wire.WireError):
            wire.parse_reply(bad)
    assert wire.parse_reply('{"idx":9223372036854775807,"text":"a\\ud800b"}') == [(2**63 - 1, "a\ufffdb")]
    assert wire.parse_reply('{"idx":1,"text":"\\ud83d\\ude00 "x" \\udc00"}') == [(1, '😀 "x" \ufffd')]
    replies = ['{"idx":1,"text":"\\ud800"}', '{"idx":99999999999999999999,"text":"a"}', None, "[" * 100_000, '{"idx":2,"text":"b"}']
    assert apply(spark, wire.parse_ndjson, replies) == [[(1, "\ufffd")], None, None, None, [(2, "b")]]


def test_sound_replies_are_read_without_python(spark):
    """Natively read or not, a reply has the items that parse_reply() reads; which are read natively is stated."""
    sound = [
        '{"idx":1,"text":"a"}',
        '```json\n{"idx":1,"text":"a \\"b\\" \\u003ci\\u003e {c} \\\\"}\r\n\n{ "idx" : 12, "text" : "" }\n```',
        "\n" + "\n".join('{"idx":%d,"text":"%s"}' % (i, "x\\n" * 400) for i in range(1, 300)) + "\n \n",
        '{"idx":7,"text":"' + "y\\t" * 300_000 + '"}',
        '{"idx":999999999999999999,"text":"[1] ``` \\/ \u2028 😀"}',
    ]
    mended = [
        '{"idx":1,"text":"a"} {"idx":2,"text":"b"}',
        '{"text":"a","idx":1}',
        '{"idx":1,"te\\u0078t":"a"}',
        '{"idx":1,"text":"\\ud83d\\ude00"}',
        '{"idx":1\\n,"text":"a"}',
        '{"idx":01,"text":"a"}',
        '{"idx":0,"text":"a"}',
        '{"idx":1,"text":"a "b" c"}',
        '{"idx":1,"text":"a"}\nthat is all',
        '```\n{"idx":1,"text":"a ``` b"}',
        '[{"idx":1,"text":"a"}]',
        "``````",
        "",
    ]

    def want(reply):
        try:
            return wire.parse_reply(reply)
        except wire.WireError:
            return None

    rows = spark.createDataFrame([(i, r) for i, r in enumerate([*sound, *mended, None])], "n long, reply string")
    got = {r.n: (r.native, r.items) for r in wire.read_replies(rows.withColumn("native", wire.sound_items(F.col("reply"))), F.col("reply")).collect()}
    assert [n for n in got if got[n][0] is not None] == list(range(len(sound)))
    for n, reply in enumerate([*sound, *mended]):
        assert (got[n][1] and [tuple(x) for x in got[n][1]]) == want(reply), reply[:80]
        if n < len(sound):
            assert got[n][0] == got[n][1]
    assert got[len(sound) + len(mended)] == (None, None)


def test_white_space(spark):
    """Every character of White_Space is trimmed, splits words, and is one space within a line; long runs take no longer."""
    odd = [c for c in text.WHITE_SPACE if c != "\n"]
    assert len(text.WHITE_SPACE) == 25
    check(spark, text.clean_text, [(f"{c}a{c}b{c}\n{c}\n{c}c", f"a{c}b\nc") for c in odd])
    check(spark, text.one_space, [(f"a{c}b{c}{c}c", "a b c") for c in odd] + [("a b", "a b"), ("a\n b", "a\n b"), ("“q” — r", "“q” — r")])
    check(spark, lambda c: layout.wrap_lines(c, 7), [(f"aa{c}bb{c}cccc", "aa bb\ncccc") for c in odd])
    long = "a" + " \t" * 200_000 + "b"
    assert apply(spark, lambda c: layout.wrap_lines(text.clean_text(c)), [long, "\n" + " " * 400_000 + "x"]) == ["a b", "x"]


def test_wrapping_is_greedy(spark):
    """Against a loop over words, with words of more bytes than characters and words that are too long."""
    rng = random.Random(7)
    texts = ["".join(rng.choice(["a", "bb", "é", "♪♪", "😀", " ", "  ", "\n", "\u2003", "x" * 12, "<i>", "<b x>\n", "\r\n"]) for _ in range(rng.randint(0, 40))) for _ in range(2000)]

    def loop(whole):
        out = []
        for line in whole.split("\n"):
            line = line.strip(text.WHITE_SPACE)
            if line.startswith("<") and line.endswith(">"):
                out.append(line)
                continue
            held = ""
            for word in re.split(f"[{re.escape(text.WHITE_SPACE)}]+", line):
                both = f"{held} {word}" if held else word
                if held and len(both.encode()) > 10:
                    out.append(held)
                    both = word
                held = both
            out.append(held)
        return "\n".join(x for x in out if x)

    assert apply(spark, lambda c: layout.wrap_lines(c, 10), texts) == [loop(x) for x in texts]


def test_sleep_can_be_cancelled():
    cancel = threading.Event()
    sleep = client.sleeper(cancel)
    sleep(0.001)
    threading.Timer(0.05, cancel.set).start()
    began = time.monotonic()

    def fails():
        raise client.Retryable("again", 60)

    with pytest.raises(client.Cancelled):
        client.with_retry(fails, 3, sleep=sleep)
    assert time.monotonic() - began < 10


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("SELECT clean_text(' a \\r\\n\\n b ') a, is_decorative_line('- -') b, format_time(3723004) c, mask_key('abcd') d, strip_style('<i>x</i>') e").first()
    assert tuple(row) == ("a\nb", True, "01:02:03,004", "a**d", "x")


def test_client():
    assert [client.backoff(n, jitter=0) for n in (0, 1, 2, 5, 9)] == [0.5, 0.5, 1.0, 8.0, 10.0]
    assert client.backoff(1, draw=lambda: 1.0) == pytest.approx(0.6)
    assert [client.retry_after(x) for x in ("3", "x", "-1", None)] == [3.0, 0.0, 0.0, 0.0]
    assert [n for n in range(100, 700) if client.is_retryable_status(n)] == [429, *range(500, 600)] and [n for n in range(100, 700) if client.is_rejected_status(n)] == [401, 403, 429]
    assert [client.retry_after(x) for x in (" 12 ", "0", "1.5", "Fri, 31 Dec 1999", "")] == [12.0, 0.0, 0.0, 0.0, 0.0]
    assert client.join_url("https://h:8/a/../b", "/v1/x") == "https://h:8/b/v1/x" and client.base_url(" GPT-4o ") == "https://api.openai.com"
    assert client.base_url("gpt-x") and client.base_url("m", "http://h/") == "http://h/"
    with pytest.raises(ValueError):
        client.base_url("m")
    assert client.join_url("http://h/", "/v1/x") == "http://h/v1/x" and client.join_url("http://h/a//", "v1/x") == "http://h/a/v1/x"
    for empty in ("", " ", "//"):
        with pytest.raises(ValueError):
            client.join_url(empty, "x")
    used, slept = [], []

    def send(url, key, body, timeout):
        used.append(key)
        return (429, {"Retry-After": "2"}, "") if key == "bad" else (200, {}, '{"choices":[{"message":{"content":" ok "}}]}')

    ask = client.ChatClient(TranslateOptions("es", "gpt-x", api_keys=" bad , ,good,"), send, slept.append)
    assert [ask("p"), ask("p")] == ["ok", "ok"] and used == ["bad", "good", "bad", "good"] and slept == []
    alone = client.ChatClient(TranslateOptions("es", "gpt-x", api_keys="bad", retry_max_attempts=2), send, slept.append)
    with pytest.raises(client.Retryable):
        alone("p")
    assert slept == [2.0]


def test_environment(monkeypatch):
    monkeypatch.setenv("CUE_STRIP_HI", "yes")
    monkeypatch.setenv("CUE_SHIFT_NS", "1s")
    monkeypatch.setenv("CUE_MAX_LINE_LENGTH", " ")
    got = resolved(FixOptions(), "cue")
    assert got.strip_hi and got.shift_ns == 10**9 and got.max_line_length == 70
    assert resolved(FixOptions(), "cue", {"strip_hi"}).strip_hi is False
    monkeypatch.setenv("CUE_STRIP_HI", "maybe")
    with pytest.raises(ValueError):
        resolved(FixOptions(), "cue")
