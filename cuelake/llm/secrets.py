"""Secret scans through a trigram inverted index, with DataFrame functions only.

From each rule's pattern trigram_query() derives a Boolean query: a set of alternatives, each a set of trigrams that every
match of it must hold. The index has a posting (trigram, document) for each trigram that some query names. Intersecting
the postings of an alternative gives candidates; those are verified with the pattern. Rules whose pattern has no mandatory
trigram are matched against every text. Matching is leftmost and without overlap for each rule; a match that is too short
is dropped and not tried again. Positions are code points, end exclusive.

A row is told by id and a 64-bit hash of its text, so repeated rows share their postings and each give a row; null ids are
kept; null and empty texts have no matches; other columns are ignored. No key of an exchange has more rows than one
document has postings, so no group grows with the corpus.
"""

from __future__ import annotations

import re._constants as ops
import re._parser as parser
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import common


@dataclass(frozen=True)
class Rule:
    """pattern: in the dialect that Java and Python share; least: code points that `group` has at least; base: one of the contract's."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: The base rules, in their order, then common formats of keys.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0123456789abcdef]{24,}", 0, 24, True),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

#: Candidates, of some 60 bytes each, that are broadcast at most.
BROADCAST_ROWS = 500_000
#: Sets and branches are followed up to so many alternatives; beyond, a place counts as unknown.
MAX_ALTERNATIVES = 64
_MAX_SET = 8


def _strings(tree) -> list[tuple[str | None, ...]]:
    """What the pattern's matches spell, as alternatives: characters in order, None where anything may stand."""
    out: list[tuple[str | None, ...]] = [()]
    for op, arg in tree:
        if op is ops.LITERAL:
            more = [(chr(arg).lower(),)]
        elif op is ops.IN and len(arg) <= _MAX_SET and all(o is ops.LITERAL for o, _ in arg):
            more = sorted({(chr(c).lower(),) for _, c in arg})
        elif op is ops.BRANCH:
            more = [s for branch in arg[1] for s in _strings(branch)]
        elif op is ops.SUBPATTERN:
            more = _strings(arg[3])
        elif op is ops.MAX_REPEAT:
            low, high, inner = arg
            once = _strings(inner)
            if (low, high) == (0, 1):
                more = [(), *once]
            elif low >= 1:
                more = [(*s, *[None] * (high != 1)) for s in once]
            else:
                more = [(None,)]
        elif op in (ops.ASSERT, ops.ASSERT_NOT, ops.AT):
            more = [()]
        else:
            more = [(None,)]
        if len(out) * len(more) > MAX_ALTERNATIVES:
            more = [(None,)]
        out = [a + b for a in out for b in more]
    return out


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of mandatory lower-case trigrams, without those that another one implies; empty: scan fully."""
    found = set()
    for s in _strings(parser.parse(pattern)):
        found.add(frozenset("".join(s[i : i + 3]) for i in range(len(s) - 2) if None not in s[i : i + 3]))
    if frozenset() in found:
        return []
    return sorted((a for a in found if not any(b < a for b in found)), key=sorted)


def postings(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The inverted index: (trigram, doc_id, text_key), distinct for each row of df. A text is lower-cased once, and the
    searches run in generated code."""
    terms = sorted({t for r in rules for q in trigram_query(r.pattern) for t in q})
    low = df.select("doc_id", F.xxhash64("text").alias("text_key"), F.lower("text").alias("low"))
    found = low.select("doc_id", "text_key", F.explode(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in terms])).alias("trigram"))
    return found.filter("trigram is not null").select("trigram", "doc_id", "text_key")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, text_key, rules): documents whose postings satisfy an alternative, by intersecting posting lists."""
    clauses = [(r.kind, n, t, len(q)) for r in rules for n, q in enumerate(trigram_query(r.pattern)) for t in sorted(q)]
    # bounded by the rules: a few hundred rows
    wanted = F.broadcast(index.sparkSession.createDataFrame(clauses, "kind string, clause int, trigram string, needed int"))
    hit = index.join(wanted, "trigram").groupBy("doc_id", "text_key", "kind", "clause", "needed").agg(F.collect_set("trigram").alias("got"))
    return hit.filter(F.size("got") == F.col("needed")).groupBy("doc_id", "text_key").agg(F.collect_set("kind").alias("rules"))


def _running(x: Column) -> Column:
    """The sums of x's elements (bigints) up to each place: at every step each element takes what stands so far before it, twice
    as far each time, so n elements take log n steps."""
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda far: far < F.size(x))
    return F.aggregate(steps, x, lambda sums, far: F.transform(sums, lambda v, i: v + F.coalesce(F.get(sums, i - far), F.lit(0).cast("bigint"))))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _matches(rule: Rule) -> Column:
    """array<struct<start, rank, kind, end>> of a rule's matches in text: the pieces between matches tell where they are."""
    rank = RULES.index(rule) if rule in RULES else len(RULES)
    whole, wanted = (F.transform(F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(g)), F.length) for g in (0, rule.group))
    gaps = F.transform(F.split("text", rule.pattern, -1), F.length)

    def spans(found: Column) -> Column:
        ends = _running(F.zip_with(found["gaps"], found["whole"], lambda a, b: (a + F.coalesce(b, F.lit(0))).cast("bigint")))
        # the last gap has no match after it, so no wanted length either
        long = F.filter(F.arrays_zip(found["whole"].alias("whole"), found["wanted"].alias("wanted"), ends.alias("end")), lambda m: m["wanted"] >= rule.least)
        return F.transform(long, lambda m: F.struct((m["end"] - m["whole"]).alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), m["end"].alias("end")))

    return _with(F.struct(gaps.alias("gaps"), whole.alias("whole"), wanted.alias("wanted")), spans)


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(df: DataFrame, rules: tuple[Rule, ...] = RULES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, n_<base kind>..., base_sha256, spans), a row for each of df's. Up to broadcast_rows candidates go to the
    texts, so that no text moves; more are joined by exchange."""
    nothing = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    texts = df.select("doc_id", F.coalesce(df["text"], F.lit("")).alias("text"))
    found = common.durable(candidates(postings(texts, rules), rules).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "rules"))
    if found.count() <= broadcast_rows:
        found = F.broadcast(found)
    keyed = texts.withColumn("text_key", F.xxhash64("text"))
    both = keyed.join(found, keyed["doc_id"].eqNullSafe(found["_id"]) & (keyed["text_key"] == found["_key"]), "left")
    columns = {}
    for r in rules:
        if trigram_query(r.pattern):
            columns[r.kind] = F.when(F.array_contains(F.coalesce("rules", F.array().cast("array<string>")), r.kind), _matches(r)).otherwise(nothing)
        else:
            columns[r.kind] = F.when(F.col("text").rlike(r.pattern), _matches(r)).otherwise(nothing)
    spans = both.select("doc_id", *[c.alias(k) for k, c in columns.items()])
    base = [r.kind for r in rules if r.base]
    joined = lambda kinds: reduce(lambda a, b: F.concat(a, b), [F.col(k) for k in kinds])
    return spans.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in base], F.sha2(_written(joined(base)), 256).alias("base_sha256"), _written(joined([r.kind for r in rules])).alias("spans"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.load(spark, sf_dir, "documents"))
