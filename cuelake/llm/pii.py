"""Personal data: base patterns, and a skip-chain conditional random field that adds what they miss.

The base patterns are matched leftmost and without overlap; a failing match is dropped and not tried again. The field's
nodes are the number-like and address-like tokens of a document. A linear chain joins neighbours, skip edges join tokens
whose folded forms are equal or that differ in one character of eight or more, and loopy sum-product messages make their
labels agree. Nodes inside base spans are clamped to their kind. A free node whose belief passes the threshold becomes a
span: what the patterns lose to no retries (two cards side by side, a number behind a phone's), to other forms of a number
seen elsewhere, and mentions that agree among themselves. The field runs on every document that has free nodes.

The weights of node features, of the chain's label pairs and of both kinds of skip edges are fitted together by train() on
a bounded sample of rows, labelled by the base patterns. Those below are its result on the 10,000 documents of sf0.1. Skip
edges form stars round the first mention of a form, so their number is linear in the tokens.

Null and empty texts have no spans; every row gives one row, repeated rows too; null ids are kept; other columns are
ignored. Matching is linear in a text's length, so that very long runs cost no more than other text.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import common

KINDS = ("email", "ip", "card", "phone")
_ORDER = {k: i for i, k in enumerate(KINDS)}
_LOCAL = "[A-Za-z0-9._%+-]"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_RUN = re.compile(_LOCAL + r"+\Z")
_DIGITS = re.compile("[0-9]")

Span = tuple[str, int, int]


def _local_start(text: str, at: int, low: int) -> int:
    """Where the run of local characters that ends at `at` begins, not before low."""
    start = at
    while start > low and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
        start -= 1
    return start


def emails(text: str) -> list[Span]:
    out: list[Span] = []
    low, at = 0, text.find("@")
    while at >= 0:
        start = _local_start(text, at, low)
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append(("email", start, domain.end()))
        low = domain.end() if domain else at + 1
        at = text.find("@", low)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """All base spans, by kind as listed, then start."""
    out = emails(text) if "@" in text else []
    if not _DIGITS.search(text):
        return out
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


# The field.

LABELS = ("none", *KINDS)
K = len(LABELS)
#: Log-potentials of each feature for LABELS; of the chain's label pairs; of equal labels along skip edges between equal and
#: similar forms. As train() gave them on the documents of sf0.1.
WEIGHTS: dict[str, np.ndarray] = {
    name: np.array(row)
    for name, row in {
        "after_edge": (-0.054, -0.017, -0.203, 0.1, 0.174),
        "after_mark": (0.286, -0.133, 0.375, -0.14, -0.388),
        "after_space": (0.272, 0.059, -0.282, -0.073, 0.024),
        "at": (-1.246, 3.064, -0.624, -0.594, -0.6),
        "at_dot": (-0.67, 1.757, -0.37, -0.36, -0.357),
        "before_edge": (-0.019, 0.008, -0.181, 0.096, 0.096),
        "before_space": (0.522, -0.098, 0.07, -0.209, -0.286),
        "bias": (0.503, -0.09, -0.111, -0.113, -0.19),
        "digits_16_19": (0.961, -1.136, -1.088, 2.309, -1.046),
        "digits_8_15": (-1.166, -1.395, 1.878, -1.272, 1.956),
        "digits_other": (1.954, -0.624, -0.276, -0.555, -0.499),
        "luhn": (-1.626, -0.291, -0.272, 2.45, -0.262),
        "plus": (-0.775, -0.288, -1.143, -0.262, 2.469),
        "quad": (-0.854, -0.281, 2.727, -0.25, -1.342),
        "unlike_luhn": (2.777, -0.359, -0.335, -1.756, -0.327),
        "unlike_quad": (3.224, -0.252, -1.416, -0.24, -1.315),
        "word_a": (-0.024, 0.018, -0.102, -0.021, 0.129),
        "word_and": (-0.023, 0.014, -0.044, -0.068, 0.121),
        "word_de": (-0.177, 0.055, -0.031, 0.171, -0.018),
        "word_der": (0.002, -0.027, -0.001, -0.033, 0.059),
        "word_en": (-0.039, 0.038, -0.151, -0.032, 0.183),
        "word_eror": (0.073, 0.013, 0.049, -0.055, -0.08),
        "word_et": (0.065, 0.025, 0.303, -0.095, -0.298),
        "word_for": (-0.024, -0.013, -0.161, 0.009, 0.189),
        "word_in": (-0.029, 0.004, 0.041, 0.061, -0.077),
        "word_of": (-0.128, 0.014, 0.085, 0.167, -0.138),
        "word_that": (-0.024, 0.031, 0.011, 0.011, -0.028),
        "word_the": (0.026, -0.02, 0.156, 0.02, -0.184),
        "word_to": (-0.014, 0.031, 0.023, -0.016, -0.023),
        "word_was": (0.051, 0.018, -0.193, -0.111, 0.235),
        "word_with": (-0.083, 0.037, 0.033, 0.069, -0.056),
    }.items()
}
CHAIN = np.array(
    [
        (0.0, -0.346, -0.245, -1.201, -0.431),
        (0.181, -0.031, -0.046, -0.402, 0.126),
        (0.128, 0.02, 0.24, -0.326, 0.544),
        (0.871, 0.398, 0.383, -0.334, 0.168),
        (0.073, -0.054, 0.144, -0.29, 0.429),
    ]
)
SKIPS = (3.856, 1.24)
#: The belief that makes a span, and the most rounds of messages.
BELIEF, ROUNDS = 0.9, 30
_WORD = r"[^\s@,;:<>\"'|=/]"
_WORD_CHAR, _WORD_RUN = re.compile(_WORD), re.compile(_WORD + "+")
#: Numbers as they are written: with a plus and groups, groups between spaces, or digits with single dots and dashes. A run
#: is tried at its first digit only.
_NUMBER = re.compile(
    r"(?<![0-9A-Za-z])(?<![0-9][.-])(?:\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:(?:[\x20.-]?[0-9]{3,4}){1,3}|(?:[\x20.-]?[0-9]{2}){3,5})(?![0-9A-Za-z])"
    r"|[0-9]{1,4}(?:\x20(?:\([0-9]{1,4}\)|[0-9]{2,4})){2,4}(?![0-9A-Za-z.-])|[0-9]{4}(?:-[0-9]{4}){3}(?![0-9A-Za-z])|[0-9]++(?:[.-][0-9]++)*+(?![0-9A-Za-z]))"
)
#: Features that tell a kind by itself; training hides them at times, so that mentions and neighbours have to tell it.
EVIDENCE = ("at_dot", "at_bare", "quad", "unlike_quad", "luhn", "unlike_luhn", "plus", "unlike_plus")
#: A word counts as context if it stands before so many of the sample's tokens.
LEAST_CONTEXT = 20


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    """Words joined by an @, and numbers, leftmost and without overlap; at the same start the former."""
    at, sign = 0, text.find("@")
    number = _NUMBER.search(text)
    while True:
        after = _WORD_RUN.match(text, sign + 1) if sign >= 0 else None
        if sign >= 0 and not after:
            sign = text.find("@", sign + 1)
            continue
        start = sign
        while start > at and _WORD_CHAR.match(text, start - 1):
            start -= 1
        while number and (sign < 0 or number.start() < start):
            yield number.span()
            at = number.end()
            start = max(start, at)
            number = _NUMBER.search(text, at)
        if sign < 0:
            return
        if start < sign:
            yield start, after.end()
            at = after.end()
            if number and number.start() < at:
                number = _NUMBER.search(text, at)
        sign = text.find("@", sign + 1)


def nodes(text: str) -> list[tuple[int, int]]:
    """Spans of the tokens that can be personal data: those with an @, and numbers of six digits or more."""
    return [(a, b) for a, b in _tokens(text) if "@" in text[a:b] or sum(c.isdigit() for c in text[a:b]) >= 6]


def folded(token: str) -> str:
    return token.lower().strip(".-_") if "@" in token else "".join(c for c in token if c.isdigit())


def _side(c: str) -> str:
    return "edge" if not c or c == "\n" else "space" if c.isspace() else "quote" if c in "\"'=" else "mark"


def features(text: str, start: int, end: int) -> list[str]:
    """Of the token's form, and of what stands round it."""
    token, before = text[start:end], text[max(0, start - 40) : start]
    word = before.split()[-1:] if before else []
    out = ["bias", f"before_{_side(before[-1:])}", f"after_{_side(text[end : end + 1])}", *[f"word_{w.lower()}" for w in word if w.isalpha()]]
    if "@" in token:
        return out + ["at", "at_dot" if "." in token.rpartition("@")[2].strip(".") else "at_bare"]
    digits = folded(token)
    n = len(digits)
    out.append("digits_8_15" if 8 <= n <= 15 else "digits_16_19" if 16 <= n <= 19 else "digits_other")
    parts = token.split(".")
    if len(parts) == 4:
        out.append("quad" if all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts) else "unlike_quad")
    if 16 <= n <= 19:
        out.append("luhn" if luhn(digits) else "unlike_luhn")
    elif 8 <= n <= 15 and len(parts) != 4:
        out.append("plus" if token.startswith("+") else "unlike_plus")
    return out


def spoiled(text: str) -> str:
    """text with other digits and without the plus signs: numbers in most of the same places, of which few are personal data."""
    return text.translate(str.maketrans("0123456789", "3698250147", "+"))


def skip_edges(forms: list[str]) -> list[tuple[int, int, bool]]:
    """(node, node, whether equal): stars of equal forms round their first mention, and of forms that differ in one place
    round the first of them."""
    first: dict[str, int] = {}
    edges, near = [], {}
    for i, form in enumerate(forms):
        if form in first:
            edges.append((first[form], i, True))
            continue
        first[form] = i
        if len(form) >= 8:
            linked = set()
            for k in range(len(form)):
                hole = f"{form[:k]}\0{form[k + 1 :]}"
                if (j := near.setdefault(hole, i)) != i and j not in linked:
                    linked.add(j)
                    edges.append((j, i, False))
    return edges


def beliefs(unary: np.ndarray, edges: np.ndarray, potentials: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(label beliefs of the nodes, of the edges' label pairs) after damped loopy sum-product messages.

    unary: log-potentials (nodes, K); edges: (edges, 2) nodes; potentials: log (edges, K, K) of the first and second label."""
    n, e = len(unary), len(edges)
    source, goal = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    table = np.exp(np.concatenate([potentials, potentials.transpose(0, 2, 1)]))
    back = np.concatenate([np.arange(e, 2 * e), np.arange(e)])
    messages = np.full((2 * e, K), 1.0 / K)

    def totals() -> np.ndarray:
        out = unary.copy()
        np.add.at(out, goal, np.log(messages))
        return out

    def cavities() -> np.ndarray:
        left = totals()[source] - np.log(messages[back])
        return np.exp(left - left.max(axis=1, keepdims=True))

    for _ in range(rounds if e else 0):
        new = np.einsum("ei,eij->ej", cavities(), table)
        new = 0.5 * messages + 0.5 * new / new.sum(axis=1, keepdims=True)
        moved = np.abs(new - messages).max()
        messages = np.maximum(new, 1e-30)
        if moved < 1e-5:
            break
    node = totals()
    node = np.exp(node - node.max(axis=1, keepdims=True))
    pair = np.zeros((0, K, K))
    if e:
        held = cavities()
        pair = held[:e, :, None] * table[:e] * held[e:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
    return node / node.sum(axis=1, keepdims=True), pair


@dataclass
class Graph:
    """A document's tokens, the label that each is clamped to (-1: free), their features, and edges with what they are:
    0 for the chain, 1 for equal forms, 2 for similar ones."""

    spans: list[tuple[int, int]]
    clamped: list[int]
    features: list[list[str]]
    edges: list[tuple[int, int, int]]


def document_graph(text: str, base: list[Span]) -> Graph:
    spans = nodes(text)
    ordered = sorted(base, key=lambda s: s[1])
    clamped, at = [], 0
    for start, end in spans:
        while at < len(ordered) and ordered[at][2] <= start:
            at += 1
        # ordered[at] is the first to end beyond the start: if it begins beyond the end, so do all after it
        inside = [s for s in ordered[at : at + 4] if s[1] < end and start < s[2]]
        clamped.append(1 + _ORDER[inside[0][0]] if inside else -1)
    edges = [(i, i + 1, 0) for i in range(len(spans) - 1)]
    skips = [(i, j, 1 if same else 2) for i, j, same in skip_edges([folded(text[a:b]) for a, b in spans])]
    return Graph(spans, clamped, [features(text, a, b) for a, b in spans], edges + skips)


def _potentials(edges: np.ndarray, chain: np.ndarray, skips: tuple[float, float]) -> np.ndarray:
    """(edges, K, K) log-potentials by what each edge is."""
    table = np.stack([chain, skips[0] * np.eye(K), skips[1] * np.eye(K)])
    return table[edges[:, 2]]


def _edges(graph: Graph) -> np.ndarray:
    return np.array(graph.edges, np.int64).reshape(-1, 3)


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """Spans that the field adds; they overlap no base span."""
    graph = document_graph(text, base)
    if all(c >= 0 for c in graph.clamped):
        return []
    nothing = np.zeros(K)
    unary = np.array([sum((WEIGHTS[f] for f in fs if f in WEIGHTS), nothing) for fs in graph.features])
    for i, c in enumerate(graph.clamped):
        if c >= 0:
            unary[i] = np.where(np.arange(K) == c, 30.0, -30.0)
    edges = _edges(graph)
    got, _ = beliefs(unary, edges[:, :2], _potentials(edges, CHAIN, SKIPS))
    return [(LABELS[int(row.argmax())], *span) for span, c, row in zip(graph.spans, graph.clamped, got, strict=True) if c < 0 and row[1:].max() >= BELIEF]


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by kind as listed, then start."""
    text = text or ""
    base = base_spans(text)
    return base, sorted([*base, *added_spans(text, base)], key=lambda s: (_ORDER[s[0]], s[1]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def mask(text: str | None) -> str | None:
    """text with each span replaced by its kind in angle brackets; of overlapping spans the first and longest wins."""
    if not text:
        return text
    out, at = [], 0
    for kind, start, end in sorted(find(text)[1], key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
            at = end
        elif end > at:  # the rest of a span that began inside another one goes as well
            at = end
    return "".join(out) + text[at:]


def misspelt(text: str) -> str:
    """text with one character of each token changed: the last digit, or the letter before an @."""
    out = list(text)
    for start, end in nodes(text):
        at = text.rfind("@", start, end) - 1 if "@" in text[start:end] else max(i for i in range(start, end) if text[i].isdigit())
        out[at] = str((int(out[at]) + 1) % 10) if out[at].isdecimal() and out[at].isascii() else "x"
    return "".join(out)


def train(rows: list[str], steps: int = 400, rate: float = 2.0, decay: float = 0.0005, hidden: float = 0.4, seed: int = 5) -> tuple[dict[str, np.ndarray], np.ndarray, tuple[float, float]]:
    """(node weights, chain, skips), fitted together: gradient ascent on the field's likelihood, whose expectations are
    loopy beliefs. The caller bounds rows. Labels are the base patterns'; a token that no pattern takes is "none". Every text
    is taken as it is, spoiled(), and written twice, in the same way or misspelt(), these with a share of the tokens' evidence
    hidden, so that what one mention shows has to reach the others by the edges."""
    rng = random.Random(seed)
    found: list[list[str]] = []
    labels: list[int] = []
    edges: list[tuple[int, int, int]] = []
    for text in rows:
        if not nodes(text):
            continue
        for given, share in ((text, 0.0), (spoiled(text), 0.0), (f"{text}\n{text}", hidden), (f"{text}\n{misspelt(text)}", hidden)):
            graph = document_graph(given, base_spans(given))
            edges += [(i + len(labels), j + len(labels), k) for i, j, k in graph.edges]
            labels += [max(0, c) for c in graph.clamped]
            found += [[f for f in fs if f not in EVIDENCE] if rng.random() < share else fs for fs in graph.features]
    seen = Counter(f for fs in found for f in set(fs))
    names = sorted(f for f, n in seen.items() if n >= LEAST_CONTEXT or not f.startswith("word_"))
    place = {f: i for i, f in enumerate(names)}
    design = np.zeros((len(found), len(names)))
    for i, fs in enumerate(found):
        for f in fs:
            if f in place:
                design[i, place[f]] = 1
    lab, links, n = np.array(labels, np.int64), np.array(edges, np.int64).reshape(-1, 3), max(1, len(labels))
    want = np.eye(K)[lab]
    of = [links[:, 2] == k for k in range(3)]
    pairs = np.zeros((len(links), K, K))
    pairs[np.arange(len(links)), lab[links[:, 0]], lab[links[:, 1]]] = 1
    weights, chain, skips = np.zeros((len(names), K)), np.zeros((K, K)), np.zeros(2)
    for _ in range(steps):
        node, pair = beliefs(design @ weights, links[:, :2], _potentials(links, chain, tuple(skips)))
        weights += rate * (design.T @ (want - node) / n - decay * weights)
        more = pairs - pair
        chain += rate * (more[of[0]].sum(axis=0) / n - decay * chain)
        skips += rate * (np.array([np.trace(more[of[k]].sum(axis=0)) for k in (1, 2)]) / n - decay * skips)
    return {f: w.round(3) for f, w in zip(names, weights, strict=True)}, chain.round(3), tuple(float(x) for x in skips.round(3))


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans), a row for each of df's."""

    def row(key, text):
        base, spans = find(text)
        return key, *(sum(s[0] == k for s in base) for k in KINDS), common.sha256(written(base)), written(spans)

    names = [f"n_{k}" for k in KINDS]
    return common.map_rows(df, [id_col, text_col], row, f"{id_col} long, {', '.join(f'{n} long' for n in names)}, base_sha256 string, spans string", [(id_col, pa.int64()), *((n, pa.int64()) for n in names), ("base_sha256", pa.string()), ("spans", pa.string())])


def masked(df: DataFrame) -> DataFrame:
    """df with the spans of its text masked and n_chars, where df has it, counted anew."""

    @F.pandas_udf("string")
    def cover(texts):
        return texts.map(mask, na_action="ignore")

    out = df.withColumn("text", cover(df["text"]))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in df.columns else out


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(common.load(spark, sf_dir, "documents"))
