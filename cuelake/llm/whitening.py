"""Embedding whitening: exact scatter in tasks, cyclic Jacobi rotations on the driver, projections in tasks.

A vector's entries c become the long x = floor(1024 * c) + 100000, held to the range of +-2**46, so that all sums are whole
numbers within decimal(38, 0). One pass sums x; a second one the products of z = x minus the mean rounded to a whole
number: centred before it is multiplied, and yet whole. The covariance is (n * sum z z' - sum z sum z') / n**2 of these sums,
so it doesn't depend on how rows are dealt, and is rounded once. What comes to the driver is one number for each pair of
dimensions, however many vectors there are.

jacobi() takes that symmetric matrix and rotates pairs of dimensions, each pair once a sweep and those of a round at once as
they have none in common, until each off-diagonal entry vanishes beside its two diagonal ones; this gives small eigenvalues to
their own precision. The whitening matrix has an eigenvector over the root of its value in each column, by falling value,
the largest entry of each positive; tasks get it in their closure.

Rows whose vector is null or holds null or non-finite entries go. Vectors of another length than most (of equally many, the
longest) go too. Repeated rows and null vec_ids stay; other columns are ignored. Components without variance (below
d * 2**-52 of the largest) have whitened 0 and explained 0. deviation is null where it doesn't fit a long, deviation_exact
tells it up to 38 digits. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import common

#: An entry's scale and offset, and how many components are told.
SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
#: Beyond this, entries are held to it.
MOST = 1 << 46
#: Rows whose products are summed at once.
BLOCK_ROWS = 2048
_EPS = 2.0**-52
_WHOLE = pa.decimal128(38, 0)


@dataclass(frozen=True)
class Fit:
    """Of the fit list: n vectors, the sums of x, its covariance's eigenvalues by falling size, eigenvectors in columns, and trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def whole(self) -> np.ndarray:
        """Which components have variance."""
        return self.values > len(self.values) * _EPS * max(self.values.max(initial=0.0), 0.0)

    def matrix(self, components: int) -> np.ndarray:
        """(d, components): what a centred vector is multiplied with."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.whole, self.vectors / np.sqrt(np.maximum(self.values, 0.0)), 0.0)[:, :components]


def entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(rows' lengths, which rows are sound, [(places, x)]): the vectors of a batch as longs, those of each length together."""
    column = column.cast(pa.list_(pa.float64()))
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()  # null entries become nan
    c = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.r_[0, np.cumsum(~np.isfinite(c))]
    ends = np.cumsum(lengths)
    sound = (bad[ends] == bad[ends - lengths]) & column.is_valid().to_numpy(zero_copy_only=False).astype(bool)
    out = []
    for d in np.unique(lengths[sound]).tolist():
        places = np.flatnonzero(sound & (lengths == d))
        at = (ends[places] - d)[:, None] + np.arange(d)
        out.append((places, np.clip(np.floor(c[at] * SCALE), -MOST, MOST).astype(np.int64) + OFFSET))
    return lengths, sound, out


def products(z: np.ndarray) -> np.ndarray:
    """z'z in whole numbers, as Python's: by floating-point blocks while those are exact, by Python's numbers beyond."""
    most = int(np.abs(z).max(initial=0))
    if most < 1 << 26:
        rows = max(1, min(len(z), (1 << 53) // max(1, most * most)))
        total = np.zeros((z.shape[1], z.shape[1]), object)
        for at in range(0, len(z), rows):
            part = z[at : at + rows].astype(np.float64)
            total += (part.T @ part).astype(np.int64).astype(object)
        return total
    wide = z.astype(object)
    return wide.T @ wide


def sums(df: DataFrame) -> tuple[int, list[int]]:
    """(n, sum of x for each dimension) of the vectors of the commonest length; (0, []) if there are none."""
    schema = pa.schema([("d", pa.int64()), ("i", pa.int64()), ("total", _WHOLE)])

    def rows(held: dict[int, np.ndarray]) -> pa.RecordBatch:
        # n stands in place -1
        got = [(d, i - 1, int(v)) for d, total in held.items() for i, v in enumerate(total)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                for places, x in entries(batch.column(0).slice(at, BLOCK_ROWS))[2]:
                    # at most 2**11 rows of less than 2**47
                    held[x.shape[1]] = held.get(x.shape[1], 0) + np.r_[len(places), x.sum(axis=0)].astype(object)
                if len(held) > 64:
                    yield rows(held)
                    held = {}
        if held:
            yield rows(held)

    told = df.select("embedding").mapInArrow(run, "d long, i long, total decimal(38,0)").groupBy("d", "i").agg(F.sum("total").alias("total"))
    told = common.durable(told)
    best = told.filter("i = -1").orderBy(F.desc("total"), F.desc("d")).first()
    if best is None:
        return 0, []
    got = {r["i"]: int(r["total"]) for r in told.filter(F.col("d") == best["d"]).collect()}
    return got[-1], [got[i] for i in range(best["d"])]


def covariance(df: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """Of the vectors that sums() counted."""
    d = len(total)
    centre = np.array([(2 * s + n) // (2 * n) for s in total], np.int64)
    upper = np.triu_indices(d)
    schema = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("total", _WHOLE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = np.zeros((d, d), object), False
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                for _, x in entries(batch.column(0).slice(at, BLOCK_ROWS))[2]:
                    if x.shape[1] == d:
                        held += products(x - centre)
                        seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int64()), pa.array(upper[1], pa.int64()), pa.array(held[upper].tolist(), _WHOLE)], schema=schema)

    scatter = np.zeros((d, d), object)
    for r in df.select("embedding").mapInArrow(run, "i long, j long, total decimal(38,0)").groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
        scatter[r["i"], r["j"]] = scatter[r["j"], r["i"]] = int(r["total"])
    left = np.array([s - n * int(c) for s, c in zip(total, centre, strict=True)], object)
    whole = n * scatter - np.multiply.outer(left, left)
    return np.array([[v / (n * n) for v in row] for row in whole.tolist()], np.float64).reshape(d, d)


def _rounds(d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of d dimensions in rounds of pairs that have none in common."""
    ring = list(range(d + d % 2))
    for _ in range(len(ring) - 1):
        pairs = [(min(p, q), max(p, q)) for p, q in zip(ring[: len(ring) // 2], ring[::-1], strict=False) if max(p, q) < d]
        yield np.array([p for p, _ in pairs], np.int64), np.array([q for _, q in pairs], np.int64)
        ring = [ring[0], ring[-1], *ring[1:-1]]


def jacobi(matrix: np.ndarray, most_sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues by falling size, eigenvectors in columns, the largest entry of each positive) of a symmetric matrix."""
    a, d = matrix.astype(np.float64).copy(), len(matrix)
    v = np.eye(d)
    rounds = list(_rounds(d)) if d > 1 else []
    for _ in range(most_sweeps):
        turned = False
        for p, q in rounds:
            app, aqq, apq = a[p, p], a[q, q], a[p, q]
            on = np.abs(apq) > _EPS * np.sqrt(np.abs(app * aqq))
            if not on.any():
                continue
            turned = True
            p, q, app, aqq, apq = p[on], q[on], app[on], aqq[on], apq[on]
            theta = (aqq - app) / (2 * apq)
            t = np.where(theta >= 0, 1.0, -1.0) / (np.abs(theta) + np.hypot(1.0, theta))
            c = 1 / np.hypot(1.0, t)
            s = t * c
            left, right = a[:, p].copy(), a[:, q].copy()
            a[:, p], a[:, q] = c * left - s * right, s * left + c * right
            left, right = a[p].copy(), a[q].copy()
            a[p], a[q] = c[:, None] * left - s[:, None] * right, s[:, None] * left + c[:, None] * right
            a[p, p], a[q, q] = app - t * apq, aqq + t * apq
            a[p, q] = a[q, p] = 0.0
            left, right = v[:, p].copy(), v[:, q].copy()
            v[:, p], v[:, q] = c * left - s * right, s * left + c * right
        if not turned:
            break
    values = np.diag(a)
    order = np.argsort(-values, kind="stable")
    v = v[:, order]
    if d:
        v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)
    return values[order], v


def fit(df: DataFrame) -> Fit:
    n, total = sums(df)
    if not n or not total:
        return Fit(n, total, np.zeros(0), np.zeros((0, 0)), 0.0)
    v = covariance(df, n, total)
    return Fit(n, total, *jacobi(v), float(np.trace(v)))


def _deviations(x: np.ndarray, n: int, total: list[int]) -> tuple[np.ndarray, list[int]]:
    """(x - S / n as doubles, the exact sum of (n * x - S)**2 for each row)"""
    centre = [s // n for s in total]
    z = x - np.array(centre, np.int64)
    rest = np.array([s - n * c for s, c in zip(total, centre, strict=True)], np.int64)  # S = n * centre + rest, 0 <= rest < n
    wide = n * z.astype(object) - rest.astype(object) if n * (int(np.abs(z).max(initial=0)) + 1) >= 1 << 62 else n * z - rest
    near = (wide.astype(np.float64) ** 2).sum(axis=1)
    if near.max(initial=0.0) < 2.0**62:
        exact = (wide * wide).sum(axis=1).tolist()
    else:
        wider = wide.astype(object)
        exact = [int(v) for v in (wider * wider).sum(axis=1)]
    return z - rest / n, exact


def whitened(df: DataFrame, fitted: Fit, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, deviation_exact, w array<double>), a row for each vector of the fit list."""
    schema = pa.schema([("vec_id", pa.int64()), ("deviation_exact", _WHOLE), ("w", pa.list_(pa.float64()))])
    n, total, matrix = fitted.n, fitted.sums, fitted.matrix(components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                for places, x in entries(part.column(1))[2]:
                    if x.shape[1] != len(total):
                        continue
                    centred, exact = _deviations(x, n, total)
                    w = (centred @ matrix).tolist()
                    told = pa.array([v if v < 10**38 else None for v in exact], _WHOLE)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(places)).cast(pa.int64()), told, pa.array(w, pa.list_(pa.float64()))], schema=schema)

    return df.select("vec_id", "embedding").mapInArrow(run, "vec_id long, deviation_exact decimal(38,0), w array<double>")


def identity_error(kept: DataFrame, fitted: Fit, components: int = COMPONENTS) -> float:
    """How far the covariance of whitened vectors, which are centred, is from the identity, at its worst entry."""
    k = min(components, len(fitted.sums))
    if not k or not fitted.n:
        return 0.0
    w = [F.get("w", F.lit(i)) for i in range(k)]
    one = kept.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(w)], *[F.avg(w[i] * w[j]).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    # the means are zero but for rounding; what they are is taken off all the same
    return max(abs(one[f"p{i}_{j}"] - one[f"m{i}"] * one[f"m{j}"] - (i == j)) for i in range(k) for j in range(i, k))


def whiten(df: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact): a row for each remaining vector
    and component. The whitened vectors are kept, as their covariance is taken first."""
    fitted = fit(df)
    kept = common.kept_table(whitened(df, fitted, components), "whitened")
    shares = [float(v / fitted.trace) if ok and fitted.trace > 0 else 0.0 for v, ok in zip(fitted.values, fitted.whole, strict=True)][:components]
    error = identity_error(kept, fitted, components)
    rows = kept.select("vec_id", "deviation_exact", F.posexplode("w").alias("at", "whitened"))
    explained = F.get(F.array(*[F.lit(s) for s in shares]), F.col("at")) if shares else F.lit(0.0)
    small = F.when(F.col("deviation_exact") <= (1 << 63) - 1, F.col("deviation_exact")).cast("long")
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), small.alias("deviation"), "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"), "deviation_exact")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(common.load(spark, sf_dir, "embeddings"))
