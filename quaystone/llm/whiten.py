"""Whitening of embeddings by an incremental eigendecomposition.

Every partition keeps the eigendecomposition of the scatter of its rows: a row is a centred rank-one
update, whose new eigenvalues are the roots of a secular equation; eigenpairs that the update does
not move are deflated. Spectra of partitions are combined in rounds, a few to a task: each
eigenpair of one is a rank-one update of the other, and one more is owed to the distance of their
means. A last pass over all rows projects them on that basis (Rayleigh-Ritz), which takes away
what rounding has left: the eigenvectors of that small matrix turn the basis.

What meets in a task or in the driver is a few matrices of dimension by dimension, whatever the
number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from quaystone.llm.common import bound_arrow
from quaystone.plans.storage import materialise

EPS = np.finfo(np.float64).eps


def secular_roots(d: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Matrix of d[j] - root[i] for the roots of 1 + sum(weights / (d - x)) = 0; d rises strictly, weights are positive.

    Root i lies between d[i] and d[i + 1] (the last one at most sum(weights) above the last d). It is
    sought as its distance from the nearer of the two, so that differences keep their precision.
    Each step solves the equation with two poles that agrees in value and slopes; where that leaves
    the bracket, the bracket is halved.
    """
    k = len(d)
    row, last = np.arange(k), k - 1
    gap = np.append(d[1:], d[-1] + weights.sum()) - d
    half = gap / 2
    apart = d[None, :] - d[:, None]
    left = 1 + (weights / (apart - half[:, None])).sum(axis=1) >= 0
    origin = np.where(left | (row == last), row, np.minimum(row + 1, last))
    apart = d[None, :] - d[origin][:, None]
    low = np.where(origin == row, np.where(left, 0.0, half), -half)
    high = np.where(origin == row, np.where(left, half, gap), 0.0)
    high[last] *= 1 + 4 * EPS
    # Signs of the terms: those of the poles at or below the root are negative.
    signs = np.where(row[None, :] <= row[:, None], -1.0, 1.0)
    x = (low + high) / 2
    open_ = row
    for _ in range(100):
        at, sign = x[open_], signs[open_]
        away = apart[open_] - at[:, None]
        terms = weights / away
        slopes = terms / away
        f, slope = 1 + terms.sum(axis=1), slopes.sum(axis=1)
        rising = f < 0
        lo, hi = np.where(rising, at, low[open_]), np.where(rising, high[open_], at)
        sizes = np.einsum("ij,ij->i", terms, sign)
        missing = (np.abs(f) > EPS * (8 * (1 + sizes) + np.abs(at) * slope)) & (hi - lo > 2 * EPS * np.abs(at))
        if not missing.any():
            break
        lower = (slope - np.einsum("ij,ij->i", slopes, sign)) / 2
        upper = slope - lower
        i = np.arange(len(open_))
        p, q = away[i, open_], away[i, np.minimum(open_ + 1, last)]
        with np.errstate(all="ignore"):
            c = f - p * lower - q * upper
            a = (p + q) * f - p * q * slope
            b = p * q * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            if open_[-1] == last:
                step[-1] = p[-1] + slope[-1] * p[-1] ** 2 / (f[-1] - slope[-1] * p[-1])
        moved = at + step
        low[open_], high[open_] = lo, hi
        x[open_] = np.where(missing, np.where((moved > lo) & (moved < hi), moved, (lo + hi) / 2), at)
        open_ = open_[missing]
    return apart - x[:, None]


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, rising, and eigenvectors (columns) of vectors @ diag(values) @ vectors.T + rho * v v', for rho >= 0."""
    z = vectors.T @ v
    size = float(z @ z)
    rho *= size
    if not rho > 0:
        return values, vectors
    z = z / size**0.5
    slack = 8 * EPS * max(float(values[-1]), rho)
    values, vectors = values.copy(), vectors.copy()
    live = rho * np.abs(z) > slack  # first deflation: the update is orthogonal to the vector
    at = np.flatnonzero(live)
    d, y = values[at], z[at]
    if np.any(np.diff(d) * np.abs(y[1:] * y[:-1]) <= slack * (y[1:] ** 2 + y[:-1] ** 2)):
        p = at[0]
        for j in at[1:]:  # second deflation: of two equal values one vector is turned away from the update
            r = float(np.hypot(z[p], z[j]))
            c, s = z[j] / r, z[p] / r
            if (values[j] - values[p]) * abs(c * s) <= slack:
                z[j], z[p], live[p] = r, 0.0, False
                vectors[:, p], vectors[:, j] = c * vectors[:, p] - s * vectors[:, j], s * vectors[:, p] + c * vectors[:, j]
                values[p], values[j] = c * c * values[p] + s * s * values[j], s * s * values[p] + c * c * values[j]
            p = j
        at = np.flatnonzero(live)
        d, y = values[at], z[at]
    if not len(at):
        return values, vectors
    away = secular_roots(d, rho * y * y)
    # The update for which these roots are exact: eigenvectors made of it are orthogonal.
    between = d[:, None] - d[None, :]
    np.fill_diagonal(between, 1.0)
    exact = np.copysign(np.sqrt(np.abs(np.prod(-away / between, axis=0))), y)
    turn = exact[None, :] / away
    turn /= np.sqrt((turn * turn).sum(axis=1))[:, None]
    values[at] = d - np.diagonal(away)
    vectors[:, at] = vectors[:, at] @ turn.T
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """Number and mean of rows, and the eigendecomposition of their scatter about that mean."""

    def __init__(self, n: float, mean: np.ndarray, values: np.ndarray, vectors: np.ndarray):
        self.n, self.mean, self.values, self.vectors = n, mean, values, vectors

    @classmethod
    def empty(cls, size: int) -> Spectrum:
        return cls(0, np.zeros(size), np.zeros(size), np.eye(size))

    def _shift(self, n: float, mean: np.ndarray) -> None:
        away, total = mean - self.mean, self.n + n
        self.values, self.vectors = rank_one(self.values, self.vectors, away, self.n * n / total)
        self.mean, self.n = self.mean + away * (n / total), total

    def add(self, row: np.ndarray, times: int = 1) -> None:
        """Take in a row that occurs so many times: one centred rank-one update."""
        self._shift(times, row)

    def merge(self, other: Spectrum) -> None:
        """Take in all rows of another spectrum: a rank-one update for each eigenpair, and one for the means."""
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector, float(value))
        if other.n:
            self._shift(other.n, other.mean)


@dataclass(frozen=True)
class Whitening:
    """What :func:`fit` has learned. Components (columns of ``basis``) are in the order of falling eigenvalues."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    basis: np.ndarray
    scale: int
    shift: int
    identity_error: float

    @property
    def explained(self) -> np.ndarray:
        """Each component's share of the trace; 0 where there is no variance at all."""
        total = float(self.values.sum())
        return self.values / total if total > 0 else np.zeros_like(self.values)

    def usable(self, most: int) -> np.ndarray:
        """Of the first ``most`` components those with a variance that is more than rounding."""
        head = self.values[:most]
        return head > 1e-12 * float(self.values[0]) if len(head) else head > 0

    def maps(self, most: int) -> np.ndarray:
        """The projections that whiten, as columns; NaN for a component without variance."""
        with np.errstate(all="ignore"):
            return np.where(self.usable(most)[None, :], self.basis[:, :most] / np.sqrt(self.values[:most])[None, :], np.nan)


def whole_numbers(column: pa.Array, scale: int, shift: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, x) for each length of vectors in an Arrow list array: x is a matrix of floor(scale * c) + shift."""
    if not pa.types.is_list(column.type) and not pa.types.is_large_list(column.type):
        column = column.cast(pa.list_(pa.float64()))
    sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[sizes > 0]).tolist():
        places = np.flatnonzero(sizes == size)
        flat = column.take(pa.array(places)).flatten().cast(pa.float64())
        c = flat.to_numpy(zero_copy_only=False).reshape(-1, size)  # a null becomes NaN
        fine = np.isfinite(c).all(axis=1)
        if fine.any():
            x = np.floor(scale * c[fine])
            if np.abs(x).max() >= 2.0**52:
                raise OverflowError("a component is too large to be a whole number of double precision")
            yield places[fine], x.astype(np.int64) + shift


def _per_partition(data: DataFrame, size: int, scale: int, shift: int, start: Callable, take: Callable, end: Callable) -> DataFrame:
    """One row (part_, flat array<double>) for each partition that has rows: a state that ``take`` moves on, flattened by ``end``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for b in batches:
            for _, x in whole_numbers(b.column(0), scale, shift):
                if x.shape[1] == size:
                    state = take(start() if state is None else state, x)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([end(state)], pa.list_(pa.float64()))], names=["flat"])

    return data.select("v_").mapInArrow(run, "flat array<double>").withColumn("part_", F.spark_partition_id())


def _fold(parts: DataFrame, name: str, merge: Callable[[list[np.ndarray]], np.ndarray], fan: int = 8) -> np.ndarray:
    """Merge the partitions' rows in rounds, at most ``fan`` to a task, down to one."""
    parts = materialise(parts, name)
    count = 1 + (parts.agg(F.max("part_")).first()[0] or 0)

    def some(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part_")
        return pd.DataFrame({"flat": [merge([np.asarray(f, np.float64) for f in rows["flat"]])], "part_": [rows["part_"].iloc[0] // fan]})

    while count > 1:
        parts = parts.groupBy(F.floor(F.col("part_") / fan).alias("to_")).applyInPandas(some, "flat array<double>, part_ int")
        count = -(-count // fan)
    return np.asarray(parts.first()["flat"], np.float64)


def _totals(data: DataFrame, scale: int, shift: int) -> tuple[int, np.ndarray]:
    """(n, S) of the vectors of the commonest length, exactly; (0, []) if there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for _, x in whole_numbers(b.column(0), scale, shift):
                n, sums = held.get(x.shape[1], (0, 0))
                held[x.shape[1]] = (n + len(x), sums + x.sum(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int32()), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([s.tolist() for _, s in held.values()], pa.list_(pa.int64()))], names=["size", "n", "sums"]
        )

    rows = data.select("v_").mapInArrow(run, "size int, n long, sums array<long>").select("size", "n", F.posexplode("sums")).groupBy("size", "pos").agg(F.sum("n").alias("n"), F.sum("col").alias("s"))
    best = rows.where("pos = 0").orderBy(F.desc("n"), "size").limit(1).first()
    if best is None:
        return 0, np.empty(0, np.int64)
    sums = rows.where(F.col("size") == best["size"]).orderBy("pos").collect()  # as many as a vector has components
    return best["n"], np.array([r["s"] for r in sums], np.int64)


def fit(vectors: DataFrame, most: int = 32, scale: int = 64, shift: int = 1_000_000, vec_col: str = "embedding") -> Whitening | None:
    """Mean, eigenvalues and components of all usable vectors as whole numbers; None if there are none.

    See :func:`whiten` for what is usable. ``identity_error`` is measured in a pass of its own, on
    the first ``most`` components that have variance (0 if none has).
    """
    bound_arrow(vectors.sparkSession)
    data = vectors.select(F.col(vec_col).alias("v_"))
    n, sums = _totals(data, scale, shift)
    if not n:
        return None
    size = len(sums)

    def centred(x: np.ndarray) -> np.ndarray:
        return (n * x - sums) / n

    def update(spectrum: Spectrum, x: np.ndarray) -> Spectrum:
        rows, times = np.unique(x, axis=0, return_counts=True)  # equal rows are one update
        for row, m in zip(centred(rows), times.tolist()):
            spectrum.add(row, m)
        return spectrum

    def flat(s: Spectrum) -> np.ndarray:
        return np.concatenate([[s.n], s.mean, s.values, s.vectors.ravel()])

    def whole(f: np.ndarray) -> Spectrum:
        return Spectrum(f[0], f[1 : size + 1], f[size + 1 : 2 * size + 1], f[2 * size + 1 :].reshape(size, size))

    def combine(parts: list[np.ndarray]) -> np.ndarray:
        first, *others = (whole(f) for f in parts)
        for other in others:
            first.merge(other)
        return flat(first)

    spectrum = whole(_fold(_per_partition(data, size, scale, shift, lambda: Spectrum.empty(size), update, flat), "spectra", combine))
    basis = np.linalg.qr(spectrum.vectors[:, ::-1])[0]

    def products(project: Callable) -> np.ndarray:
        """The mean of y y' over all rows, y being what ``project`` makes of a row."""
        parts = _per_partition(data, size, scale, shift, lambda: 0.0, lambda total, x: total + (lambda y: y.T @ y)(project(x)), np.ravel)
        total = _fold(parts, "products", lambda fs: np.sum(fs, axis=0))
        return total.reshape(int(len(total) ** 0.5), -1) / n

    ritz = products(lambda x: centred(x) @ basis)
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    values, basis = np.maximum(values[::-1], 0.0), basis @ turn[:, ::-1]
    basis = basis * np.where(basis[np.abs(basis).argmax(axis=0), np.arange(size)] < 0, -1.0, 1.0)
    model = Whitening(n, sums, values, basis, scale, shift, 0.0)
    maps = model.maps(most)[:, model.usable(most)]
    if not maps.shape[1]:
        return model
    second = products(lambda x: np.column_stack([centred(x) @ maps, np.ones(len(x))]))
    covariance = second[:-1, :-1] - np.outer(second[:-1, -1], second[:-1, -1])
    return Whitening(n, sums, values, basis, scale, shift, float(np.abs(covariance - np.eye(len(covariance))).max()))


def whiten(vectors: DataFrame, model: Whitening | None, most: int = 32, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, component int, n long, deviation long, whitened, explained, identity_error double): a row for each vector and component.

    Usable are vectors that are not null or empty, without null or non-finite components, and of the
    length that most of these have (ties: the smallest); the others give no rows. A component c
    is taken as floor(scale * c) + shift; one of 2**52 / scale or more raises. Null and repeated ids
    are rows like others. Vectors of fewer dimensions than ``most`` have as many components. A
    component without variance (all vectors equal in its direction) has null as its whitened value and
    0 as its share. deviation is the squared distance from the mean, times n squared, exactly; null
    where that does not fit a long. Without any usable vector there are no rows.
    """
    spark = vectors.sparkSession
    bound_arrow(spark)
    data = vectors.select(F.col(id_col).alias("id_"), F.col(vec_col).alias("v_"))
    kind = data.schema["id_"].dataType.simpleString()
    if model is None:
        return spark.createDataFrame([], f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    n, sums, maps = model.n, model.sums, model.maps(most)
    scale, shift = model.scale, model.shift

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for places, x in whole_numbers(b.column(1), scale, shift):
                if x.shape[1] != len(sums):
                    continue
                away = n * x - sums
                if float(np.abs(away).max()) ** 2 * len(sums) < 2.0**62:
                    deviation = pa.array((away * away).sum(axis=1))
                else:
                    exact = [sum(a * a for a in row) for row in away.tolist()]
                    deviation = pa.array([e if e < 2**63 else None for e in exact], pa.int64())
                white = pa.array((away / n @ maps).ravel())
                white = pc.if_else(pc.is_nan(white), None, white)
                lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * maps.shape[1], white)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(places)), deviation, lists], names=["id_", "deviation", "white"])

    rows = data.mapInArrow(run, f"id_ {kind}, deviation long, white array<double>").select("id_", "deviation", F.posexplode("white"))
    shares = F.array(*(F.lit(float(e)) for e in model.explained[:most]))
    return rows.select(
        F.col("id_").alias(id_col), (F.col("pos") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.col("col").alias("whitened"),
        F.element_at(shares, F.col("pos") + 1).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
