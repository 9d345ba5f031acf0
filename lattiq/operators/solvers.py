"""Decompositions and solvers.

Many small systems: one matrix a row; rows of an Arrow batch that have one shape
are factorised together, a NumPy step a column for all of them; a task works on
whatever rows it has.  One tall system: QR by blocks (each partition reduces its
rows to a small triangle, the triangles are reduced again) or normal equations by
one aggregate; what reaches the driver has the size of the columns squared.

Conventions: matrices are ``struct<rows, cols, data>``; R's diagonal is the
opposite sign of the pivot entry (Householder with sign(0) = +1), so it can be
negative; partial pivoting takes the first of the largest; a zero pivot gives NaN
or infinities, and the ``singular`` flag.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATRIX = "struct<rows:int,cols:int,data:array<double>>"


def _batched(kernel: Callable) -> Callable:
    """A kernel over (batch, ...) arrays that also takes single ones."""

    @functools.wraps(kernel)
    def run(a: np.ndarray, *rest, **options):
        if np.ndim(a) == 3:
            return kernel(np.asarray(a, float), *rest, **options)
        found = kernel(np.asarray(a, float)[None], *[x[None] if isinstance(x, np.ndarray) else x for x in rest], **options)
        return tuple(x[0] for x in found) if isinstance(found, tuple) else found[0]

    return run


@_batched
def lu(a: np.ndarray, pivot: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(L, U, p) with a[p] = L U; rows are taken in order without pivoting."""
    u, (k, n, _) = a.copy(), a.shape
    low, p, each = np.broadcast_to(np.eye(n), a.shape).copy(), np.tile(np.arange(n), (k, 1)), np.arange(k)
    with np.errstate(all="ignore"):
        for c in range(n - 1):
            if pivot:
                best = c + np.argmax(np.abs(u[:, c:, c]), axis=1)
                for x in (u, p, low[:, :, :c]):
                    x[each, best], x[:, c] = x[:, c].copy(), x[each, best]
            factor = u[:, c + 1 :, c] / u[:, c, c, None]
            low[:, c + 1 :, c] = factor
            u[:, c + 1 :, c:] -= factor[:, :, None] * u[:, c, None, c:]
            u[:, c + 1 :, c] = 0
    return low, u, p


@_batched
def solve_upper(u: np.ndarray, b: np.ndarray, unit: bool = False) -> np.ndarray:
    """Back substitution on the leading square of ``u`` (which may be tall)."""
    n = u.shape[2]
    x = np.array(b[:, :n], float)
    with np.errstate(all="ignore"):
        for c in range(n - 1, -1, -1):
            x[:, c] -= np.einsum("kj,kj->k", u[:, c, c + 1 :], x[:, c + 1 :])
            if not unit:
                x[:, c] /= u[:, c, c]
    return x


@_batched
def solve_lower(low: np.ndarray, b: np.ndarray, unit: bool = False) -> np.ndarray:
    """Forward substitution; the matrix must be square."""
    if low.shape[1] != low.shape[2]:
        raise ValueError("matrix is not square")
    return solve_upper(low[:, ::-1, ::-1], b[:, ::-1], unit)[:, ::-1]


@_batched
def lu_solve(low: np.ndarray, u: np.ndarray, p: np.ndarray, b: np.ndarray) -> np.ndarray:
    return solve_upper(u, solve_lower(low, np.take_along_axis(np.asarray(b, float), p, 1), unit=True))


@_batched
def qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Thin QR of a matrix that is at least as tall as wide, with this module's signs."""
    k, m, n = a.shape
    if m < n:
        raise ValueError("matrix is wider than tall")
    r, q = a.copy(), np.broadcast_to(np.eye(m, n), a.shape).copy()
    reflectors = []
    for c in range(n):
        x = r[:, c:, c].copy()
        norm = np.sqrt(np.einsum("km,km->k", x, x))
        x[:, 0] += np.where(x[:, 0] >= 0, norm, -norm)
        size = np.einsum("km,km->k", x, x)[:, None]
        first = np.zeros_like(x)
        first[:, 0] = np.sqrt(2.0)
        u = np.where(size > 0, x * np.sqrt(2 / np.where(size > 0, size, 1)), first)
        r[:, c:, c:] -= u[:, :, None] * np.einsum("km,kmn->kn", u, r[:, c:, c:])[:, None]
        reflectors.append(u)
    for c in range(n - 1, -1, -1):
        u = reflectors[c]
        q[:, c:, c:] -= u[:, :, None] * np.einsum("km,kmn->kn", u, q[:, c:, c:])[:, None]
    return q, np.triu(r[:, :n])


@_batched
def least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.shape[1] != b.shape[1]:
        raise ValueError("dimensions differ")
    q, r = qr(a)
    return solve_upper(r, _times(q.transpose(0, 2, 1), b))


def _times(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.einsum("kij,kj->ki", a, x)


def _shape(x) -> tuple | None:
    """None for a null, which pandas may hand over as a struct without data."""
    if x is None or isinstance(x, float) or (isinstance(x, dict) and (x["data"] is None or isinstance(x["data"], float))):
        return None
    return (int(x["rows"]), int(x["cols"])) if isinstance(x, dict) else (len(x),)


def _stacked(values: list) -> np.ndarray:
    """Matrices or vectors of one shape as one array."""
    if isinstance(values[0], dict):
        return np.stack([np.asarray(x["data"], float) for x in values]).reshape(len(values), *_shape(values[0]))
    return np.stack([np.asarray(x) for x in values])


def _mapped(df: DataFrame, kernel: Callable, inputs: tuple[str, ...], outputs: dict[str, str]) -> DataFrame:
    """``df`` with the outputs of ``kernel(*inputs)``, which takes all rows of an Arrow
    batch that have one shape together; a row with a null input has null outputs."""
    schema = ", ".join([f"`{c}` {t}" for c, t in df.dtypes] + [f"`{c}` {t}" for c, t in outputs.items()])

    def value(x, kind: str):
        if kind == MATRIX:
            return {"rows": x.shape[0], "cols": x.shape[1], "data": x.ravel()}
        return bool(x) if kind == "boolean" else x

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            columns = [batch[c].tolist() for c in inputs]
            alike: dict[tuple, list[int]] = {}
            for k, row in enumerate(zip(*columns, strict=True)):
                shape = tuple(map(_shape, row))
                if None not in shape:
                    alike.setdefault(shape, []).append(k)
            out = {name: [None] * len(batch) for name in outputs}
            for rows in alike.values():
                for (name, kind), found in zip(outputs.items(), kernel(*[_stacked([c[k] for k in rows]) for c in columns]), strict=True):
                    for k, x in zip(rows, found, strict=True):
                        out[name][k] = value(x, kind)
            yield batch.assign(**{name: pd.Series(x, dtype=object, index=batch.index) for name, x in out.items()})

    return df.mapInPandas(run, schema)


def _singular(u: np.ndarray) -> np.ndarray:
    return (np.diagonal(u, axis1=1, axis2=2) == 0).any(axis=1) | ~np.isfinite(u).all(axis=(1, 2))


def with_lu(df: DataFrame, m: str = "m", pivot: bool = True) -> DataFrame:
    """Adds l, u (matrices), p (array<int>) and singular."""

    def kernel(a):
        low, u, p = lu(a, pivot)
        return low, u, p, _singular(u)

    return _mapped(df, kernel, (m,), {"l": MATRIX, "u": MATRIX, "p": "array<int>", "singular": "boolean"})


def with_lu_packed(df: DataFrame, m: str = "m") -> DataFrame:
    """Adds lu (L below the diagonal, U from it on, rows in pivot order) and p."""

    def kernel(a):
        low, u, p = lu(a)
        return np.tril(low, -1) + u, p

    return _mapped(df, kernel, (m,), {"lu": MATRIX, "p": "array<int>"})


def with_lu_solution(df: DataFrame, m: str = "m", b: str = "b") -> DataFrame:
    """Adds x with m x = b, and singular."""

    def kernel(a, rhs):
        low, u, p = lu(a)
        return lu_solve(low, u, p, rhs), _singular(u)

    return _mapped(df, kernel, (m, b), {"x": "array<double>", "singular": "boolean"})


def with_triangular_solution(df: DataFrame, m: str = "m", b: str = "b", upper: bool = True, unit: bool = False) -> DataFrame:
    """Adds x of a triangular system; ``unit`` takes the diagonal as ones."""
    solve = solve_upper if upper else solve_lower
    return _mapped(df, lambda a, rhs: (solve(a, rhs, unit),), (m, b), {"x": "array<double>"})


def with_packed_solution(df: DataFrame, lu_: str = "lu", p: str = "p", b: str = "b") -> DataFrame:
    """Adds x from a packed LU and its pivot."""
    kernel = lambda a, order, rhs: (lu_solve(a, a, order.astype(np.int64), rhs),)
    return _mapped(df, kernel, (lu_, p, b), {"x": "array<double>"})


def with_qr(df: DataFrame, m: str = "m") -> DataFrame:
    """Adds q and r."""
    return _mapped(df, qr, (m,), {"q": MATRIX, "r": MATRIX})


def with_qr_solution(df: DataFrame, q: str = "q", r: str = "r", b: str = "b") -> DataFrame:
    """Adds x with r x = q' b."""
    kernel = lambda a, c, rhs: (solve_upper(c, _times(a.transpose(0, 2, 1), rhs)),)
    return _mapped(df, kernel, (q, r, b), {"x": "array<double>"})


def with_least_squares(df: DataFrame, m: str = "m", b: str = "b") -> DataFrame:
    """Adds x that minimises |m x - b|."""
    return _mapped(df, lambda a, rhs: (least_squares(a, rhs),), (m, b), {"x": "array<double>"})


def tall_r(rows: DataFrame, width: int, v: str = "v", fan_in: int = 64) -> np.ndarray:
    """R of one tall matrix, an array a row, by blocks.

    Blocks of rows are reduced to triangles of ``width`` rows, then ``fan_in``
    triangles at a time (only triangles are shuffled), until one task's worth is left.
    """

    def reduce(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top = np.empty((0, width))
        for block in blocks:
            if len(block):
                top = np.linalg.qr(np.vstack([top, np.stack(block.iloc[:, 0].to_numpy())]), mode="r")
        if len(top):  # an empty partition has no triangle
            yield pd.DataFrame({"v": list(top)})

    out = rows.select(F.col(v).cast("array<double>").alias("v")).mapInPandas(reduce, "v array<double>")
    parts = out.rdd.getNumPartitions()
    while parts > fan_in:
        parts = -(-parts // fan_in)
        out = out.repartition(parts).mapInPandas(reduce, "v array<double>")
    top = np.array([r["v"] for r in out.collect()]).reshape(-1, width)  # at most fan_in * width rows
    r = np.linalg.qr(top, mode="r") if len(top) else np.zeros((width, width))
    return r * np.where(np.diag(r) > 0, -1.0, 1.0)[: len(r), None]


def regress(rows: DataFrame, xs: list[str], y: str) -> DataFrame:
    """(term, coefficient) of the least-squares fit of ``y`` on ``xs`` by QR of the tall matrix [xs, y]."""
    n = len(xs)
    r = tall_r(rows.select(F.array(*[F.col(c).cast("double") for c in [*xs, y]]).alias("v")), n + 1)
    x = solve_upper(r[:n, :n], r[:n, n])
    return rows.sparkSession.createDataFrame([(c, float(k)) for c, k in zip(xs, x, strict=True)], "term string, coefficient double")
