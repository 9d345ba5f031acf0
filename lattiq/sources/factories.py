"""Vectors and matrices made from parameters.

Each vector factory gives an array column, each matrix factory a matrix column
(``struct<rows, cols, data>``), so any number of them can be made per row of a
DataFrame.  ``coo_*`` factories give long frames made by all tasks, for sizes
that no single row should hold.  Random values depend on a seed and the place
only: reruns, and any partitioning, give the same numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.functions import kernels as K
from lattiq.functions import vectors as V


def _places(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1)) if n > 0 else F.array().cast("array<int>")


def _check(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


def full(n: int, s: K.Scalar = 0, t: str = "double") -> Column:
    return F.array_repeat(K.col(s).cast(t), n)


def zeros(n: int, t: str = "double") -> Column:
    return full(n, 0, t)


def falses(n: int) -> Column:
    return F.array_repeat(F.lit(False), n)


def index(n: int, first: int = 0, t: str = "double") -> Column:
    """first, first + 1, ... (0 or 1 as the first are the usual ones)."""
    return F.transform(_places(n), lambda i: (i + first).cast(t))


def basis(n: int, i: int, t: str = "double") -> Column:
    _check(0 <= i < n, "index out of bounds")
    return F.transform(_places(n), lambda k: F.when(k == i, 1).otherwise(0).cast(t))


def linspace(n: int, start: float, end: float, t: str = "double") -> Column:
    """From start to end inclusive; integer types truncate toward zero.  One element is the start."""
    return F.transform(_places(n), lambda i: (F.lit(float(start)) + i / max(n - 1, 1) * float(end - start)).cast(t))


def _unit(place: Column, seed: int) -> Column:
    """A number in [0, 1) from a seed and a place: 52 bits of an MD5, so that other engines can repeat it."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), place.cast("string"))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 52)


def random(n: int, low: float = -1.0, high: float = 1.0, seed: int = 34215, t: str = "double") -> Column:
    """Uniform in [low, high); for integer types the bounds are taken in order and high is left out."""
    if t not in K.FLOATS and high < low:
        low, high = high, low
    draw = lambda i: low + _unit(i, seed) * (high - low)
    return F.transform(_places(n), lambda i: (draw(i) if t in K.FLOATS else F.floor(draw(i))).cast(t))


def random_unit(n: int, seed: int = 34215) -> Column:
    drawn = random(n, seed=seed)
    return V.normalize(drawn, V.norm_l2(drawn))


def random_bool(n: int, seed: int = 34215) -> Column:
    return F.transform(_places(n), lambda i: _unit(i, seed) < 0.5)


def mat_full(rows: int, cols: int, s: K.Scalar = 0, t: str = "double") -> Column:
    return V.matrix(rows, cols, full(rows * cols, s, t))


def mat_zeros(rows: int, cols: int | None = None, t: str = "double") -> Column:
    return mat_full(rows, rows if cols is None else cols, 0, t)


def mat_falses(rows: int, cols: int) -> Column:
    return V.matrix(rows, cols, falses(rows * cols))


def mat_index(rows: int, cols: int, first: int = 0, t: str = "double") -> Column:
    return V.matrix(rows, cols, index(rows * cols, first, t))


def mat_random(rows: int, cols: int, low: float = -1.0, high: float = 1.0, seed: int = 121312, t: str = "double") -> Column:
    return V.matrix(rows, cols, random(rows * cols, low, high, seed, t))


def mat_random_bool(rows: int, cols: int, seed: int = 121312) -> Column:
    return V.matrix(rows, cols, random_bool(rows * cols, seed))


def _square(n: int, value, t: str = "double") -> Column:
    """A square matrix from ``value(r, c)``."""
    return V.matrix(n, n, F.transform(_places(n * n), lambda k: value(F.floor(k / n).cast("int"), k % n).cast(t)))


def identity(n: int, t: str = "double") -> Column:
    return diagonal(n, 1, t)


def diagonal(n: int, s: K.Scalar, t: str = "double") -> Column:
    return _square(n, lambda r, c: F.when(r == c, K.col(s)).otherwise(F.lit(0)), t)


def diagonal_of(v: Column, t: str = "double") -> Column:
    """diag(v) of a vector column."""
    n = F.size(v)
    data = F.flatten(F.transform(v, lambda x, r: F.transform(v, lambda _, c: F.when(r == c, x).otherwise(F.lit(0)).cast(t))))
    return V.matrix(n, n, data)


def random_diagonal(n: int, low: float, high: float, seed: int = 65792, t: str = "double") -> Column:
    return diagonal_of(random(n, low, high, seed, t), t)


def rotation(n: int, i: int, j: int, radians: float) -> Column:
    """Rotation in the plane of axes i and j; the identity if they are one."""
    _check(n >= 2 and 0 <= i < n and 0 <= j < n, "bad size or index")
    if i == j:
        return identity(n)
    s, k = math.sin(radians), math.cos(radians)
    corner = lambda r, c: (
        F.when(((r == i) & (c == i)) | ((r == j) & (c == j)), F.lit(k))
        .when((r == i) & (c == j), F.lit(-s)).when((r == j) & (c == i), F.lit(s))
        .otherwise(F.when(r == c, F.lit(1.0)).otherwise(F.lit(0.0)))
    )
    return _square(n, corner)


def permutation(n: int, i: int, j: int, t: str = "double") -> Column:
    """The identity with rows i and j exchanged."""
    _check(n >= 2 and 0 <= i < n and 0 <= j < n, "bad size or index")
    to = lambda r: F.when(r == i, F.lit(j)).when(r == j, F.lit(i)).otherwise(r)
    return _square(n, lambda r, c: F.when(c == to(r), F.lit(1)).otherwise(F.lit(0)), t)


def householder(v: Column) -> Column:
    """I - 2 v v' / (v' v) of a vector column."""
    return householder_update(diagonal_of(V.set_all(v, 1.0)), v)


def householder_update(m: Column, v: Column) -> Column:
    """M - 2 v v' / (v' v): a reflection if M is the identity."""
    scale = K.div(2.0, V.dot(v, v))
    return V.on_matrices(lambda a, b: V.map2(lambda x, y: x - scale * y, a, b), m, V.outer(v, v))


def hilbert(n: int) -> Column:
    _check(n >= 2, "bad size")
    return _square(n, lambda r, c: F.lit(1.0) / (r + c + 1))


def from_columns(*columns: Column, t: str = "double") -> Column:
    """A vector of two, three or four (or more) scalar columns."""
    return F.array(*[c.cast(t) for c in columns])


def from_column_major(n: int, *columns: Column, t: str = "double") -> Column:
    """A square matrix from its columns' entries, column after column."""
    _check(len(columns) == n * n, "bad size")
    return V.matrix(n, n, F.array(*[columns[c * n + r].cast(t) for r in range(n) for c in range(n)]))


def to_pair(v: Column) -> Column:
    """The first two elements as struct<x, y>."""
    return F.struct(V.element(v, 0).alias("x"), V.element(v, 1).alias("y"))


def coo(spark: SparkSession, rows: int, cols: int, value) -> DataFrame:
    """A dense long matrix (r, c, v) from ``value(r, c)``, made by all tasks."""
    cells = spark.range(rows * cols).select((F.col("id") / cols).cast("bigint").alias("r"), (F.col("id") % cols).alias("c"))
    return cells.select("r", "c", value(F.col("r"), F.col("c")).cast("double").alias("v"))


def coo_random(spark: SparkSession, rows: int, cols: int, low: float = -1.0, high: float = 1.0, seed: int = 121312) -> DataFrame:
    return coo(spark, rows, cols, lambda r, c: low + _unit(r * cols + c, seed) * (high - low))
