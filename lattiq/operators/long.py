"""Matrices in long form (r, c, v) and vectors in long form (i, v).

Products are equi-joins on the contracted index and grouped sums, which Spark
combines before the shuffle; a vector side is small and is broadcast where its
size allows.  Long forms are dense: zeros are stored, so means, extremes and
predicates see every entry.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.functions import kernels as K

BROADCAST_ROWS = 100_000
BINS = 4096
DIRECT_ROWS = 1_000_000


def _is_small(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def _small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if a count proves it small."""
    return F.broadcast(df) if _is_small(df) else df


def explode_vectors(df: DataFrame, key: str = "id", v: str = "v") -> DataFrame:
    return df.select(F.col(key), F.posexplode(v).alias("i", "x"))


def from_rows(df: DataFrame, key: str = "id", v: str = "v") -> DataFrame:
    """(r, c, v) from one array a row."""
    return df.select(F.col(key).alias("r"), F.posexplode(v).alias("c", "v"))


def from_matrix(df: DataFrame, m: str = "m", *keys: str) -> DataFrame:
    cols = F.col(m)["cols"]
    return df.select(*keys, cols.alias("__n"), F.posexplode(F.col(m)["data"]).alias("__k", "v")).select(
        *keys, F.floor(F.col("__k") / F.col("__n")).cast("int").alias("r"), (F.col("__k") % F.col("__n")).alias("c"), "v"
    )


def to_rows(coo: DataFrame) -> DataFrame:
    """(id, v): one array a row index; its length is the number of columns."""
    packed = F.transform(F.array_sort(F.collect_list(F.struct("c", "v"))), lambda p: p["v"])
    return coo.groupBy(F.col("r").alias("id")).agg(packed.alias("v"))


def transpose(coo: DataFrame) -> DataFrame:
    return coo.select(F.col("c").alias("r"), F.col("r").alias("c"), "v")


def matmul(a: DataFrame, b: DataFrame, transpose_a: bool = False, t: str = "double") -> DataFrame:
    """A B, or A' B without forming A'.  For an integer type the sums wrap to it.

    A side that a count proves small is broadcast, so the other one is not
    shuffled by the contracted index, which may have few values.
    """
    i, k = ("c", "r") if transpose_a else ("r", "c")
    left = a.select(F.col(i).alias("r"), F.col(k).alias("__k"), F.col("v").alias("__x"))
    right = b.select(F.col("r").alias("__k"), "c", F.col("v").alias("__y"))
    joined = left.join(F.broadcast(right), "__k") if _is_small(right) else (F.broadcast(left) if _is_small(left) else left).join(right, "__k")
    return joined.groupBy("r", "c").agg(_sum(F.col("__x"), F.col("__y"), t).alias("v"))


def _sum(x: Column, y: Column, t: str) -> Column:
    """Sum of products; of integers exactly, then wrapped to their type."""
    if t in K.FLOATS:
        return F.sum(x * y).cast(t)
    return K.narrow(F.sum(x.cast("decimal(19,0)") * y.cast("decimal(19,0)")), "bigint") if t == "bigint" else K.narrow(F.sum(x.cast("bigint") * y.cast("bigint")), t)


def gram(rows: DataFrame, v: str = "v") -> DataFrame:
    """A' A of one array a row, as (r, c, v): no join, one aggregate.

    Each task multiplies its rows, a batch at a time, and hands over one matrix
    of (columns squared) values; null rows count as absent, rows of different
    lengths are an error.
    """

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            column = batch.column(0).drop_null()
            if not len(column):
                continue
            n = np.unique(column.value_lengths().to_numpy())
            if len(n) > 1 or (total is not None and len(total) != n[0]):
                raise ValueError("rows differ in length")
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), int(n[0]))
            total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["r", "row"])

    partial = rows.select(F.col(v).cast("array<double>").alias("v")).mapInArrow(multiply, "r int, row array<double>")
    return partial.select("r", F.posexplode("row").alias("c", "p")).groupBy("r", "c").agg(F.sum("p").alias("v"))


def matvec(a: DataFrame, x: DataFrame, t: str = "double") -> DataFrame:
    """A x as (i, v), from (r, c, v) and (i, v).  For an integer type the sums wrap to it."""
    side = _small(x.select(F.col("i").alias("c"), F.col("v").alias("__x")))
    return a.join(side, "c").groupBy(F.col("r").alias("i")).agg(_sum(F.col("v"), F.col("__x"), t).alias("v"))


def vecmat(y: DataFrame, a: DataFrame, t: str = "double") -> DataFrame:
    """y' A as (i, v)."""
    return matvec(transpose(a), y, t)


def dot(a: DataFrame, b: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    """The inner product of two long vectors over [start, end), one row."""
    inside = F.col("i") >= start
    if end is not None:
        inside &= F.col("i") < end
    return a.filter(inside).join(b.select("i", F.col("v").alias("__y")), "i").agg(F.coalesce(F.sum(F.col("v") * F.col("__y")), F.lit(0.0)).alias("v"))


def outer(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every product of two long vectors: the result itself has that size."""
    return a.select(F.col("i").alias("r"), F.col("v").alias("__x")).crossJoin(
        b.select(F.col("i").alias("c"), F.col("v").alias("__y"))
    ).select("r", "c", (F.col("__x") * F.col("__y")).alias("v"))


def elementwise(a: DataFrame, b: DataFrame, kernel) -> DataFrame:
    """``kernel(x, y)`` of two long matrices of one shape; an error where an entry has no partner."""
    other = b.select("r", "c", F.col("v").alias("__y"), F.lit(True).alias("__b"))
    both = a.withColumn("__a", F.lit(True)).join(other, ["r", "c"], "full")
    whole = F.col("__a") & F.col("__b")
    return both.select("r", "c", F.when(whole, kernel(F.col("v"), F.col("__y"))).otherwise(F.raise_error(F.lit("dimensions differ"))).alias("v"))


def select(a: DataFrame, b: DataFrame, mask: DataFrame) -> DataFrame:
    """``b`` where the mask is true, else ``a``."""
    y = b.select("r", "c", F.col("v").alias("__y"))
    m = mask.select("r", "c", F.col("v").alias("__m"))
    return a.join(y, ["r", "c"]).join(m, ["r", "c"]).select("r", "c", F.when(F.col("__m"), F.col("__y")).otherwise(F.col("v")).alias("v"))


def reduced(a: DataFrame, axis: str = "r") -> DataFrame:
    """(i, sum, mean) of the rows ("r") or columns ("c"), in one aggregate."""
    return a.groupBy(F.col(axis).alias("i")).agg(F.sum("v").alias("sum"), F.avg("v").alias("mean"))


def row_sum(a: DataFrame) -> DataFrame:
    return reduced(a).select("i", F.col("sum").alias("v"))


def col_sum(a: DataFrame) -> DataFrame:
    return reduced(a, "c").select("i", F.col("sum").alias("v"))


def row_mean(a: DataFrame) -> DataFrame:
    return reduced(a).select("i", F.col("mean").alias("v"))


def col_mean(a: DataFrame) -> DataFrame:
    return reduced(a, "c").select("i", F.col("mean").alias("v"))


def stats(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """count, sum, mean, min, max, range, variance, std_dev per group: one aggregate, combined before the shuffle."""
    x = F.col(value).cast("double")
    return df.groupBy(*keys).agg(
        F.count(x).alias("count"), F.sum(x).alias("sum"), F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"),
        (F.max(x) - F.min(x)).alias("range"), F.var_pop(x).alias("variance"), F.stddev_pop(x).alias("std_dev"),
    )


def order_stats(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """median, q1, q3 per group, exactly.

    If no group has more than DIRECT_ROWS elements, each one's distinct values are
    put in order by one task.  Beyond that, a group's range is cut into BINS bins,
    whose elements are counted with map-side combining; running counts over at
    most BINS rows a group tell which bins hold the wanted places, and only the
    distinct values in those are put in order.  Null elements don't count; NaN is
    larger than all else; a group without elements has nulls.
    """
    from pyspark.sql import Window

    names = [f"__k{i}" for i in range(len(keys))]
    x = F.col("__x")
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(value).cast("double").alias("__x")).filter("__x IS NOT NULL")
    n = F.col("__n")
    mid = F.floor(n / 2)
    half = F.floor(mid / 2)
    pairs = {
        "median": (F.when(n % 2 == 1, mid).otherwise(mid - 1), mid),
        "q1": (F.when(n % 2 == 1, half).when(n == 2, 0).otherwise(half - 1), F.when(n == 2, 0).otherwise(half)),
        "q3": (F.when(n % 2 == 1, mid + half).when(n == 2, 1).otherwise(mid + half - 1), F.when(n == 2, 1).otherwise(mid + half)),
    }
    places = F.array(*[p.cast("bigint") for pair in pairs.values() for p in pair])
    largest = rows.groupBy(*names).count().agg(F.max("count")).first()[0] or 0
    counted = _by_value(rows, names) if largest <= DIRECT_ROWS else _near_places(rows, names, places)
    within = Window.partitionBy(*names, "__bin").orderBy("__x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.withColumn("__end", F.col("__start") + F.sum("__c").over(within))
    at = lambda p: F.max(F.when((F.col("__end") - F.col("__c") <= p) & (F.col("__end") > p), x))
    found = placed.groupBy(*names, "__n").agg(*[((at(p[0]) + at(p[1])) / 2).alias(name) for name, p in pairs.items()])
    groups = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).distinct() if keys else None
    found = found.drop("__n") if groups is None else _matched(groups, found.drop("__n"), names, "left")
    return found.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], *pairs)


def _by_value(rows: DataFrame, names: list[str]) -> DataFrame:
    """The distinct values of each group with their counts, as one bin."""
    from pyspark.sql import Window

    counted = rows.groupBy(*names, "__x").agg(F.count(F.lit(1)).alias("__c"))
    return counted.withColumns({"__n": F.sum("__c").over(Window.partitionBy(*names)), "__start": F.lit(0), "__bin": F.lit(0)})


def _near_places(rows: DataFrame, names: list[str], places: Column) -> DataFrame:
    """The same for the bins that hold one of ``places`` only."""
    from pyspark.sql import Window

    x = F.col("__x")
    finite = F.when(~F.isnan(x) & (F.abs(x) != K.INF), x)
    spread = rows.groupBy(*names).agg(F.min(finite).alias("__lo"), F.max(finite).alias("__hi"), F.count(x).alias("__n"))
    rows = _matched(rows, spread, names)
    share = F.when(F.col("__hi") > F.col("__lo"), (x - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(F.lit(0.0))
    inside = F.least(F.floor(share * BINS), F.lit(BINS - 1))
    bin_ = F.when(F.isnan(x), BINS + 1).when(x == K.INF, BINS).when(x == -K.INF, -1).otherwise(inside).cast("int")
    rows = rows.withColumn("__bin", bin_)
    upto = lambda by: Window.partitionBy(*names).orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = rows.groupBy(*names, "__n", "__bin").agg(F.count(x).alias("__c"))
    bins = bins.withColumn("__end", F.sum("__c").over(upto("__bin"))).withColumn("__start", F.col("__end") - F.col("__c"))
    wanted = bins.filter(F.exists(places, lambda p: (p >= F.col("__start")) & (p < F.col("__end"))))
    near = _matched(rows.drop("__n"), wanted.select(*names, "__n", "__bin", "__start"), [*names, "__bin"])
    counted = near.groupBy(*names, "__n", "__bin", "__start", "__x").agg(F.count(x).alias("__c"))
    return counted


def _matched(rows: DataFrame, per: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``per``, whose rows are named by ``names``; nulls match nulls."""
    other = _small(per.select(*[F.col(c).alias(f"{c}_of") if c in names else F.col(c) for c in per.columns]))
    same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in names], F.lit(True))
    joined = rows.join(other, same, how) if names else rows.crossJoin(other)  # one row where there are no names
    return joined.drop(*[f"{c}_of" for c in names])


def norms(df: DataFrame, value: str, *keys: str, p: float = 3.0) -> DataFrame:
    x = F.abs(F.col(value).cast("double"))
    return df.groupBy(*keys).agg(
        F.sqrt(F.sum(x * x)).alias("l2"), F.sum(x).alias("l1"), F.avg(x).alias("l1_mean"), F.max(x).alias("lmax"),
        F.pow(F.sum(F.pow(x, F.lit(p))), F.lit(1.0 / p)).alias("lp"),
    )


def predicates(coo: DataFrame, epsilon: float = 0.0, *keys: str) -> DataFrame:
    """Structural predicates of each matrix in (keys, r, c, v), in one aggregate; symmetry joins cells to their mirror."""
    x, r, c = F.col("v"), F.col("r"), F.col("c")
    near = lambda value: K.le(F.abs(value), epsilon)
    mirror = coo.select(*keys, F.col("c").alias("r"), F.col("r").alias("c"), x.alias("__w"))
    both = coo.join(mirror, [*keys, "r", "c"], "left")
    square = F.max(r) == F.max(c)
    return both.groupBy(*keys).agg(
        F.bool_or(F.isnan(x)).alias("any_nan"), F.bool_or(F.abs(x) == K.INF).alias("any_inf"), F.bool_and(near(x)).alias("zero"),
        F.max(F.abs(x)).alias("max_zero_error"), (square & F.bool_and(near(x - (r == c).cast("int")))).alias("identity"),
        (square & F.bool_and(F.coalesce(near(x - F.col("__w")), F.lit(False)))).alias("symmetric"),
        F.bool_and((r == c) | near(x)).alias("diagonal"), F.bool_and((c >= r) | near(x)).alias("upper"), F.bool_and((c <= r) | near(x)).alias("lower"),
    )


def is_orthogonal(coo: DataFrame, epsilon: float) -> DataFrame:
    """Whether A' A is the identity within epsilon: one row."""
    return predicates(matmul(coo, coo, True), epsilon).select(F.col("identity").alias("orthogonal"))


def permute(coo: DataFrame, pivot: DataFrame, axis: str = "r", inverse: bool = False) -> DataFrame:
    """Rows (``axis`` "r") or columns ("c") moved from i to ``to`` of (i, to), or back."""
    there, back = ("to", "i") if inverse else ("i", "to")
    moves = _small(pivot.select(F.col(there).alias(axis), F.col(back).alias("__to")))
    moved = coo.join(moves, axis)
    return moved.select(*[F.col("__to").alias(axis) if k == axis else F.col(k) for k in ("r", "c", "v")])


def swap(coo: DataFrame, i: int, j: int, axis: str = "r", start: int = 0, end: int | None = None) -> DataFrame:
    """Rows or columns i and j exchanged, on [start, end) of the other axis: a remap, no shuffle."""
    other = F.col("c" if axis == "r" else "r")
    inside = other >= start
    if end is not None:
        inside &= other < end
    at: Column = F.col(axis)
    to = F.when(inside & (at == i), F.lit(j)).when(inside & (at == j), F.lit(i)).otherwise(at)
    return coo.withColumn(axis, to.cast(dict(coo.dtypes)[axis]))
