"""Vectors as array columns and matrices as ``struct<rows, cols, data>`` columns, row-major.

Kernels are lifted over the elements of one, two or three arrays.  Shapes are
checked on every row (``strict`` raises, as a library would); the work is a
projection, so it needs no shuffle and prunes and pipelines like any other.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattiq.functions import kernels as K
from lattiq.functions.kernels import Scalar


def same_dim(a: Column, b: Column, value: Column, what: str = "dimensions differ") -> Column:
    """``value`` where both arrays have one length, else an error."""
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit(what)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once a row, also where lambdas in it use it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def map1(kernel: Callable[[Column], Column], v: Column) -> Column:
    return F.transform(v, kernel)


def map2(kernel: Callable[[Column, Column], Column], a: Column, b: Column) -> Column:
    return same_dim(a, b, F.zip_with(a, b, kernel))


def map3(kernel: Callable[[Column, Column, Column], Column], a: Column, b: Column, c: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return same_dim(a, b, same_dim(a, c, F.zip_with(pairs, c, lambda p, z: kernel(p["x"], p["y"], z))))


def matrix(rows: Scalar, cols: Scalar, data: Column) -> Column:
    return F.struct(K.col(rows).cast("int").alias("rows"), K.col(cols).cast("int").alias("cols"), data.alias("data"))


def on_matrix(lifted: Callable[[Column], Column], m: Column) -> Column:
    """A vector function applied to a matrix's data."""
    return matrix(m["rows"], m["cols"], lifted(m["data"]))


def on_matrices(lifted: Callable[[Column, Column], Column], a: Column, b: Column) -> Column:
    """A function of two vectors applied to two matrices; both dimensions must agree."""
    same = (a["rows"] == b["rows"]) & (a["cols"] == b["cols"])
    data = F.when(same, lifted(a["data"], b["data"])).otherwise(F.raise_error(F.lit("dimensions differ")))
    return matrix(a["rows"], a["cols"], data)


def _lift(kernel: Callable[..., Column], typed: bool = True) -> Callable[..., Column]:
    """Vector with vector, vector with scalar, or scalar with vector, by ``kind``: vv, vs or sv."""

    def run(a: Column | Scalar, b: Column | Scalar, kind: str = "vv", t: str = "double") -> Column:
        k = partial(kernel, t=t) if typed else kernel
        if kind == "vv":
            return map2(lambda x, y: k(x, y), a, b)
        if kind == "vs":
            return map1(lambda x: k(x, b), a)
        return map1(lambda x: k(a, x), b)

    return run


add, sub, mul, div, mod = (_lift(k) for k in (K.add, K.sub, K.mul, K.div, K.mod))
bit_and, bit_or, bit_xor, shift_left, shift_right = (_lift(k) for k in (K.bit_and, K.bit_or, K.bit_xor, K.shift_left, K.shift_right))
lt, gt, le, ge, eq, ne = (_lift(k) for k in (K.lt, K.gt, K.le, K.ge, K.eq, K.ne))
b_or, b_and, b_xor, b_eq, b_ne = (_lift(k, typed=False) for k in (K.b_or, K.b_and, K.b_xor, K.b_eq, K.b_ne))
maximum, minimum = _lift(K.maximum), _lift(K.minimum)


def plus(v: Column) -> Column:
    return v


def neg(v: Column, t: str = "double") -> Column:
    return map1(lambda x: K.neg(x, t), v)


def invert(v: Column, t: str = "int") -> Column:
    return map1(lambda x: K.invert(x, t), v)


def b_not(v: Column) -> Column:
    return map1(K.b_not, v)


def div_scalar(v: Column, s: Scalar, t: str = "double") -> Column:
    """Vector by scalar; a zero scalar raises."""
    return F.when(K.col(s) == 0, F.raise_error(F.lit("division by zero"))).otherwise(div(v, s, "vs", t))


def mod_scalar(v: Column, s: Scalar, t: str = "double") -> Column:
    return F.when(K.col(s) == 0, F.raise_error(F.lit("division by zero"))).otherwise(mod(v, s, "vs", t))


def select(a: Column, b: Column, mask: Column) -> Column:
    """Elementwise: ``b`` where the mask is true, else ``a``."""
    return map3(lambda x, y, c: F.when(c, y).otherwise(x), a, b, mask)


def select_whole(a: Column, b: Column, flag: Column) -> Column:
    """One of two vectors or matrices, by one flag."""
    return F.when(flag, b).otherwise(a)


def element(v: Column, i: Scalar) -> Column:
    """Element ``i`` from 0; an error outside the vector."""
    i = K.col(i)
    return F.when((i >= 0) & (i < F.size(v)), F.get(v, i)).otherwise(F.raise_error(F.lit("index out of bounds")))


def from_end(v: Column, k: Scalar) -> Column:
    """Element N-1-k, so 0 is the last."""
    return element(v, F.size(v) - 1 - K.col(k))


def cell(m: Column, r: Scalar, c: Scalar, r_from_end: bool = False, c_from_end: bool = False) -> Column:
    """Element (r, c) of a matrix, either index counted from the end on request."""
    r = m["rows"] - 1 - K.col(r) if r_from_end else K.col(r)
    c = m["cols"] - 1 - K.col(c) if c_from_end else K.col(c)
    inside = (r >= 0) & (r < m["rows"]) & (c >= 0) & (c < m["cols"])
    return F.when(inside, F.get(m["data"], r * m["cols"] + c)).otherwise(F.raise_error(F.lit("index out of bounds")))


def transpose(m: Column) -> Column:
    rows, cols, data = m["rows"], m["cols"], m["data"]
    at = F.sequence(F.lit(0), F.size(data) - 1)
    turned = F.transform(at, lambda k: F.get(data, (k % rows) * cols + F.floor(k / rows).cast("int")))
    return matrix(cols, rows, F.when(F.size(data) > 0, turned).otherwise(data))


def view(m: Column, row: int, col: int, rows: int, cols: int, row_step: int = 1, col_step: int = 1) -> Column:
    """A strided sub-matrix as a matrix of its own; an error where it doesn't fit."""
    at = [F.get(m["data"], (F.lit(row + i * row_step)) * m["cols"] + F.lit(col + j * col_step)) for i in range(rows) for j in range(cols)]
    fits = (
        (F.lit(row) >= 0) & (F.lit(col) >= 0)
        & (F.lit(row + (rows - 1) * row_step) < m["rows"]) & (F.lit(col + (cols - 1) * col_step) < m["cols"])
    )
    return F.when(fits, matrix(rows, cols, F.array(*at))).otherwise(F.raise_error(F.lit("view out of bounds")))


def update_view(m: Column, kernel: Callable[..., Column], row: int, col: int, rows: int, cols: int, row_step: int = 1, col_step: int = 1, other: Column | None = None) -> Column:
    """The matrix with ``kernel`` applied to the elements of a view (what writing through it gives).

    With ``other``, a matrix of the view's shape (a view or not), the kernel takes
    its element at the same place too; another shape is an error.
    """
    r = lambda k: F.floor(k / m["cols"]).cast("int") - row
    c = lambda k: (k % m["cols"]) - col
    inside = lambda k: (
        (r(k) >= 0) & (r(k) <= (rows - 1) * row_step) & (r(k) % row_step == 0) & (c(k) >= 0) & (c(k) <= (cols - 1) * col_step) & (c(k) % col_step == 0)
    )
    if other is None:
        return on_matrix(lambda d: F.transform(d, lambda x, k: F.when(inside(k), kernel(x)).otherwise(x)), m)
    at = lambda k: F.get(other["data"], F.floor(r(k) / row_step).cast("int") * cols + F.floor(c(k) / col_step).cast("int"))
    fits = (other["rows"] == rows) & (other["cols"] == cols)
    data = F.transform(m["data"], lambda x, k: F.when(inside(k), kernel(x, at(k))).otherwise(x))
    return matrix(m["rows"], m["cols"], F.when(fits, data).otherwise(F.raise_error(F.lit("dimensions differ"))))


def total(v: Column, start: Column | None = None) -> Column:
    return F.aggregate(v, start if start is not None else F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column, start: int = 0, end: int = -1, t: str = "double") -> Column:
    """Inner product over [start, end); the end -1 means all.  Integers wrap."""
    stop = F.size(a) if end == -1 else F.lit(end)
    left, right = (F.slice(x, F.lit(start + 1), stop - start) for x in (a, b))
    if t in K.FLOATS:
        return same_dim(a, b, total(F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double")))).cast(t)
    return same_dim(
        a, b, F.aggregate(F.zip_with(left, right, lambda x, y: K.mul(x, y, t)), F.lit(0).cast(t), lambda acc, x: K.add(acc, x, t))
    )


def outer(a: Column, b: Column, t: str = "double") -> Column:
    """The outer product of two vectors as a matrix."""
    return matrix(F.size(a), F.size(b), F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: K.mul(x, y, t)))))


def reflect(incident: Column, normal: Column) -> Column:
    return let(2.0 * dot(incident, normal), lambda twice: map2(lambda i, n: i - twice * n, incident, normal))


def refract(incident: Column, normal: Column, eta: Scalar) -> Column:
    """Snell's refraction; the zero vector under total reflection."""
    eta = K.col(eta)

    def bend(ni: Column) -> Column:
        k = 1.0 - eta * eta * (1.0 - ni * ni)
        bent = let(eta * ni + F.sqrt(k), lambda along: map2(lambda i, n: eta * i - along * n, incident, normal))
        return F.when(k >= 0, bent).otherwise(map1(lambda _: F.lit(0.0), incident))

    return let(dot(normal, incident), bend)


def project(a: Column, b: Column) -> Column:
    return let(K.div(dot(a, b), dot(b, b)), lambda share: map1(lambda x: share * x, b))


def sincos(v: Column) -> Column:
    return F.struct(map1(F.sin, v).alias("sin"), map1(F.cos, v).alias("cos"))


def set_all(v: Column, s: Scalar, t: str = "double") -> Column:
    return map1(lambda _: K.col(s).cast(t), v)


def set_index(v: Column, first: int = 0, t: str = "double") -> Column:
    """Elements numbered from ``first``."""
    return F.transform(v, lambda _, i: (i + first).cast(t))


# Norms and statistics of one vector (or of a matrix's data).

def span(v: Column, start: int = 0, end: int = -1) -> Column:
    """[start, end) of a vector, checked."""
    stop = F.size(v) if end == -1 else F.lit(end)
    fits = (F.lit(start) >= 0) & (stop >= start) & (stop <= F.size(v))
    return F.when(fits, F.slice(v, F.lit(start + 1), stop - start)).otherwise(F.raise_error(F.lit("range out of bounds")))


def norm_l2(v: Column, start: int = 0, end: int = -1) -> Column:
    return F.sqrt(total(F.transform(span(v, start, end), lambda x: x.cast("double") * x.cast("double"))))


def sum_abs(v: Column) -> Column:
    return total(F.transform(v, lambda x: F.abs(x.cast("double"))))


def norm_l1(v: Column, start: int = 0, end: int = -1) -> Column:
    """The true L1 norm: the sum of absolute values."""
    return sum_abs(span(v, start, end))


def l1_mean(v: Column) -> Column:
    """The mean absolute value."""
    return K.div(sum_abs(v), F.size(v))


def max_abs(v: Column, start: int = 0, end: int = -1) -> Column:
    return F.aggregate(span(v, start, end), F.lit(0.0), lambda acc, x: K.maximum(acc, F.abs(x.cast("double"))))


def norm_lp(v: Column, p: Scalar, start: int = 0, end: int = -1) -> Column:
    """(sum |x|^p)^(1/p)."""
    p = K.col(p).cast("double")
    return F.pow(total(F.transform(span(v, start, end), lambda x: F.pow(F.abs(x.cast("double")), p))), 1.0 / p)


def scale_span(v: Column, factor: Column, start: int = 0, end: int = -1) -> Column:
    """[start, end) divided by a number, the rest as it is."""
    stop = F.size(v) if end == -1 else F.lit(end)
    return let(factor, lambda f: F.transform(v, lambda x, i: F.when((i >= start) & (i < stop), K.div(x, f)).otherwise(x.cast("double"))))


def normalize(v: Column, norm: Column, start: int = 0, end: int = -1) -> Column:
    """The vector over a norm of it, in [start, end)."""
    return scale_span(v, norm, start, end)


def mean(v: Column) -> Column:
    return F.when(F.size(v) > 0, K.div(total(F.transform(v, lambda x: x.cast("double"))), F.size(v)))


def variance(v: Column) -> Column:
    """Population variance (of one element: 0); null on an empty vector."""
    squares = let(mean(v), lambda m: F.transform(v, lambda x: (x.cast("double") - m) * (x.cast("double") - m)))
    return F.when(F.size(v) > 0, K.div(total(squares), F.size(v)))


def std_dev(v: Column) -> Column:
    return F.sqrt(variance(v))


def smallest(v: Column) -> Column:
    """NaN is passed over; null on an empty vector."""
    return F.array_min(F.filter(v, lambda x: ~F.isnan(x)))


def largest(v: Column) -> Column:
    return F.array_max(F.filter(v, lambda x: ~F.isnan(x)))


def median(v: Column) -> Column:
    return let(F.sort_array(v), lambda s: _middle(s, F.lit(0), F.size(s)))


def _middle(s: Column, first: Column, n: Column) -> Column:
    """The median of ``n`` sorted elements from ``first``."""
    half = F.floor(n / 2).cast("int")
    odd = F.get(s, first + half).cast("double")
    even = (F.get(s, first + half - 1).cast("double") + F.get(s, first + half).cast("double")) / 2
    return F.when(n < 1, F.lit(None).cast("double")).when(n % 2 == 1, odd).otherwise(even)


def quartiles(v: Column) -> Column:
    """struct<q1, q3>: with mid = n div 2, an odd n takes elements mid div 2 and mid + mid
    div 2; an even n takes means of the two around them; two elements are their own."""
    return let(F.sort_array(v), _quartiles)


def _quartiles(s: Column) -> Column:
    n = F.size(s)
    mid = F.floor(n / 2).cast("int")
    at = lambda i: F.get(s, i).cast("double")
    half = F.floor(mid / 2).cast("int")
    i = half - 1
    q1 = F.when(n % 2 == 1, at(half)).when(n == 2, at(F.lit(0))).otherwise((at(i) + at(i + 1)) / 2)
    q3 = F.when(n % 2 == 1, at(mid + half)).when(n == 2, at(F.lit(1))).otherwise((at(mid + i) + at(mid + i + 1)) / 2)
    return F.struct(q1.alias("q1"), q3.alias("q3"))


def mean_min_max_range(v: Column) -> Column:
    return F.struct(mean(v).alias("mean"), smallest(v).alias("min"), largest(v).alias("max"), (largest(v) - smallest(v)).alias("range"))


def full_stats(v: Column) -> Column:
    """The eleven-field summary of a vector."""
    return let(F.sort_array(v), _full_stats)


def _full_stats(v: Column) -> Column:
    q = _quartiles(v)
    return F.struct(
        F.size(v).cast("double").alias("count"), total(F.transform(v, lambda x: x.cast("double"))).alias("sum"), mean(v).alias("mean"),
        smallest(v).alias("min"), largest(v).alias("max"), (largest(v) - smallest(v)).alias("range"), _middle(v, F.lit(0), F.size(v)).alias("median"),
        q["q1"].alias("q1"), q["q3"].alias("q3"), std_dev(v).alias("std_dev"), variance(v).alias("variance"),
    )


# Predicates.

def any_nan(v: Column) -> Column:
    return F.exists(v, F.isnan)


def any_inf(v: Column) -> Column:
    return F.exists(v, lambda x: F.abs(x) == K.INF)


def is_zero(v: Column, epsilon: float = 0.0) -> Column:
    """All elements within epsilon of zero; NaN is not."""
    return F.forall(v, lambda x: K.le(F.abs(x), epsilon))


def max_zero_error(v: Column) -> Column:
    return max_abs(v)


def all_same(v: Column) -> Column:
    return F.forall(v, lambda x: x == F.get(v, F.lit(0)))


def all_equal_to(v: Column, s: Scalar) -> Column:
    return F.forall(v, lambda x: x == K.col(s))


def any_equal_to(v: Column, s: Scalar) -> Column:
    return F.exists(v, lambda x: x == K.col(s))


def _each(m: Column, test: Callable[[Column, Column, Column], Column], square: bool = False) -> Column:
    """All elements pass ``test(r, c, x)``."""
    marks = F.transform(m["data"], lambda x, k: test(F.floor(k / m["cols"]).cast("int"), k % m["cols"], x))
    ok = F.forall(marks, lambda x: x)
    return (m["rows"] == m["cols"]) & ok if square else ok


def is_identity(m: Column, epsilon: float = 0.0) -> Column:
    return _each(m, lambda r, c, x: K.le(F.abs(x - F.when(r == c, F.lit(1.0)).otherwise(F.lit(0.0))), epsilon), square=True)


def is_diagonal(m: Column, epsilon: float = 0.0) -> Column:
    return _each(m, lambda r, c, x: (r == c) | K.le(F.abs(x), epsilon))


def is_upper_triangular(m: Column, epsilon: float = 0.0) -> Column:
    return _each(m, lambda r, c, x: (c >= r) | K.le(F.abs(x), epsilon))


def is_lower_triangular(m: Column, epsilon: float = 0.0) -> Column:
    return _each(m, lambda r, c, x: (c <= r) | K.le(F.abs(x), epsilon))


def is_symmetric(m: Column, epsilon: float = 0.0) -> Column:
    other = lambda r, c: F.get(m["data"], c * m["cols"] + r)
    return _each(m, lambda r, c, x: K.le(F.abs(x - other(r, c)), epsilon), square=True)


def is_diagonal_mask(m: Column, compare: bool = True) -> Column:
    """A boolean matrix is ``compare`` on the diagonal and its opposite elsewhere."""
    return _each(m, lambda r, c, x: x == ((r == c) if compare else (r != c)))


# Permutations as array<int>: element i goes to place p[i].

def pivot(n: Scalar) -> Column:
    n = K.col(n)
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def swap(v: Column, i: Scalar, j: Scalar) -> Column:
    """Elements i and j exchanged; both are checked."""
    i, j = K.col(i), K.col(j)
    fits = (i >= 0) & (j >= 0) & (i < F.size(v)) & (j < F.size(v))
    moved = F.transform(v, lambda x, k: F.when(k == i, F.get(v, j)).when(k == j, F.get(v, i)).otherwise(x))
    return F.when(fits, moved).otherwise(F.raise_error(F.lit("index out of bounds")))


def inverse_pivot(p: Column) -> Column:
    return apply_pivot(F.transform(p, lambda _, i: i), p)


def apply_pivot(v: Column, p: Column) -> Column:
    """Scatter: out[p[i]] = v[i]."""
    return same_dim(v, p, F.transform(F.array_sort(F.zip_with(p, v, lambda k, x: F.struct(k.alias("k"), x.alias("x")))), lambda s: s["x"]))


def apply_inverse_pivot(v: Column, p: Column) -> Column:
    """Gather: out[i] = v[p[i]]."""
    return same_dim(v, p, F.transform(p, lambda k: F.get(v, k)))


def _moved(m: Column, p: Column, inverse: bool, by_rows: bool) -> Column:
    """Rows or columns of a packed matrix in the order of a pivot."""
    rows, cols = m["rows"], m["cols"]
    source = p if inverse else inverse_pivot(p)

    def turn(of: Column) -> Column:
        at = lambda k: F.get(of, F.floor(k / cols).cast("int")) * cols + k % cols if by_rows else F.floor(k / cols).cast("int") * cols + F.get(of, k % cols)
        return F.transform(m["data"], lambda _, k: F.get(m["data"], at(k)))

    fits = F.size(p) == (rows if by_rows else cols)
    return matrix(rows, cols, F.when(fits, let(source, turn)).otherwise(F.raise_error(F.lit("dimensions differ"))))


def apply_pivot_rows(m: Column, p: Column, inverse: bool = False) -> Column:
    """Scatter: row i goes to place p[i]; with ``inverse``, gather: row i is row p[i]."""
    return _moved(m, p, inverse, True)


def apply_pivot_columns(m: Column, p: Column, inverse: bool = False) -> Column:
    return _moved(m, p, inverse, False)


def copy_to(v: Column, target: Column) -> Column:
    """What ``target`` holds after ``v`` is copied into it: an error if their sizes differ."""
    return same_dim(v, target, v)
