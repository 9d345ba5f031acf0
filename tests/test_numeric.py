"""Kernels, vectors, factories and solvers against NumPy and by their properties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattiq.functions import kernels as K
from lattiq.functions import vectors as V
from lattiq.operators import long as L
from lattiq.operators import printing as P
from lattiq.operators import solvers as S
from lattiq.sources import factories as G

INF, NAN = math.inf, math.nan


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def values(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def vec(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def same(a, b):
    return all((math.isnan(x) and math.isnan(y)) or x == y for x, y in zip(a, b, strict=True))


def test_ieee_division_and_remainder(spark):
    assert same(values(spark, K.div(1.0, 0.0), K.div(-1.0, 0.0), K.div(1.0, -0.0), K.div(0.0, 0.0), K.div(NAN, 0.0)), [INF, -INF, -INF, NAN, NAN])
    assert same(values(spark, K.mod(5.5, 0.0), K.mod(5.5, 2.0), K.mod(-5.5, 2.0), K.mod(1.0, INF), K.mod(INF, 2.0)), [NAN, 1.5, -1.5, 1.0, NAN])


def test_nan_is_unordered(spark):
    assert values(spark, *[f(NAN, NAN) for f in (K.lt, K.gt, K.le, K.ge, K.eq)], K.ne(NAN, NAN), K.gt(NAN, 1.0)) == [False] * 5 + [True, False]
    assert values(spark, K.maximum(NAN, 1.0), K.minimum(NAN, 1.0)) == [1.0, 1.0]


def test_logarithms_outside_their_domain(spark):
    assert same(values(spark, K.log(0.0), K.log(-1.0), K.log2(0.0), K.log10(-1.0)), [-INF, NAN, -INF, NAN])


@pytest.mark.parametrize("t,bits", [("smallint", 16), ("int", 32), ("bigint", 64)])
def test_integers_wrap(spark, t, bits):
    top = (1 << (bits - 1)) - 1
    wrap = lambda x: (x + (1 << (bits - 1))) % (1 << bits) - (1 << (bits - 1))
    assert values(spark, K.add(top, 1, t), K.sub(-top, 5, t), K.mul(top, top, t), K.neg(-top - 1, t), K.absolute(-top - 1, t)) == [
        wrap(top + 1), wrap(-top - 5), wrap(top * top), wrap(top + 1), wrap(top + 1)
    ]
    assert values(spark, K.div(-7, 2, t), K.mod(-7, 2, t), K.shift_left(1, bits - 1 if bits > 16 else 15, t)) == [-3, -1, -(1 << (bits - 1))]


def test_errors(spark):
    for bad in (K.div(7, 0, "int"), V.add(vec(1), vec(1, 2)), V.div_scalar(vec(1), 0.0), V.element(vec(1), 1), V.swap(vec(1, 2), 0, 2), V.span(vec(1), 0, 2)):
        with pytest.raises(Exception):  # noqa: B017
            value(spark, bad)
    with pytest.raises(ValueError):
        G.basis(3, 3)
    with pytest.raises(ValueError):
        S.solve_lower(np.ones((3, 2)), np.ones(3))


def test_statistics_of_short_vectors(spark):
    for data in ([5.0], [1.0, 4.0], [3.0, 1.0, 2.0], [4.0, 1.0, 3.0, 2.0], [1.0, 2.0, 3.0, 4.0, 5.0], list(range(1, 8))):
        s = value(spark, V.full_stats(vec(*data)))
        assert np.isclose(s["mean"], np.mean(data)) and np.isclose(s["variance"], np.var(data)) and np.isclose(s["median"], np.median(data))
    assert [value(spark, V.quartiles(vec(*d))) for d in ([1, 2], [1, 2, 3, 4], [1, 2, 3, 4, 5])] == [(1.0, 2.0), (1.5, 3.5), (2.0, 4.0)]
    empty = F.array().cast("array<double>")
    assert values(spark, V.mean(empty), V.variance(empty), V.smallest(empty), V.median(empty)) == [None] * 4
    assert values(spark, V.l1_mean(vec(1, -3)), V.norm_l1(vec(1, -3)), V.norm_lp(vec(-2, 0), 3.0)) == [2.0, 4.0, pytest.approx(2.0)]


@pytest.mark.parametrize("direct", [0, 1_000_000])
def test_long_order_statistics_match_packed(spark, monkeypatch, direct):
    monkeypatch.setattr(L, "DIRECT_ROWS", direct)
    rows = [(g, float(x)) for g, n in enumerate((1, 2, 3, 4, 5, 8, 9), 1) for x in np.random.default_rng(g).integers(0, 4, n)]
    df = spark.createDataFrame(rows, "g int, x double")
    got = {r["g"]: (r["median"], r["q1"], r["q3"]) for r in L.order_stats(df, "x", "g").collect()}
    for g in got:
        xs = [x for k, x in rows if k == g]
        q = value(spark, V.quartiles(vec(*xs)))
        if len(xs) > 1:
            assert got[g] == (np.median(xs), q["q1"], q["q3"])
        else:
            assert got[g] == (xs[0],) * 3


def test_predicates_fail_on_nan(spark):
    m = V.matrix(2, 2, vec(1, NAN, 0, 1))
    assert values(spark, V.is_identity(m, 0.1), V.is_diagonal(m, 0.1), V.is_symmetric(m, 0.1), V.any_nan(m["data"]), V.is_zero(vec(NAN), 1.0)) == [False, False, False, True, False]
    assert values(spark, V.is_identity(G.identity(4)), V.is_symmetric(G.hilbert(4)), V.is_lower_triangular(V.matrix(2, 2, vec(1, 0, 3, 1)))) == [True] * 3
    assert values(spark, V.all_same(F.array().cast("array<boolean>")), V.any_inf(vec(1, -INF))) == [True, True]


def test_random_factories(spark):
    a, b = values(spark, G.random(500, -2, 3), G.random(500, -2, 3))
    assert a == b and min(a) >= -2 and max(a) < 3 and np.std(a) > 1
    assert a != value(spark, G.random(500, -2, 3, seed=1))
    assert math.isclose(value(spark, V.norm_l2(G.random_unit(64))), 1.0)
    assert set(value(spark, G.random(200, -1, 1, t="int"))) == {-1, 0}
    assert set(value(spark, G.random_bool(50))) == {True, False}
    assert value(spark, V.is_diagonal(G.random_diagonal(5, 1, 2)))


def test_householder_and_rotation_are_orthogonal(spark):
    for m in (G.householder(G.random_unit(8)), G.rotation(8, 1, 6, math.pi / 4), G.permutation(8, 5, 3)):
        one = spark.range(1).select(m.alias("m"))
        assert L.is_orthogonal(L.from_matrix(one), 1e-12).first()[0]


def test_pivots(spark):
    p = F.array(*[F.lit(k) for k in (2, 0, 3, 1)])
    v = vec(10, 11, 12, 13)
    scattered, gathered, back = values(spark, V.apply_pivot(v, p), V.apply_inverse_pivot(v, p), V.apply_inverse_pivot(V.apply_pivot(v, p), p))
    assert scattered == [11.0, 13.0, 10.0, 12.0] and gathered == [12.0, 10.0, 13.0, 11.0] and back == [10.0, 11.0, 12.0, 13.0]
    assert value(spark, V.inverse_pivot(p)) == [1, 3, 0, 2] and value(spark, P.pivot_log(p)) == "2031"


def test_printing(spark):
    assert value(spark, P.vector_log(vec(3, -4))) == "dim 2, L2 5.00000: +3.00 -4.00"
    assert value(spark, P.spy(V.matrix(2, 2, vec(1, 0, 0, 1)))) == "X  \n  X"
    assert value(spark, P.matrix_log(V.matrix(1, 2, vec(1.23456, 2)))).startswith("1.2346")


def test_reflect_refract_project(spark):
    i, n = np.array([0.6, -0.8]), np.array([0.0, 1.0])
    assert np.allclose(value(spark, V.reflect(vec(*i), vec(*n))), i - 2 * n * (i @ n))
    assert np.allclose(value(spark, V.project(vec(1, 2), vec(3, 0))), [1, 0])
    assert value(spark, V.refract(vec(*i), vec(*n), 5.0)) == [0.0, 0.0]


@pytest.mark.parametrize("n", [1, 2, 18, 64])
def test_lu(n):
    a = np.random.default_rng(n).uniform(1, 10, (n, n)) + 5 * np.eye(n)
    low, u, p = S.lu(a)
    assert np.abs(a[p] - low @ u).max() <= 1e-9 and np.allclose(low, np.tril(low)) and np.allclose(u, np.triu(u))
    x = np.arange(n) + 1.0
    assert np.allclose(S.lu_solve(low, u, p, a @ x), x)


@pytest.mark.parametrize("shape", [(16, 8), (128, 64), (5, 5), (4, 1)])
def test_qr(shape):
    a = np.random.default_rng(1).uniform(-1, 1, shape)
    q, r = S.qr(a)
    assert np.abs(a - q @ r).max() < 1e-10 and np.allclose(q.T @ q, np.eye(shape[1])) and np.allclose(r, np.triu(r))
    assert np.sign(r[0, 0]) == -np.sign(a[0, 0])
    b = np.random.default_rng(2).uniform(-1, 1, shape[0])
    assert np.allclose(S.least_squares(a, b), np.linalg.lstsq(a, b, rcond=None)[0])


def test_qr_of_hard_matrices():
    hilbert = 1 / (np.arange(20)[:, None] + np.arange(20) + 1)
    for a in (hilbert, np.zeros((6, 4)), np.eye(16)[np.random.default_rng(3).permutation(16)]):
        q, r = S.qr(a)
        assert np.abs(a - q @ r).max() < 1e-12


def test_singular_systems_are_flagged(spark):
    df = spark.range(1).select(V.matrix(2, 2, vec(1, 2, 2, 4)).alias("m"), vec(1, 1).alias("b"))
    assert S.with_lu_solution(df).first()["singular"] and S.with_lu(df).first()["singular"]


def test_tall_regression(spark):
    df = spark.range(1000).select((F.col("id") % 17).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("z"), F.lit(1.0).alias("one"))
    df = df.withColumn("y", 3 * F.col("x") - 2 * F.col("z") + 7)
    got = {r["term"]: r["coefficient"] for r in S.regress(df.repartition(7), ["x", "z", "one"], "y").collect()}
    assert np.allclose([got["x"], got["z"], got["one"]], [3, -2, 7])


@pytest.mark.parametrize("parts", [1, 8, 70])
def test_tall_regression_with_empty_partitions(spark, parts):
    """Fewer rows than partitions, and more partitions than one round takes."""
    rows = [(float(i), 1.0, 2.0 * i + 5) for i in range(3)]
    df = spark.createDataFrame(rows, "x double, one double, y double").repartition(parts)
    got = {r["term"]: r["coefficient"] for r in S.regress(df, ["x", "one"], "y").collect()}
    assert np.allclose([got["x"], got["one"]], [2, 5])
    assert S.tall_r(df.limit(0).select(F.array("x", "y").alias("v")), 2).shape == (2, 2)


def test_error_bounds_of_large_systems():
    draw = np.random.default_rng(314221)
    a = draw.uniform(-10, 10, (512, 512))
    a[np.diag_indices(512)] *= 2
    x = draw.uniform(1, 10, 512)
    assert np.abs(S.lu_solve(*S.lu(a), a @ x) - x).max() < 1e-3
    tall = draw.uniform(-1, 1, (1024, 512))
    q, r = S.qr(tall)
    assert np.abs(tall - q @ r).max() <= 1e-3


def test_batches_equal_single_systems():
    draw = np.random.default_rng(8)
    a, b = draw.uniform(-1, 1, (40, 6, 6)), draw.uniform(-1, 1, (40, 6))
    low, u, p = S.lu(a)
    x, (q, r) = S.lu_solve(low, u, p, b), S.qr(a)
    for k in range(40):
        one = S.lu(a[k])
        assert all(np.array_equal(m[k], n) for m, n in zip((low, u, p), one, strict=True))
        assert np.allclose(a[k] @ x[k], b[k]) and np.allclose(q[k] @ r[k], a[k]) and np.allclose(S.qr(a[k])[1], r[k])
    low, u, p = S.lu(a + 9 * np.eye(6), pivot=False)
    assert np.allclose(low @ u, a + 9 * np.eye(6)) and (p == np.arange(6)).all()


def test_systems_of_several_shapes_and_nulls(spark):
    rows = [(n, {"rows": n, "cols": n, "data": (np.eye(n) * (n + 1)).ravel().tolist()}, [1.0] * n) for n in (1, 2, 3, 2)]
    df = spark.createDataFrame([*rows, (9, None, [1.0]), (8, rows[0][1], None)], "n int, m struct<rows:int,cols:int,data:array<double>>, b array<double>").repartition(1)
    got = sorted((r["n"], r["x"]) for r in S.with_lu_solution(df).collect())
    assert got[:4] == [(1, [0.5]), (2, [1 / 3] * 2), (2, [1 / 3] * 2), (3, [0.25] * 3)] and {x for _, x in got[4:]} == {None}
    assert S.with_qr(df.limit(0)).count() == 0


@pytest.mark.parametrize("direct", [0, 1_000_000])
def test_order_statistics_of_awkward_values(spark, monkeypatch, direct):
    monkeypatch.setattr(L, "DIRECT_ROWS", direct)
    data = {None: [1.0, 5.0, None], 1: [NAN, 1.0, INF, -INF, 2.0], 2: [None], 3: [7.0] * 9, 4: [float(x) for x in np.random.default_rng(2).normal(size=5000)]}
    df = spark.createDataFrame([(g, x) for g, xs in data.items() for x in xs], "g int, x double")
    got = {r["g"]: (r["median"], r["q1"], r["q3"]) for r in L.order_stats(df, "x", "g").collect()}
    assert got[2] == (None,) * 3 and got[3] == (7.0,) * 3 and got[None] == (3.0, 1.0, 5.0) and got[1][0] == 2.0
    s = sorted(data[4])
    assert np.allclose(got[4], ((s[2499] + s[2500]) / 2, (s[1249] + s[1250]) / 2, (s[3749] + s[3750]) / 2))
    whole = L.order_stats(df.filter("g = 4"), "x").first()
    assert np.allclose([whole["median"], whole["q1"], whole["q3"]], got[4])


def test_gram_of_batches(spark):
    a = np.random.default_rng(5).normal(size=(300, 7))
    df = spark.createDataFrame([(r.tolist(),) for r in a] + [(None,)], "v array<double>").repartition(5)
    got = np.zeros((7, 7))
    for r in L.gram(df).collect():
        got[r["r"], r["c"]] = r["v"]
    assert np.allclose(got, a.T @ a) and L.gram(df.limit(0)).count() == 0
    with pytest.raises(Exception):  # noqa: B017
        L.gram(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "v array<double>").repartition(1)).collect()


def test_products_with_a_large_side(spark, monkeypatch):
    a, b = np.random.default_rng(6).integers(-9, 9, (2, 6, 6)).astype(float)
    long = lambda m: spark.createDataFrame([(i, j, float(m[i, j])) for i in range(6) for j in range(6)], "r int, c int, v double")
    for rows in (0, 36, 100):
        monkeypatch.setattr(L, "BROADCAST_ROWS", rows)
        got = {(r["r"], r["c"]): r["v"] for r in L.matmul(long(a), long(b)).collect()}
        assert all(got[i, j] == (a @ b)[i, j] for i in range(6) for j in range(6))


def test_copies_must_fit(spark):
    assert value(spark, V.copy_to(vec(1, 2), vec(3, 4))) == [1.0, 2.0]
    with pytest.raises(Exception):  # noqa: B017
        value(spark, V.copy_to(vec(1, 2), vec(3)))
    with pytest.raises(Exception):  # noqa: B017
        value(spark, V.update_view(V.matrix(2, 2, vec(1, 2, 3, 4)), lambda x, y: x + y, 0, 0, 2, 1, other=V.matrix(1, 2, vec(1, 2)))["data"])


def test_shapes_must_agree(spark):
    a = spark.createDataFrame([(0, 0, 1.0)], "r int, c int, v double")
    b = spark.createDataFrame([(0, 1, 1.0)], "r int, c int, v double")
    with pytest.raises(Exception):  # noqa: B017
        L.elementwise(a, b, K.add).collect()
    with pytest.raises(Exception):  # noqa: B017
        value(spark, V.on_matrices(V.add, V.matrix(1, 4, vec(1, 2, 3, 4)), V.matrix(4, 1, vec(1, 2, 3, 4)))["data"])
