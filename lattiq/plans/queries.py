"""One query per operator family over the test tables, with SQL that says the same.

A column is named after the operator it shows (``va3``, ``cmpv7``, ...; see
COVERAGE.md).  Numbers are rounded on both sides, because engines add in
different orders; ``+ 0.0`` takes the sign off a negative zero.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.functions import kernels as K
from lattiq.functions import vectors as V
from lattiq.operators import long as L
from lattiq.operators import printing as P
from lattiq.operators import solvers as S
from lattiq.sources import factories as G
from lattiq.sources import tables as T

class Stub:
    """Stands in for a module or a column where only the SQL of a table is wanted."""

    def _self(self, *_, **__):
        return self

    __getattr__ = __call__ = __getitem__ = __add__ = __radd__ = __sub__ = __rsub__ = __mul__ = __rmul__ = __truediv__ = __mod__ = _self
    __lt__ = __le__ = __gt__ = __ge__ = __eq__ = __ne__ = __and__ = __or__ = __invert__ = __neg__ = _self
    __hash__ = None


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

CELLS = """WITH e AS (SELECT vec_id AS id, unnest(range(64))::INT AS i, unnest(embedding)::DOUBLE AS x,
  unnest(list_reverse(embedding))::DOUBLE AS y FROM embeddings),
f AS (SELECT id, i, x, y, floor(x * 1000)::BIGINT AS p, (2 * floor(y * 1000) + 1)::BIGINT AS q, x > 0 AS b, y > 0 AS c FROM e)
"""


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id; v, w (double); p, q (int, q odd); b, c (boolean) vectors, and the same as 8 x 8 matrices."""
    df = T.vectors(T.table(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumn("w", F.reverse("v"))
    whole = lambda x: F.floor(x * 1000)
    df = df.withColumns(
        {
            "p": F.transform("v", lambda x: whole(x).cast("int")), "q": F.transform("w", lambda x: (2 * whole(x) + 1).cast("int")),
            "b": F.transform("v", lambda x: x > 0), "c": F.transform("w", lambda x: x > 0),
        }
    )
    return df.withColumns({f"m{k}": V.matrix(8, 8, F.col(k)) for k in "vwpqbc"})


def rounded(c: Column, kind: str, digits: int = 6) -> Column:
    return (F.round(c, digits) + F.lit(0.0)) if kind == "float" else c


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return run

    return keep


def tables(V, F, G, P, K, cells, scalars, family, made) -> None:  # noqa: N803
    """Registers every table of operators; with stand-ins for the modules only its SQL counts."""
    v, w, p, q, b, c = (F.col(k) for k in "vwpqbc")
    mv, mw, mp, mq, mb, mc = (F.col(f"m{k}") for k in "vwpqbc")

    # Float arithmetic.
    _ARITHMETIC = [
        (V.plus, "x", 1), (V.neg, "-x", 1), (lambda a: V.add(a, 2.5, "vs"), "x + 2.5", 1), (lambda a: V.add(2.5, a, "sv"), "2.5 + x", 1),
        (lambda a: V.sub(a, 2.5, "vs"), "x - 2.5", 1), (lambda a: V.sub(2.5, a, "sv"), "2.5 - x", 1), (lambda a: V.mul(a, 2.5, "vs"), "x * 2.5", 1),
        (lambda a: V.mul(2.5, a, "sv"), "2.5 * x", 1), (lambda a: V.div_scalar(a, 2.5), "x / 2.5", 1), (lambda a: V.div(2.5, a, "sv"), "2.5 / x", 1),
        (lambda a: V.mod_scalar(a, 0.3), "x % 0.3::DOUBLE", 1), (lambda a: V.mod(2.5, a, "sv"), "2.5::DOUBLE % x", 1), (V.add, "x + y", 2), (V.sub, "x - y", 2),
        (V.mul, "x * y", 2), (V.div, "x / y", 2), (V.mod, "x % y", 2),
    ]


    family(("va", "ma"), _ARITHMETIC, (v, w), (mv, mw), ("vector_arithmetic", "matrix_arithmetic"), "float")


    def _wrapped(sql: str, bits: int) -> str:
        half, full = 1 << (bits - 1), 1 << bits
        return f"((({sql})::HUGEINT + {half}) % {full} + {full}) % {full} - {half}"


    def _integers(t: str, bits: int) -> list:
        k = lambda f, *a, **o: (lambda *x: f(*x, *a, t=t, **o))
        big = (1 << (bits - 1)) - 5  # near the end of the type, so that sums and products wrap
        table = [
            (V.plus, "p", 1), (k(V.neg), "-p", 1), (lambda a: V.add(a, big, "vs", t), f"p::HUGEINT + {big}", 1), (lambda a: V.add(big, a, "sv", t), f"{big} + p::HUGEINT", 1),
            (lambda a: V.sub(a, 7, "vs", t), "p - 7", 1), (lambda a: V.sub(7, a, "sv", t), "7 - p", 1), (lambda a: V.mul(a, big, "vs", t), f"p::HUGEINT * {big}", 1),
            (lambda a: V.mul(big, a, "sv", t), f"{big} * p::HUGEINT", 1), (lambda a: V.div_scalar(a, 7, t), "p // 7", 1),
            (lambda a: V.div(5000, V.add(V.mul(a, 2, "vs", t), 1, "vs", t), "sv", t), "5000 // (2 * p + 1)", 1), (lambda a: V.mod_scalar(a, 7, t), "p % 7", 1),
            (lambda a: V.mod(5000, V.add(V.mul(a, 2, "vs", t), 1, "vs", t), "sv", t), "5000 % (2 * p + 1)", 1), (k(V.add), "p + q", 2), (k(V.sub), "p - q", 2),
            (k(V.mul), "p * q", 2), (k(V.div), "p // q", 2), (k(V.mod), "p % q", 2), (k(V.invert), "~p", 1), (lambda a: V.bit_and(a, 93, "vs", t), "p & 93", 1),
            (lambda a: V.bit_and(93, a, "sv", t), "93 & p", 1), (lambda a: V.bit_or(a, 93, "vs", t), "p | 93", 1), (lambda a: V.bit_or(93, a, "sv", t), "93 | p", 1),
            (lambda a: V.bit_xor(a, 93, "vs", t), "xor(p, 93)", 1), (lambda a: V.bit_xor(93, a, "sv", t), "xor(93, p)", 1),
            (lambda a: V.shift_left(a, 3, "vs", t), "p * 8", 1), (lambda a: V.shift_right(a, 3, "vs", t), "p >> 3", 1), (k(V.bit_and), "p & q", 2),
            (k(V.bit_or), "p | q", 2), (k(V.bit_xor), "xor(p, q)", 2),
        ]
        return [(f, _wrapped(s, bits), n) for f, s, n in table]


    for _t, _bits in (("int", 32), ("smallint", 16), ("bigint", 64)):
        _of = lambda a, t=_t: a.cast(f"array<{t}>")
        _mat = lambda m, t=_t: V.matrix(m["rows"], m["cols"], m["data"].cast(f"array<{t}>"))
        _end = "" if _t == "int" else f"_{_t}"
        family(("iv", "im"), _integers(_t, _bits), (_of(p), _of(q)), (_mat(mp), _mat(mq)), (f"vector_integers{_end}", f"matrix_integers{_end}"), _t)

    cells(
        "shifts", "int",
        lambda: {
            "inp21": (V.shift_left(3, V.bit_and(p, 7, "vs", "int"), "sv", "int"), "3 * pow(2, p & 7)"), "inp23": (V.shift_right(4000, V.bit_and(p, 7, "vs", "int"), "sv", "int"), "4000 >> (p & 7)"),
            "inp27": (V.shift_left(p, V.bit_and(q, 7, "vs", "int"), t="int"), "p * pow(2, q & 7)"), "inp28": (V.shift_right(p, V.bit_and(q, 7, "vs", "int"), t="int"), "p >> (q & 7)"),
        },
    )

    # Comparison.
    _COMPARE = []
    for _name, _op in (("lt", "<"), ("gt", ">"), ("le", "<="), ("ge", ">="), ("eq", "="), ("ne", "<>")):
        _f = getattr(V, _name)
        _COMPARE += [(lambda a, f=_f: f(a, 0.05, "vs"), f"x {_op} 0.05", 1), (lambda a, f=_f: f(0.05, a, "sv"), f"0.05 {_op} x", 1)]
    _COMPARE += [(getattr(V, n), f"x {o} y", 2) for n, o in (("lt", "<"), ("gt", ">"), ("le", "<="), ("ge", ">="), ("eq", "="), ("ne", "<>"))]
    family(("cmpv", "cmpm"), _COMPARE, (v, w), (mv, mw), ("vector_comparison", "matrix_comparison"), "bool")

    whole = [(lambda a, f=getattr(V, n): f(a, 7, "vs", "int"), f"p {o} 7", 1) for n, o in (("lt", "<"), ("gt", ">"), ("le", "<="), ("ge", ">="), ("eq", "="), ("ne", "<>"))]
    whole += [(lambda a, f=getattr(V, n): f(7, a, "sv", "int"), f"7 {o} p", 1) for n, o in (("lt", "<"), ("gt", ">"), ("le", "<="), ("ge", ">="), ("eq", "="), ("ne", "<>"))]
    whole += [(lambda x, y, f=getattr(V, n): f(x, y, t="int"), f"p {o} q", 2) for n, o in (("lt", "<"), ("gt", ">"), ("le", "<="), ("ge", ">="), ("eq", "="), ("ne", "<>"))]
    family(("twv", "twm"), whole, (p, q), (mp, mq), ("vector_comparison_int", "matrix_comparison_int"), "bool")
    single = lambda x: x.cast("array<float>")
    double = lambda x: x.cast("array<double>")
    cells(
        "vector_arithmetic_float", "float",
        lambda: {
            "va13": (double(V.add(single(v), single(w), t="float")), "(x::FLOAT + y::FLOAT)::DOUBLE"), "va14": (double(V.sub(single(v), single(w), t="float")), "(x::FLOAT - y::FLOAT)::DOUBLE"),
            "va15": (double(V.mul(single(v), single(w), t="float")), "(x::FLOAT * y::FLOAT)::DOUBLE"), "va9": (double(V.div_scalar(single(v), 3.0, "float")), "(x::FLOAT / 3::FLOAT)::DOUBLE"),
        },
    )

    # Boolean algebra.
    _BOOLEAN = []
    for _name, _op in (("b_or", "{} OR {}"), ("b_and", "{} AND {}"), ("b_xor", "{} <> {}"), ("b_eq", "{} = {}"), ("b_ne", "{} <> {}")):
        _f = getattr(V, _name)
        for _s in (True, False):
            _BOOLEAN.append(((lambda a, f=_f, s=_s: f(a, s, "vs")) if _s else (lambda a, f=_f, s=_s: f(s, a, "sv")), _op.format("b", str(_s).upper()), 1))
    _BOOLEAN += [(V.b_not, "NOT b", 1)]
    _BOOLEAN += [(getattr(V, n), o.format("b", "c"), 2) for n, o in (("b_or", "{} OR {}"), ("b_and", "{} AND {}"), ("b_xor", "{} <> {}"), ("b_eq", "{} = {}"), ("b_ne", "{} <> {}"))]
    family(("bv", "bm"), _BOOLEAN, (b, c), (mb, mc), ("vector_booleans", "matrix_booleans"), "bool")

    # Selection.
    cells(
        "selection", "float",
        lambda: {
            "prj16": (V.select(v, w, b), "CASE WHEN b THEN y ELSE x END"),
            "prj17": (V.on_matrices(lambda x, y: V.select(x, y, mb["data"]), mv, mw)["data"], "CASE WHEN b THEN y ELSE x END"),
            "prj18": (V.select_whole(v, w, F.col("id") % 2 == 0), "CASE WHEN id % 2 = 0 THEN y ELSE x END"),
            "prj19": (V.select_whole(mv, mw, F.col("id") % 2 == 0)["data"], "CASE WHEN id % 2 = 0 THEN y ELSE x END"),
        },
    )
    cells("selection_booleans", "bool", lambda: {"prj20": (V.select(b, c, V.b_not(b)), "CASE WHEN NOT b THEN c ELSE b END")})

    # Mathematics: argument in SQL, the function there, and how the argument is made here.
    _SHAPED = {"x": lambda x: x, "abs(x)": F.abs, "1 + abs(x)": lambda x: 1 + F.abs(x), "10 * x": lambda x: 10 * x}
    _applied = lambda f, a: lambda x: K.UNARY[f](_SHAPED[a](x))
    _MATH = {
        "mth4": ("abs", "x", "abs({})"), "mth5": ("sign", "x", "sign({})::DOUBLE"), "mth6": ("sqrt", "abs(x)", "sqrt({})"), "mth7": ("acos", "x", "acos({})"),
        "mth8": ("asin", "x", "asin({})"), "mth9": ("atan", "10 * x", "atan({})"), "mth10": ("ceil", "10 * x", "ceil({})"), "mth11": ("cos", "10 * x", "cos({})"),
        "mth12": ("cosh", "x", "cosh({})"), "mth13": ("exp", "x", "exp({})"), "mth14": ("exp2", "x", "pow(2, {})"), "mth15": ("exp10", "x", "pow(10, {})"),
        "mth16": ("floor", "10 * x", "floor({})"), "mth17": ("log", "1 + abs(x)", "ln({})"), "mth18": ("log2", "1 + abs(x)", "log2({})"),
        "mth19": ("log10", "1 + abs(x)", "log10({})"), "mth22": ("round", "10 * x", "round_even({}, 0)"), "mth23": ("sin", "10 * x", "sin({})"),
        "mth24": ("sinh", "x", "sinh({})"), "mth25": ("tan", "x", "tan({})"), "mth26": ("tanh", "x", "tanh({})"), "mth29": ("acosh", "1 + abs(x)", "acosh({})"),
        "mth31": ("degrees", "x", "degrees({})"), "mth32": ("radians", "x", "radians({})"), "mth36": ("rcp", "1 + abs(x)", "1 / ({})"),
        "mth38": ("relu", "x", "greatest({}, 0)"), "mth41": ("saturate", "10 * x", "greatest(0, least(1, {}))"), "mth42": ("frac", "10 * x", "({0}) - floor({0})"),
        "mth44": ("rsqrt", "1 + abs(x)", "1 / sqrt({})"),
    }
    cells("math_unary", "float", lambda: {k: (V.map1(_applied(f, a), v), s.format(a)) for k, (f, a, s) in _MATH.items()})
    _smooth = "(t * t * (3 - 2 * t))"
    _sat = "greatest(0, least(1, {}))"
    cells(
        "math_more", "float",
        lambda: {
            "mth1": (V.set_all(v, 1.5), "1.5::DOUBLE"), "mth2": (V.set_index(v), "i::DOUBLE"), "mth3": (V.set_index(v, 1), "(i + 1)::DOUBLE"),
            "mth20": (V.maximum(v, w), "greatest(x, y)"), "mth21": (V.minimum(v, w), "least(x, y)"), "mth27": (F.transform(v, lambda x: K.power(x, 3)), "pow(x, 3)"),
            "mth28": (V.map2(F.atan2, v, w), "atan2(x, y)"), "mth30": (F.transform(v, lambda x: K.clamp(x, -0.1, 0.1)), "greatest(-0.1, least(0.1, x))"),
            "mth33": (V.map2(lambda x, y: K.lerp(x, y, 0.25), v, w), "x + 0.25 * (y - x)"),
            "mth34": (V.map2(lambda x, y: K.unlerp(x, 2 + F.abs(y), 0.25), v, w), "(0.25 - x) / (2 + abs(y) - x)"),
            "mth35": (V.map2(lambda x, y: K.smoothstep(x, 2 + F.abs(y), 0.5), v, w), _smooth.replace("t", _sat.format("(0.5 - x) / (2 + abs(y) - x)"))),
            "mth37": (V.mod(v, 0.07, "vs"), "x % 0.07::DOUBLE"), "mth43": (V.mod(v, 0.11, "vs"), "x % 0.11::DOUBLE"),
            "mth39": (F.transform(v, lambda x: K.remap(x, -1.0, 1.0, 5.0, 9.0)), "5 + (x + 1) / 2 * 4"), "mth40": (V.map3(K.mad, v, w, v), "x * y + x"),
            "mth45": (V.map2(K.BINARY["distance"], v, w), "abs(x - y)"), "mth46": (V.map2(K.BINARY["distancesq"], v, w), "(x - y) * (x - y)"),
            "mth47": (F.transform(v, lambda x: K.smoothstep(-0.2, 0.2, x)), _smooth.replace("t", _sat.format("(x + 0.2) / 0.4"))),
            "mth48": (F.transform(v, lambda x: K.step(x, 0.05)), "CASE WHEN x >= 0.05 THEN 1.0 ELSE 0.0 END::DOUBLE"),
            "mth53s": (V.sincos(v)["sin"], "sin(x)"), "mth53c": (V.sincos(v)["cos"], "cos(x)"),
        },
    )
    cells(
        "math_integers", "int",
        lambda: {
            "mthi1": (V.set_all(p, 3, "int"), "3"), "mthi2": (V.set_index(p, 0, "int"), "i"), "mthi3": (V.set_index(p, 1, "int"), "i + 1"),
            "mthi4": (V.map1(lambda x: K.absolute(x, "int"), p), "abs(p)"), "mthi5": (V.maximum(p, q, t="int"), "greatest(p, q)"), "mthi6": (V.minimum(p, q, t="int"), "least(p, q)"),
            "mthi7": (V.map1(lambda x: K.clamp(x, -50, 50, "int"), p), "greatest(-50, least(50, p))"), "mthi8": (V.mod(p, 13, "vs", "int"), "p % 13"),
            "mthi9": (V.map1(lambda x: K.relu(x, "int"), p), "greatest(p, 0)"), "mthi10": (V.map3(lambda x, y, z: K.mad(x, y, z, "int"), p, q, p), "p * q + p"),
        },
    )
    cells(
        "normalization", "float",
        lambda: {
            "agg4": (V.normalize(v, V.norm_l2(v)), "x / sqrt(sum(x * x) OVER (PARTITION BY id))"), "agg6": (V.normalize(v, V.norm_l1(v)), "x / sum(abs(x)) OVER (PARTITION BY id)"),
            "agg5": (V.normalize(v, V.norm_l2(v, 8, 24), 8, 24), "CASE WHEN i BETWEEN 8 AND 23 THEN x / sqrt(sum(CASE WHEN i BETWEEN 8 AND 23 THEN x * x END) OVER (PARTITION BY id)) ELSE x END"),
            "agg7": (V.normalize(v, V.norm_l1(v, 8, 24), 8, 24), "CASE WHEN i BETWEEN 8 AND 23 THEN x / sum(CASE WHEN i BETWEEN 8 AND 23 THEN abs(x) END) OVER (PARTITION BY id) ELSE x END"),
            "agg8": (V.normalize(v, V.max_abs(v)), "x / max(abs(x)) OVER (PARTITION BY id)"),
            "agg9": (V.normalize(v, V.max_abs(v, 8, 24), 8, 24), "CASE WHEN i BETWEEN 8 AND 23 THEN x / max(CASE WHEN i BETWEEN 8 AND 23 THEN abs(x) END) OVER (PARTITION BY id) ELSE x END"),
            "agg10": (V.normalize(v, V.norm_lp(v, 3.0)), "x / pow(sum(pow(abs(x), 3)) OVER (PARTITION BY id), 1.0 / 3)"),
            "agg11": (V.normalize(v, V.norm_lp(v, 3.0, 8, 24), 8, 24), "CASE WHEN i BETWEEN 8 AND 23 THEN x / pow(sum(CASE WHEN i BETWEEN 8 AND 23 THEN pow(abs(x), 3) END) OVER (PARTITION BY id), 1.0 / 3) ELSE x END"),
        },
    )
    cells(
        "vector_products", "float",
        lambda: {
            "mth50": (V.reflect(v, w), "x - 2 * y * sum(x * y) OVER (PARTITION BY id)"), "mth52": (V.project(v, w), "sum(x * y) OVER (PARTITION BY id) / sum(y * y) OVER (PARTITION BY id) * y"),
            "mth51": (
                V.refract(v, w, 0.7),
                "0.7 * x - (0.7 * sum(x * y) OVER (PARTITION BY id) + sqrt(1 - 0.49 * (1 - pow(sum(x * y) OVER (PARTITION BY id), 2)))) * y",
            ),
        },
    )
    cells(
        "permutations", "float",
        lambda: {
            "piv8": (V.apply_pivot(v, V.map1(lambda i: F.pmod(i * 5 + 3, F.lit(64)).cast("int"), V.pivot(64))), "list(x) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)[((i - 3 + 64) * 13) % 64 + 1]"),
            "piv14": (V.apply_inverse_pivot(v, V.map1(lambda i: F.pmod(i * 5 + 3, F.lit(64)).cast("int"), V.pivot(64))), "list(x) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)[(i * 5 + 3) % 64 + 1]"),
            "piv17": (V.swap(v, 3, 60), "CASE i WHEN 3 THEN list(x) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)[61] WHEN 60 THEN list(x) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)[4] ELSE x END"),
        },
    )
    cells(
        "pivots", "int",
        lambda: {"piv1": (V.pivot(64), "i"), "piv3": (V.swap(V.pivot(64), 2, 9), "CASE i WHEN 2 THEN 9 WHEN 9 THEN 2 ELSE i END"), "piv6": (V.inverse_pivot(V.map1(lambda i: F.pmod(i * 5 + 3, F.lit(64)).cast("int"), V.pivot(64))), "((i - 3 + 64) * 13) % 64")},
    )


    _s = "list(x ORDER BY x)"
    _full, _four = V.full_stats(v), V.mean_min_max_range(v)
    scalars(
        "vector_statistics",
        lambda: {
            "agg1": (V.norm_l2(v), "sqrt(sum(x * x))", "float"), "agg2": (V.l1_mean(v), "avg(abs(x))", "float"), "l1": (V.norm_l1(v), "sum(abs(x))", "float"),
            "agg3": (V.norm_l2(v, 8, 24), "sqrt(sum(x * x) FILTER (i BETWEEN 8 AND 23))", "float"), "agg13": (V.sum_abs(v), "sum(abs(x))", "float"),
            "agg14": (V.max_abs(v), "max(abs(x))", "float"), "agg15": (V.total(v), "sum(x)", "float"), "agg16": (V.mean(v), "avg(x)", "float"),
            "agg17": (V.variance(v), "var_pop(x)", "float"), "agg18": (V.std_dev(v), "stddev_pop(x)", "float"), "agg19": (V.smallest(v), "min(x)", "float"),
            "agg20": (V.largest(v), "max(x)", "float"), "agg21": (V.median(v), "median(x)", "float"), "agg22": (V.largest(v) - V.smallest(v), "max(x) - min(x)", "float"),
            "agg23_mean": (_four["mean"], "avg(x)", "float"), "agg23_range": (_four["range"], "max(x) - min(x)", "float"), "agg24_count": (_full["count"], "count(*)", "float"),
            "agg24_q1": (_full["q1"], f"({_s}[16] + {_s}[17]) / 2", "float"), "agg24_q3": (_full["q3"], f"({_s}[48] + {_s}[49]) / 2", "float"),
            "agg24_median": (_full["median"], "median(x)", "float"), "agg24_std_dev": (_full["std_dev"], "stddev_pop(x)", "float"),
        },
    )
    scalars(
        "dot_products",
        lambda: {
            "dot1": (V.dot(v, w), "sum(x * y)", "float"), "dot2": (V.dot(v, w, 5, 40), "sum(x * y) FILTER (i BETWEEN 5 AND 39)", "float"),
            "dot8": (V.dot(p, q, t="int"), "sum(p * q)", "int"), "krn38": (V.dot(p, q, 5, 40, "int"), "sum(p * q) FILTER (i BETWEEN 5 AND 39)", "int"),
        },
    )
    scalars(
        "element_access",
        lambda: {
            "prj1": (V.element(v, 5), "max(x) FILTER (i = 5)", "float"), "prj2": (V.from_end(v, 0), "max(x) FILTER (i = 63)", "float"), "prj3": (V.element(mv["data"], 9), "max(x) FILTER (i = 9)", "float"),
            "prj4": (V.from_end(mv["data"], 9), "max(x) FILTER (i = 54)", "float"), "prj5": (V.cell(mv, 2, 3), "max(x) FILTER (i = 19)", "float"), "prj6": (V.cell(mv, 2, 1, False, True), "max(x) FILTER (i = 22)", "float"),
            "prj7": (V.cell(mv, 1, 3, True), "max(x) FILTER (i = 51)", "float"), "prj8": (V.cell(mv, 0, 0, True, True), "max(x) FILTER (i = 63)", "float"), "src50": (G.to_pair(v)["y"], "max(x) FILTER (i = 1)", "float"),
            "src45": (V.total(G.from_columns(*[V.element(v, k) for k in range(3)])), "sum(x) FILTER (i < 3)", "float"),
            "src47": (V.cell(G.from_column_major(2, *[V.element(v, k) for k in range(4)]), 0, 1), "max(x) FILTER (i = 2)", "float"),
        },
    )
    scalars(
        "vector_predicates",
        lambda: {
            "anl1": (V.any_nan(v), "bool_or(isnan(x))", "bool"), "anl3": (V.any_inf(v), "bool_or(isinf(x))", "bool"), "anl5": (V.is_zero(v, 0.35), "bool_and(abs(x) <= 0.35)", "bool"),
            "anl8": (V.max_zero_error(v), "max(abs(x))", "float"), "bag2": (V.all_same(b), "min(b) = max(b)", "bool"), "bag3": (V.all_equal_to(b, True), "bool_and(b)", "bool"), "bag4": (V.any_equal_to(b, True), "bool_or(b)", "bool"),
            "anl14": (V.is_diagonal(mv, 0.3), "bool_and(abs(x) <= 0.3) FILTER (i % 9 <> 0)", "bool"), "anl16": (V.is_upper_triangular(mv, 0.25), "bool_and(abs(x) <= 0.25) FILTER (i % 8 < i // 8)", "bool"),
            "anl18": (V.is_lower_triangular(mv, 0.25), "bool_and(abs(x) <= 0.25) FILTER (i % 8 > i // 8)", "bool"),
            "anl12": (V.is_symmetric(mv, 0.6), f"bool_and(abs(x - 0) < 9) AND list_bool_and(list_transform(range(64), lambda k: abs({'list(x ORDER BY i)'}[k + 1] - {'list(x ORDER BY i)'}[(k % 8) * 8 + k // 8 + 1]) <= 0.6))", "bool"),
            "anl10": (V.is_identity(mv, 1.2), "bool_and(abs(x - CASE WHEN i % 9 = 0 THEN 1 ELSE 0 END) <= 1.2)", "bool"), "bag1": (V.is_diagonal_mask(mb), "bool_and(b = (i % 9 = 0))", "bool"),
            "snk5": (P.mask_log(b), "string_agg(CASE WHEN b THEN 'T' ELSE 'F' END, '' ORDER BY i)", "text"),
            "snk4": (P.spy(mv, 0.1), "string_agg(CASE WHEN abs(x) >= 0.1 THEN 'X' ELSE ' ' END || CASE WHEN i = 63 THEN '' WHEN i % 8 = 7 THEN chr(10) ELSE ' ' END, '' ORDER BY i)", "text"),
            "snk6": (P.mask_spy(mb), "string_agg(CASE WHEN b THEN 'X' ELSE ' ' END || CASE WHEN i = 63 THEN '' WHEN i % 8 = 7 THEN chr(10) ELSE ' ' END, '' ORDER BY i)", "text"),
        },
    )


    cells("transpose_packed", "float", lambda: {"prj15": (V.transpose(mv), "list(x) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)[(i % 8) * 8 + i // 8 + 1]")}, matrix=True)
    cells("view_updates", "bool", lambda: {"prj12": (V.update_view(mb, lambda x: K.b_or(x, True), 1, 2, 3, 3, 2, 2), "b OR (i // 8 IN (1, 3, 5) AND i % 8 IN (2, 4, 6))")}, matrix=True)

    made(lambda: {
        "src1": (G.zeros(64), "0.0"), "src2": (G.full(64, 2.5), "2.5"), "src4": (G.mat_zeros(8, 8)["data"], "0.0"), "src5": (G.mat_full(8, 8, 1.5)["data"], "1.5"), "src18": (G.index(64), "i"),
        "src19": (G.index(64, 1), "i + 1"), "src20": (G.basis(64, 5), "(i = 5)::INT"), "src23": (G.linspace(64, -1, 2), "-1 + i / 63.0::DOUBLE * 3"), "src24": (G.identity(8)["data"], "(i % 9 = 0)::INT"),
        "src25": (G.diagonal(8, 3.5)["data"], "CASE WHEN i % 9 = 0 THEN 3.5 ELSE 0 END"), "src26": (G.diagonal_of(G.index(8, 1))["data"], "CASE WHEN i % 9 = 0 THEN i // 9 + 1 ELSE 0 END"),
        "src27": (G.mat_index(8, 8)["data"], "i"), "src28": (G.mat_index(8, 8, 1)["data"], "i + 1"),
        "src32": (G.rotation(8, 1, 6, 0.5)["data"], "CASE WHEN i IN (9, 54) THEN cos(0.5) WHEN i = 14 THEN -sin(0.5) WHEN i = 49 THEN sin(0.5) WHEN i % 9 = 0 THEN 1 ELSE 0 END"),
        "src33": (G.permutation(8, 2, 5)["data"], "CASE WHEN i // 8 = 2 THEN (i % 8 = 5)::INT WHEN i // 8 = 5 THEN (i % 8 = 2)::INT ELSE (i % 9 = 0)::INT END"),
        "src34": (G.householder(G.index(8, 1))["data"], "(i % 9 = 0)::INT - 2 * (i // 8 + 1) * (i % 8 + 1) / 204.0::DOUBLE"), "src35": (G.hilbert(8)["data"], "1.0::DOUBLE / (i // 8 + i % 8 + 1)"),
        "src37": (G.linspace(64, 0, 100, "int").cast("array<double>"), "trunc(i / 63.0::DOUBLE * 100)"), "src3": (G.mat_zeros(8)["data"], "0"),
        "src52": (G.zeros(64), "0"), "sol15": (G.householder_update(G.identity(8), G.index(8, 1))["data"], "(i % 9 = 0)::INT - 2 * (i // 8 + 1) * (i % 8 + 1) / 204.0::DOUBLE"),
    })
    made(lambda: {
        "tw13": (G.zeros(64, "int"), "0"), "tw14": (G.full(64, 7, "int"), "7"), "tw18": (G.mat_zeros(8, t="int")["data"], "0"), "tw19": (G.mat_zeros(8, 8, "int")["data"], "0"),
        "tw20": (G.mat_full(8, 8, 5, "int")["data"], "5"), "tw31": (G.index(64, 0, "int"), "i"), "tw32": (G.index(64, 1, "int"), "i + 1"), "tw33": (G.basis(64, 5, "int"), "(i = 5)::INT"),
        "tw34": (G.identity(8, "int")["data"], "(i % 9 = 0)::INT"), "tw35": (G.diagonal(8, 3, "int")["data"], "CASE WHEN i % 9 = 0 THEN 3 ELSE 0 END"),
        "tw36": (G.diagonal_of(G.index(8, 1, "int"), "int")["data"], "CASE WHEN i % 9 = 0 THEN i // 9 + 1 ELSE 0 END"), "tw37": (G.mat_index(8, 8, 0, "int")["data"], "i"),
        "tw38": (G.mat_index(8, 8, 1, "int")["data"], "i + 1"),
        "src41": (G.permutation(8, 2, 5, "int")["data"], "CASE WHEN i // 8 = 2 THEN (i % 8 = 5)::INT WHEN i // 8 = 5 THEN (i % 8 = 2)::INT ELSE (i % 9 = 0)::INT END"),
    }, "factories_int", "int")
    made(lambda: {"src7": (G.falses(64), "FALSE"), "src8": (G.mat_falses(8, 8)["data"], "FALSE"), "src10": (G.falses(64), "FALSE"), "src11": (G.mat_falses(8, 8)["data"], "FALSE")}, "factories_bool", "bool")
    unit = lambda seed, i="i": f"(('0x' || substr(md5('{seed}:' || ({i})), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE)"
    made(lambda: {
        "src21": (G.random_unit(64), f"(-1 + 2 * {unit(34215)}) / sqrt(sum((-1 + 2 * {unit(34215)}) * (-1 + 2 * {unit(34215)})) OVER ())"), "src22": (G.random(64, -2, 3), f"-2 + 5 * {unit(34215)}"),
        "src29": (G.mat_random(8, 8)["data"], f"-1 + 2 * {unit(121312)}"), "src30": (G.random_diagonal(8, 1, 2)["data"], f"CASE WHEN i % 9 = 0 THEN 1 + {unit(65792, 'i // 9')} ELSE 0 END"),
        "src31": (G.mat_random(8, 8, 2, 4, 5)["data"], f"2 + 2 * {unit(5)}"),
        "src36": (G.random(64, -5, 5, t="int").cast("array<double>"), f"floor(-5 + 10 * {unit(34215)})"), "src38": (G.mat_random(8, 8, -9, 9, 3, "int")["data"].cast("array<double>"), f"floor(-9 + 18 * {unit(3)})"),
        "src39": (G.random(64, 5, -5, 2, "int").cast("array<double>"), f"floor(-5 + 10 * {unit(2)})"), "src40": (G.random_diagonal(8, 0, 9, 4, "int")["data"].cast("array<double>"), f"CASE WHEN i % 9 = 0 THEN floor(9 * {unit(4, 'i // 9')}) ELSE 0 END"),
    }, "random_factories")
    made(lambda: {"src42": (G.random_bool(64), f"{unit(34215)} < 0.5"), "src43": (G.mat_random_bool(8, 8)["data"], f"{unit(121312)} < 0.5")}, "random_factories_bool", "bool")

    # Copies, pivots and packed permutations of every type.
    places = lambda n: V.map1(lambda i: F.pmod(i * 5 + 3, F.lit(n)).cast("int"), V.pivot(n))
    _list = "list({}) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)[{} + 1]"
    back = "((({} + 5) * 5) % 8)"  # where the pivot of eight takes its entries from
    there = "(({} * 5 + 3) % 8)"
    for _t, _vec, _mtx, _name, _ids in (
        ("float", v, mv, "x", ("piv8", "piv9", "piv10", "piv11", "piv12", "piv15", "piv16", "piv5")), ("int", p, mp, "p", ("tw178", "tw179", "tw180", "tw181", "tw182", "tw185", "tw186", "tw142")),
        ("smallint", p, mp, "p", ("tw187", "tw188", "tw189", "tw190", "tw191", "tw194", "tw195", "src14")), ("bigint", p, mp, "p", ("tw196", "tw197", "tw198", "tw199", "tw200", "tw203", "tw204", "src15")),
        ("bool", b, mb, "b", ("tw205", "tw206", "tw207", "tw208", "tw209", "tw212", "tw213", "src13")),
    ):
        _as = (lambda x: x) if _t in ("float", "bool") else (lambda x, t=_t: x.cast(f"array<{t}>"))
        _pivoted = lambda _vec=_vec, _mtx=_mtx, _as=_as, _name=_name, _ids=_ids: dict(zip(_ids, [
            (V.apply_pivot(_as(_vec), places(64)), _list.format(_name, "((i - 3 + 64) * 13) % 64")),
            *[
                (f(V.matrix(8, 8, _as(_mtx["data"])), places(8), inverse)["data"], _list.format(_name, at))
                for f, inverse, at in (
                    (V.apply_pivot_rows, False, back.format("i // 8") + " * 8 + i % 8"), (V.apply_pivot_columns, False, "i // 8 * 8 + " + back.format("i % 8")),
                    (V.apply_pivot_rows, False, back.format("(i // 8)") + " * 8 + i % 8"), (V.apply_pivot_columns, False, "i // 8 * 8 + " + back.format("(i % 8)")),
                    (V.apply_pivot_rows, True, there.format("(i // 8)") + " * 8 + i % 8"), (V.apply_pivot_columns, True, "i // 8 * 8 + " + there.format("(i % 8)")),
                )
            ],
            (V.copy_to(_as(_vec), V.set_all(_vec, 0)), _name),
        ], strict=True))
        cells("pivots_packed" + ("" if _t == "float" else f"_{_t}"), _t, _pivoted)
    cells("outer_product_int", "int", lambda: {"dot9": (V.outer(F.slice(p, 1, 8), F.slice(q, 1, 8), "int")["data"], _list.format("p", "i // 8") + " * " + _list.format("q", "i % 8"))})
    cells("view_with_view", "bool", lambda: {
        "prj13": (V.update_view(mb, K.b_or, 1, 2, 3, 3, 2, 2, V.view(mc, 0, 1, 3, 3, 2, 2))["data"], f"b OR (i // 8 IN (1, 3, 5) AND i % 8 IN (2, 4, 6) AND {_list.format('c', 'greatest(i - 9, 0)')})"),
        "prj14": (V.update_view(mb, K.b_or, 0, 0, 8, 8, 1, 1, mc)["data"], "b OR c"),
    })
    at = lambda name, k: f"max({name}) FILTER (i = {k})" if name != "b" else f"bool_or(b) FILTER (i = {k})"
    for _t, _vec, _mtx, _name, _first in (("int", p, mp, "p", 123), ("bool", b, mb, "b", 131)):
        _reads = ((V.element, _vec, (5,), 5), (V.from_end, _vec, (0,), 63), (V.element, None, (9,), 9), (V.from_end, None, (9,), 54), (V.cell, _mtx, (2, 3), 19), (V.cell, _mtx, (2, 1, False, True), 22), (V.cell, _mtx, (1, 3, True), 51), (V.cell, _mtx, (0, 0, True, True), 63))
        scalars(f"element_access_{_t}", lambda _reads=_reads, _mtx=_mtx, _name=_name, _first=_first, _t=_t: {
            f"tw{_first + k}": (f(_mtx["data"] if of is None else of, *args), at(_name, cell), _t) for k, (f, of, args, cell) in enumerate(_reads)
        })
    small = lambda n: [V.element(v, k) for k in range(n)]
    scalars("conversions", lambda: {
        "src44": (V.element(G.from_columns(*small(2)), 1), "max(x) FILTER (i = 1)", "float"), "src46": (V.total(G.from_columns(*small(4))), "sum(x) FILTER (i < 4)", "float"),
        "src48": (V.cell(G.from_column_major(3, *small(9)), 1, 2), "max(x) FILTER (i = 7)", "float"), "src49": (V.cell(G.from_column_major(4, *small(16)), 3, 1), "max(x) FILTER (i = 7)", "float"),
    })

    # Exact predicates: on even ids a matrix has the property, on odd ones it is as it comes.
    even = F.col("id") % 2 == 0
    shaped = lambda keep: V.on_matrix(lambda d: F.transform(d, lambda x, k: F.when(~even | keep(F.floor(k / 8), k % 8), x).otherwise(0.0)), mv)
    ones = V.on_matrix(lambda d: F.transform(d, lambda x, k: F.when(~even, x).when(k % 9 == 0, 1.0).otherwise(0.0)), mv)
    mirror = V.on_matrix(lambda d: F.transform(d, lambda x, k: F.when(~even | (F.floor(k / 8) <= k % 8), x).otherwise(F.get(d, (k % 8) * 8 + F.floor(k / 8).cast("int")))), mv)
    zero = "bool_and((CASE WHEN id % 2 = 0 THEN 0 ELSE x END) = 0) FILTER ({})"
    _xs = "list(x ORDER BY i)"
    scalars("exact_predicates", lambda: {
        "anl9": (V.is_identity(ones), "bool_and((CASE WHEN id % 2 = 0 THEN (i % 9 = 0)::INT ELSE x END) = (i % 9 = 0)::INT)", "bool"), "anl13": (V.is_diagonal(shaped(lambda r, c: r == c)), zero.format("i % 9 <> 0"), "bool"),
        "anl15": (V.is_upper_triangular(shaped(lambda r, c: r <= c)), zero.format("i % 8 < i // 8"), "bool"), "anl17": (V.is_lower_triangular(shaped(lambda r, c: r >= c)), zero.format("i % 8 > i // 8"), "bool"),
        "anl11": (V.is_symmetric(mirror), f"bool_and(id % 2 = 0) OR list_bool_and(list_transform(range(64), lambda k: {_xs}[k + 1] = {_xs}[(k % 8) * 8 + k // 8 + 1]))", "bool"),
    })

    # Printing: three and five places, as many decimals as are left.
    places_of = lambda x, n, sign: "CASE " + " ".join(f"WHEN abs({x}) < {10 ** k} THEN printf('%{sign}.{n - k}f', {x})" for k in range(1, n)) + f" ELSE printf('%{sign}.0f', {x}) END"
    scalars("printing", lambda: {
        "snk1": (P.vector_log(p), f"'dim 64, L2 ' || {places_of('sqrt(sum(p * p))', 6, '')} || ': ' || string_agg({places_of('p::DOUBLE', 3, '+')}, ' ' ORDER BY i)", "text"),
        "snk2": (P.matrix_log(mp), f"string_agg({places_of('p::DOUBLE', 5, '')} || CASE WHEN i = 63 THEN '' WHEN i % 8 = 7 THEN chr(10) ELSE ' ' END, '' ORDER BY i)", "text"),
        "snk3": (P.spy(mv), "string_agg(CASE WHEN abs(x) >= 0.01 THEN 'X' ELSE ' ' END || CASE WHEN i = 63 THEN '' WHEN i % 8 = 7 THEN chr(10) ELSE ' ' END, '' ORDER BY i)", "text"),
        "snk7": (P.pivot_log(places(64)), "string_agg(((i * 5 + 3) % 64)::VARCHAR, '' ORDER BY i)", "text"),
        "tw216": (P.stats_log(V.full_stats(F.transform(F.slice(v, 1, 4), lambda x: F.round(x * 0, 1) + 2.5))), "'Mean: 2.5, Min: 2.5, Max: 2.5, Range: 0.0, Median: 2.5, StdDev: 0.0, Variance: 0.0, IQR: 0.0, Q1: 2.5, Q3: 2.5'", "text"),
    })



Made = Callable[[], dict]


def _collect(*modules) -> dict[str, tuple[str, str, Made, bool]]:
    """name: (form, kind, what makes the columns, matrix) of every table."""
    found: dict[str, tuple[str, str, Made, bool]] = {}

    def cells(name: str, kind: str, columns: Made, matrix: bool = False) -> None:
        found[name] = ("cells", kind, columns, matrix)

    def scalars(name: str, columns: Made) -> None:
        found[name] = ("scalars", "", columns, False)

    def family(prefix, table, one, whole, names, kind) -> None:
        """The same operators on vectors and on matrices."""
        lifted = modules[0]
        # Made when the query runs: each is a few dozen calls into the JVM.
        apart = {f"{prefix[0]}{k}": (partial(f, *one[:n]), s) for k, (f, s, n) in enumerate(table, 1)}
        whole_ = {f"{prefix[1]}{k}": (partial((lifted.on_matrix, lifted.on_matrices)[n - 1], f, *whole[:n]), s) for k, (f, s, n) in enumerate(table, 1)}
        cells(names[0], kind, lambda: apart)
        cells(names[1], kind, lambda: whole_, matrix=True)

    tables(*modules, cells, scalars, family, lambda columns, name="factories", kind="float": found.update({name: ("made", kind, columns, False)}))
    return found


_real: dict[int, dict] = {}


def _columns(name: str) -> dict:
    """The columns of a table, made once a Spark context."""
    from pyspark import SparkContext

    context = id(SparkContext._active_spark_context)
    if context not in _real:
        _real.clear()
        _real[context] = _collect(V, F, G, P, K)
    return {k: e() if isinstance(e, partial) else e for k, (e, *_) in _real[context][name][2]().items()}


_FORM = {
    "float": "round({}, 6) + 0.0", "int": "({})::INT", "smallint": "({})::SMALLINT", "bigint": "({})::BIGINT", "bool": "({})", "text": "({})",
}


def _run(name: str, form: str, kind: str, kinds: dict[str, str], matrix: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = {k: (e["data"] if matrix else e) for k, e in _columns(name).items()}
        if form == "scalars":
            return base(spark, sf_dir).select("id", *[rounded(e, kinds[k]).alias(k) for k, e in made.items()])
        rows, keys = (base(spark, sf_dir), ["id"]) if form == "cells" else (spark.range(1), [])
        one = rows.select(*keys, *[e.alias(k) for k, e in made.items()])
        each = one.select(*keys, F.posexplode(F.arrays_zip(*made)).alias("i", "z"))
        return each.select(*keys, "i", *[rounded(F.col("z")[k], kind).alias(k) for k in made])

    return run


for _name, (_form, _kind, _make, _matrix) in _collect(*[Stub()] * 5).items():
    _table = _make()
    QUERIES[_name] = _run(_name, _form, _kind, {k: x[2] for k, x in _table.items() if len(x) > 2}, _matrix)
    if _form == "scalars":
        _made = ", ".join(f"{_FORM[x[2]].format(x[1])} AS {k}" for k, x in _table.items())
        ORACLE_SQL[_name] = f"{CELLS}SELECT id, {_made} FROM f GROUP BY id"
    elif _form == "cells":
        ORACLE_SQL[_name] = f"{CELLS}SELECT id, i, " + ", ".join(f"{_FORM[_kind].format(x[1])} AS {k}" for k, x in _table.items()) + " FROM f"
    else:
        _shown = "round(({})::DOUBLE, 6) + 0.0" if _kind == "float" else _FORM[_kind]
        ORACLE_SQL[_name] = "SELECT i::INT AS i, " + ", ".join(f"{_shown.format(x[1])} AS {k}" for k, x in _table.items()) + " FROM range(64) t(i)"


_COO = "WITH m AS (SELECT vec_id AS r, unnest(range(64))::INT AS c, unnest(embedding)::DOUBLE AS v FROM embeddings)\n"


def _coo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.from_rows(T.vectors(T.table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumn("v", F.round("v", digits) + F.lit(0.0))


@query("gram", _COO + "SELECT x.c AS r, y.c AS c, round(sum(x.v * y.v), 5) + 0.0 AS v FROM m x JOIN m y USING (r) GROUP BY 1, 2")
def gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A' A of the embeddings, by one aggregate over their rows."""
    return _round(L.gram(T.vectors(T.table(spark, sf_dir, "embeddings"), "vec_id", "embedding")), 5)


@query("matmul_transposed", ORACLE_SQL["gram"])
def matmul_transposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _coo(spark, sf_dir)
    return _round(L.matmul(a, a, transpose_a=True), 5)


@query("matmul", _COO + "SELECT x.r, y.r % 8 AS c, round(sum(x.v * y.v), 5) + 0.0 AS v FROM m x JOIN m y USING (c) GROUP BY 1, 2")
def matmul(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A B, with B the sums of every eighth row, turned."""
    a = _coo(spark, sf_dir)
    folded = a.groupBy((F.col("r") % 8).alias("r"), "c").agg(F.sum("v").alias("v"))
    return _round(L.matmul(a, L.transpose(folded)), 5)


@query("matmul_integers", "WITH m AS (SELECT vec_id AS r, unnest(range(64))::INT AS c, (unnest(embedding)::DOUBLE * 100000)::BIGINT AS v FROM embeddings), s AS (SELECT x.c AS r, y.c AS c, sum(x.v * y.v)::HUGEINT AS v FROM m x JOIN m y USING (r) GROUP BY 1, 2) SELECT r, c, (((v + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)::INT AS v FROM s")
def matmul_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A' A of integers, wrapped to 32 bits."""
    a = _coo(spark, sf_dir).withColumn("v", F.rint(F.col("v") * 100000).cast("int"))
    return L.matmul(a, a, transpose_a=True, t="int")


@query("matvec", _COO + "SELECT r AS i, round(sum(v * (c + 1)), 6) + 0.0 AS v FROM m GROUP BY r")
def matvec(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spark.range(64).select(F.col("id").cast("int").alias("i"), (F.col("id") + 1.0).alias("v"))
    return _round(L.matvec(_coo(spark, sf_dir), x))


@query("vecmat", _COO + "SELECT c AS i, round(sum(v * (r % 7)), 5) + 0.0 AS v FROM m GROUP BY c")
def vecmat(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _coo(spark, sf_dir)
    y = a.select(F.col("r").alias("i")).distinct().select("i", (F.col("i") % 7).cast("double").alias("v"))
    return _round(L.vecmat(y, a), 5)


_WHOLE = """WITH m AS (SELECT vec_id AS r, unnest(range(64))::INT AS c, (unnest(embedding)::DOUBLE * 100000)::BIGINT AS v FROM embeddings),
s AS (SELECT {i} AS i, sum(v * ({w} * 3000001 % 2147483647))::HUGEINT AS v FROM m GROUP BY 1)
SELECT i, (((v + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)::INT AS v FROM s"""


@query("matvec_integers", _WHOLE.format(i="r", w="c"))
def matvec_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A x of integers, wrapped to 32 bits."""
    a = _coo(spark, sf_dir).withColumn("v", F.rint(F.col("v") * 100000).cast("int"))
    x = spark.range(64).select(F.col("id").cast("int").alias("i"), (F.col("id") * 3000001 % 2147483647).cast("int").alias("v"))
    return L.matvec(a, x, "int")


@query("vecmat_integers", _WHOLE.format(i="c", w="r"))
def vecmat_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y' A of integers, wrapped to 32 bits."""
    a = _coo(spark, sf_dir).withColumn("v", F.rint(F.col("v") * 100000).cast("int"))
    y = a.select(F.col("r").alias("i")).distinct().select("i", (F.col("i") * 3000001 % 2147483647).cast("int").alias("v"))
    return L.vecmat(y, a, "int")


@query("transpose", _COO + "SELECT c AS r, r AS c, round(v, 6) + 0.0 AS v FROM m")
def transposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(L.transpose(_coo(spark, sf_dir)))




@query("outer_product", "SELECT vec_id AS id, k::INT AS i, round(embedding[k // 8 + 1]::DOUBLE * embedding[64 - k % 8]::DOUBLE, 6) + 0.0 AS v FROM embeddings, range(64) t(k)")
def outer_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = base(spark, sf_dir).select("id", V.outer(F.slice("v", 1, 8), F.slice("w", 1, 8))["data"].alias("d"))
    return _round(one.select("id", F.posexplode("d").alias("i", "v")))


@query("outer_long", "WITH s AS (SELECT s_suppkey AS i, s_acctbal AS v FROM supplier), n AS (SELECT n_nationkey AS i, n_regionkey + 1.0 AS v FROM nation) SELECT s.i AS r, n.i AS c, round((s.v * n.v)::DOUBLE, 4) + 0.0 AS v FROM s, n")
def outer_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("v"))
    n = T.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("i"), (F.col("n_regionkey") + 1.0).alias("v"))
    return _round(L.outer(s, n), 4)


@query("row_column_sums", _COO + "SELECT 'rowSum' AS k, r AS i, round(sum(v), 5) + 0.0 AS v FROM m GROUP BY r UNION ALL SELECT 'rowMean', r, round(avg(v), 6) + 0.0 FROM m GROUP BY r UNION ALL SELECT 'colSum', c, round(sum(v), 5) + 0.0 FROM m GROUP BY c UNION ALL SELECT 'colMean', c, round(avg(v), 6) + 0.0 FROM m GROUP BY c")
def row_column_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _coo(spark, sf_dir)
    out = []
    for axis, name in (("r", "row"), ("c", "col")):
        both = F.array(F.struct(F.lit(f"{name}Sum").alias("k"), (F.round("sum", 5) + 0.0).alias("v")), F.struct(F.lit(f"{name}Mean").alias("k"), (F.round("mean", 6) + 0.0).alias("v")))
        out.append(L.reduced(a, axis).select(F.col("i").cast("bigint").alias("i"), F.explode(both).alias("e")).select("e.k", "i", "e.v"))
    return out[0].unionByName(out[1])


@query("group_statistics", "SELECT event_type, count(value) AS count, round(sum(value), 2) + 0.0 AS sum, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, round(max(value) - min(value), 6) AS range, round(var_pop(value), 4) AS variance, round(stddev_pop(value), 5) AS std_dev FROM events GROUP BY event_type")
def group_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = L.stats(T.table(spark, sf_dir, "events"), "value", "event_type")
    digits = {"sum": 2, "mean": 6, "range": 6, "variance": 4, "std_dev": 5}
    return s.select("event_type", "count", "min", "max", *[F.round(k, d).alias(k) for k, d in digits.items()])


@query("group_order_statistics", """WITH s AS (SELECT user_id, list(value ORDER BY value) AS s, count(*) AS n FROM events GROUP BY user_id),
t AS (SELECT *, n // 2 AS mid, n // 4 AS half FROM s)
SELECT user_id, round(CASE WHEN n % 2 = 1 THEN s[mid + 1] ELSE (s[mid] + s[mid + 1]) / 2 END, 6) AS median,
round(CASE WHEN n % 2 = 1 THEN s[half + 1] WHEN n = 2 THEN s[1] ELSE (s[half] + s[half + 1]) / 2 END, 6) AS q1,
round(CASE WHEN n % 2 = 1 THEN s[mid + mid // 2 + 1] WHEN n = 2 THEN s[2] ELSE (s[mid + mid // 2] + s[mid + mid // 2 + 1]) / 2 END, 6) AS q3 FROM t""")
def group_order_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = L.order_stats(T.table(spark, sf_dir, "events"), "value", "user_id")
    return s.select("user_id", *[F.round(k, 6).alias(k) for k in ("median", "q1", "q3")])


@query("group_norms", "SELECT l_returnflag, round(sqrt(sum(l_discount * l_discount)), 5) AS l2, round(sum(abs(l_discount)), 4) AS l1, round(avg(abs(l_discount)), 6) AS l1_mean, max(abs(l_discount)) AS lmax, round(pow(sum(pow(abs(l_discount), 3)), 1.0 / 3), 5) AS lp FROM lineitem GROUP BY l_returnflag")
def group_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = L.norms(T.table(spark, sf_dir, "lineitem"), "l_discount", "l_returnflag")
    return n.select("l_returnflag", "lmax", *[F.round(k, d).alias(k) for k, d in (("l2", 5), ("l1", 4), ("l1_mean", 6), ("lp", 5))])


_PRED = """WITH m AS (SELECT x.c AS r, y.c AS c, sum(x.v * y.v) AS v FROM (SELECT vec_id AS r, unnest(range(64))::INT AS c, unnest(embedding)::DOUBLE AS v FROM embeddings) x
JOIN (SELECT vec_id AS r, unnest(range(64))::INT AS c, unnest(embedding)::DOUBLE AS v FROM embeddings) y USING (r) GROUP BY 1, 2)
SELECT bool_or(isnan(m.v)) AS any_nan, bool_or(isinf(m.v)) AS any_inf, bool_and(abs(m.v) <= 1e-6) AS zero, round(max(abs(m.v)), 5) AS max_zero_error,
bool_and(abs(m.v - (m.r = m.c)::INT) <= 1e-6) AS identity, bool_and(abs(m.v - t.v) <= 1e-6) AS symmetric, bool_and(m.r = m.c OR abs(m.v) <= 1e-6) AS diagonal,
bool_and(m.c >= m.r OR abs(m.v) <= 1e-6) AS upper, bool_and(m.c <= m.r OR abs(m.v) <= 1e-6) AS lower FROM m JOIN m t ON m.r = t.c AND m.c = t.r"""


@query("matrix_predicates", _PRED)
def matrix_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = L.gram(T.vectors(T.table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    return L.predicates(g, 1e-6).withColumn("max_zero_error", F.round("max_zero_error", 5))


@query("orthogonality", """WITH g AS (SELECT i // 16 AS r, i % 16 AS c FROM range(256) t(i)),
m AS (SELECT 'rotation' AS name, r, c, CASE WHEN r = c AND r IN (3, 15) THEN cos(pi() / 4) WHEN r = 3 AND c = 15 THEN -sin(pi() / 4) WHEN r = 15 AND c = 3 THEN sin(pi() / 4) WHEN r = c THEN 1 ELSE 0 END AS v FROM g
  UNION ALL SELECT 'hilbert', r, c, 1.0::DOUBLE / (r + c + 1) FROM g UNION ALL SELECT 'stretched', r, c, CASE WHEN r = c THEN 1 + 1e-9::DOUBLE * r ELSE 0 END FROM g),
p AS (SELECT x.name, x.c AS r, y.c AS c, sum(x.v * y.v) AS v FROM m x JOIN m y ON x.name = y.name AND x.r = y.r GROUP BY ALL)
SELECT name, bool_and(abs(v - (r = c)::INT) <= 1e-12) AS orthogonal FROM p GROUP BY name""")
def orthogonality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One matrix that is orthogonal, one that is not, and one that nearly is."""
    made = {"rotation": G.rotation(16, 3, 15, math.pi / 4), "hilbert": G.hilbert(16), "stretched": G.diagonal_of(F.transform(G.index(16), lambda x: 1 + 1e-9 * x))}
    each = [L.is_orthogonal(L.from_matrix(spark.range(1).select(m.alias("m"))), 1e-12).select(F.lit(name).alias("name"), "orthogonal") for name, m in made.items()]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("permute_rows", _COO + "SELECT (r * 3 + 1) % 1000003 AS r, c, round(v, 6) + 0.0 AS v FROM m")
def permute_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _coo(spark, sf_dir)
    moves = a.select(F.col("r").alias("i")).distinct().select("i", ((F.col("i") * 3 + 1) % 1000003).alias("to"))
    return _round(L.permute(a, moves))


@query("permute_columns_back", _COO + "SELECT r, (c * 5 + 3) % 64 AS c, round(v, 6) + 0.0 AS v FROM m")
def permute_columns_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = spark.range(64).select(((F.col("id") * 5 + 3) % 64).cast("int").alias("i"), F.col("id").cast("int").alias("to"))
    return _round(L.permute(_coo(spark, sf_dir), moves, "c", inverse=True))


@query("swaps", _COO + "SELECT CASE WHEN c >= 10 AND c < 30 THEN CASE r WHEN 1 THEN 4 WHEN 4 THEN 1 ELSE r END ELSE r END AS r, CASE c WHEN 2 THEN 5 WHEN 5 THEN 2 ELSE c END AS c, round(v, 6) + 0.0 AS v FROM m")
def swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(L.swap(L.swap(_coo(spark, sf_dir), 1, 4, "r", 10, 30), 2, 5, "c"))


@query("elementwise_long", _COO + "SELECT r, c, round(v * v + v, 6) + 0.0 AS v FROM m")
def elementwise_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _coo(spark, sf_dir)
    return _round(L.elementwise(L.elementwise(a, a, K.mul), a, K.add))


@query("select_long", _COO + "SELECT r, c, round(CASE WHEN v > 0 THEN -v ELSE v END, 6) + 0.0 AS v FROM m")
def select_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _coo(spark, sf_dir)
    return _round(L.select(a, a.withColumn("v", -F.col("v")), a.withColumn("v", F.col("v") > 0)))


@query("views", "SELECT vec_id AS id, k::INT AS i, (embedding[(1 + (k // 3) * 2) * 8 + 2 + (k % 3) * 2 + 1] > 0) AS v FROM embeddings, range(9) t(k)")
def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = base(spark, sf_dir).select("id", V.view(F.col("mb"), 1, 2, 3, 3, 2, 2)["data"].alias("d"))
    return one.select("id", F.posexplode("d").alias("i", "v"))



def _systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An 8 x 8 system a vector: the vector as a matrix with a strong diagonal, and a right-hand side."""
    one = base(spark, sf_dir)
    m = V.on_matrix(lambda d: F.transform(d, lambda x, k: F.when(k % 9 == 0, x + 3).otherwise(x)), F.col("mv"))
    return one.select("id", m.alias("m"), F.slice("w", 1, 8).alias("b"))


def _product(a: Column, x: Column) -> Column:
    """A x of a packed matrix."""
    rows = F.sequence(F.lit(0), a["rows"] - 1)
    return F.transform(rows, lambda r: V.total(F.zip_with(F.slice(a["data"], r * a["cols"] + 1, a["cols"]), x, lambda s, t: s * t)))


_SYSTEMS = """WITH a AS (SELECT vec_id AS id, k // 8 AS r, k % 8 AS c, embedding[k + 1]::DOUBLE + 3 * (k % 9 = 0)::INT AS v, embedding[64 - k % 8]::DOUBLE AS w FROM embeddings, range(64) t(k)),
b AS (SELECT id, c AS i, w FROM a WHERE r = 0), p AS (SELECT id, r AS i, sum(v * w) AS v FROM a GROUP BY id, r)
"""
_RIGHT = _SYSTEMS + "SELECT id, i::INT AS i, round(w, 6) + 0.0 AS v FROM b"
_PRODUCT = _SYSTEMS + "SELECT id, i::INT AS i, round(v, 6) + 0.0 AS v FROM p"


def _entries(df: DataFrame, **columns: Column) -> DataFrame:
    """(id, i, columns) of vectors, rounded."""
    one = df.select("id", F.posexplode(F.arrays_zip(*[c.alias(k) for k, c in columns.items()])).alias("i", "z"))
    return one.select("id", "i", *[(F.round(F.col("z")[k], 6) + F.lit(0.0)).alias(k) for k in columns])


@query("lu_solve", _RIGHT)
def lu_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each system's matrix times its solution, which has to be the right-hand side."""
    done = S.with_lu_solution(_systems(spark, sf_dir)).filter("NOT singular")
    return _entries(done, v=_product(F.col("m"), F.col("x")))


@query("lu_packed_solve", _RIGHT)
def lu_packed_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = S.with_packed_solution(S.with_lu_packed(_systems(spark, sf_dir)))
    return _entries(done, v=_product(F.col("m"), F.col("x")))


def _factors(spark: SparkSession, sf_dir: str, pivot: bool) -> DataFrame:
    """L U b in the matrix's own order of rows, L's diagonal, and what stands in the wrong triangles."""
    done = S.with_lu(_systems(spark, sf_dir), pivot=pivot)
    diagonal = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.get(F.col("l")["data"], r * 9))
    low = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.aggregate(F.slice(F.col("l")["data"], r * 9 + 2, 7 - r), F.lit(0.0), lambda s, x: s + F.abs(x)))
    up = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.aggregate(F.slice(F.col("u")["data"], r * 8 + 1, r), F.lit(0.0), lambda s, x: s + F.abs(x)))
    again = _product(F.col("l"), _product(F.col("u"), F.col("b")))
    return _entries(done, v=V.apply_pivot(again, F.col("p")), diagonal=diagonal, wrong=V.add(low, up))


_FACTORS = _SYSTEMS + "SELECT id, i::INT AS i, round(v, 6) + 0.0 AS v, 1.0::DOUBLE AS diagonal, 0.0::DOUBLE AS wrong FROM p"


@query("lu_factors", _FACTORS)
def lu_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _factors(spark, sf_dir, True)


@query("lu_factors_in_order", _FACTORS)
def lu_factors_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without pivoting (SOL1)."""
    return _factors(spark, sf_dir, False)


@query("qr_factors", _SYSTEMS + "SELECT id, i::INT AS i, round(p.v, 6) + 0.0 AS v, round(w, 6) + 0.0 AS turned, 0.0::DOUBLE AS wrong FROM p JOIN b USING (id, i)")
def qr_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q R b; Q' Q b; what stands below R's diagonal."""
    done = S.with_qr(_systems(spark, sf_dir))
    below = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.aggregate(F.slice(F.col("r")["data"], r * 8 + 1, r), F.lit(0.0), lambda s, x: s + F.abs(x)))
    q, b = F.col("q"), F.col("b")
    return _entries(done, v=_product(q, _product(F.col("r"), b)), turned=_product(V.transpose(q), _product(q, b)), wrong=below)


@query("qr_solve", _RIGHT)
def qr_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = S.with_qr_solution(S.with_qr(_systems(spark, sf_dir)))
    return _entries(done, v=_product(F.col("m"), F.col("x")))


@query("triangular_solve", _SYSTEMS + "SELECT id, i::INT AS i, round(w, 6) + 0.0 AS up, round(w, 6) + 0.0 AS low, round(w, 6) + 0.0 AS unit FROM b")
def triangular_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper, lower and unit-diagonal matrices times their solutions."""
    one = _systems(spark, sf_dir)
    keep = lambda ok: V.on_matrix(lambda d: F.transform(d, lambda x, k: F.when(ok(F.floor(k / 8), k % 8), x).otherwise(0.0)), F.col("m"))
    up, low = keep(lambda r, k: k >= r), keep(lambda r, k: k <= r)
    unit = V.on_matrix(lambda d: F.transform(d, lambda x, k: F.when(k % 9 == 0, 1.0).otherwise(x)), low)
    done = one.withColumns({"up": up, "low": low, "unit": unit})
    for m, upper, ones in (("up", True, False), ("low", False, False), ("unit", False, True)):
        done = S.with_triangular_solution(done, m, "b", upper, ones).withColumnRenamed("x", f"x_{m}")
    return _entries(done, **{m: _product(F.col(m), F.col(f"x_{m}")) for m in ("up", "low", "unit")})


@query("least_squares", "SELECT vec_id AS id, round(regr_slope(y, x), 5) + 0.0 AS slope, round(regr_intercept(y, x), 5) + 0.0 AS intercept FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(list_reverse(embedding))::DOUBLE AS y FROM embeddings) GROUP BY vec_id")
def least_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line through each vector against its reverse: a 64 x 2 system a row."""
    one = base(spark, sf_dir).select("id", V.matrix(64, 2, F.flatten(F.transform("v", lambda x: F.array(x, F.lit(1.0))))).alias("m"), F.col("w").alias("b"))
    return S.with_least_squares(one).select("id", *[(F.round(F.col("x")[k], 5) + 0.0).alias(n) for k, n in enumerate(("slope", "intercept"))])


@query("regression", "SELECT 'l_quantity' AS term, round(regr_slope(l_extendedprice, l_quantity), 3) AS coefficient FROM lineitem UNION ALL SELECT 'one', round(regr_intercept(l_extendedprice, l_quantity), 3) FROM lineitem")
def regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tall least-squares problem, by QR of blocks."""
    rows = T.table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity", F.lit(1.0).alias("one"))
    return S.regress(rows, ["l_quantity", "one"], "l_extendedprice").withColumn("coefficient", F.round("coefficient", 3))
