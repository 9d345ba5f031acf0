"""Text forms of vectors, matrices and masks, as columns: nothing is collected to format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattiq.functions import vectors as V


def vector_log(v: Column, start: int = 0, end: int = -1) -> Column:
    """Dimension, L2 norm of the range, and its entries with sign to three places."""
    part = V.span(v, start, end)
    entries = F.array_join(F.transform(part, lambda x: F.format_string("%+.3g", x.cast("double"))), " ")
    return F.format_string("dim %d, L2 %.6g: %s", F.size(v), V.norm_l2(v, start, end), entries)


def _grid(m: Column, cell) -> Column:
    """Lines of a matrix, its cells made by ``cell``."""
    lines = F.transform(
        F.sequence(F.lit(0), m["rows"] - 1),
        lambda r: F.array_join(F.transform(F.slice(m["data"], r * m["cols"] + 1, m["cols"]), cell), " "),
    )
    return F.array_join(lines, "\n")


def matrix_log(m: Column) -> Column:
    """Entries rounded to four decimals."""
    return _grid(m, lambda x: F.format_string("%.5g", F.round(x.cast("double"), 4)))


def spy(m: Column, threshold: float = 0.01) -> Column:
    """X where an entry is at least the threshold, a blank elsewhere."""
    return _grid(m, lambda x: F.when(F.abs(x) >= threshold, "X").otherwise(" "))


def mask_log(v: Column, start: int = 0, end: int = -1) -> Column:
    return F.array_join(F.transform(V.span(v, start, end), lambda b: F.when(b, "T").otherwise("F")), "")


def mask_spy(m: Column, show: bool = True) -> Column:
    return _grid(m, lambda b: F.when(b == show, "X").otherwise(" "))


def pivot_log(p: Column) -> Column:
    return F.array_join(F.transform(p, lambda i: i.cast("string")), "")


#: Labels of the fields of a statistics struct, in order of the text form (fixed values).
STATS = (
    ("Mean", "mean"), ("Min", "min"), ("Max", "max"), ("Range", "range"), ("Median", "median"), ("StdDev", "std_dev"),
    ("Variance", "variance"), ("IQR", "iqr"), ("Q1", "q1"), ("Q3", "q3"),
)


def stats_log(s: Column) -> Column:
    """The text form of a statistics struct (``V.full_stats``); numbers as Spark writes them."""
    field = lambda name: s["q3"] - s["q1"] if name == "iqr" else s[name]
    return F.concat_ws(", ", *[F.concat(F.lit(f"{label}: "), field(name).cast("string")) for label, name in STATS])
