"""Mixing sources to target weights by Pareto order sampling.

Sizes are words.  Each source gets a target by *water filling*: weights share
``share`` times all sizes, no source above ``max_copies`` times its own size,
and what is cut off is shared again by weight among the rest.  A source whose
target is ``r`` times its size gives every document ``floor(r)`` certain copies;
what remains of the target is drawn without replacement: each document has an
inclusion probability ``p`` (the remaining fraction, times its optional relative
propensity: a column, or a function of the size), a uniform number ``u`` that only its key decides, and the rank
``(u / (1 - u)) / (p / (1 - p))``.  Documents are taken in rank order until the
words that are left are used up, so the sample has a fixed size in words; the
document at the border is taken if that comes nearer to the target.

Nothing is gathered per source.  Ranks are cut into ``BINS`` bins; the words of
each (source, bin) are summed with map-side combining, the bin that holds the
border is found from at most ``BINS`` rows a source, and only the distinct ranks
in that one bin are put in exact order.  What a row needs is then one line a source.  A source with a third of all rows is thus
dealt over all tasks.

Defined results: a null text has size 0 and is taken 0 or more times like any
other (it never moves the total); a null source is a source of its own, last in
order; a source of size 0 has target 0; rows with one key have one ``u``, hence
one rank, and are taken together or not at all (null keys count as one key);
other columns are carried along.  A very long text counts with all its words and
is taken whole or not at all.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattiq.llm.common import cut, free_name, n_words, small

Propensity = Column | Callable[[Column], Column] | None
LONG_DOCUMENT = 100
BINS = 4096
WEIGHTS = (3, 1, 2)


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that only the key and the seed decide (52 bits of MD5)."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, max_copies: int = 2) -> DataFrame:
    """(source, source_size, weight, target) from (source, size), one row a source.

    The water level has a closed form: with sources in order of the level at
    which each is full (capacity / weight), those below the level are full and
    the rest share what is left by weight.  One row a source is ordered here.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    # Binary order of the strings is code point order.
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    per = per.withColumn("weight", F.get(cycle, (F.row_number().over(order) - 1) % len(weights)).cast("long"))
    cap = F.col("source_size") * max_copies
    everything = Window.partitionBy(F.lit(0))
    filling = everything.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    rest = filling.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn(
        "level",
        (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0)))
        / F.sum("weight").over(rest),
    ).withColumn("capacity", cap)
    # The first source, in filling order, that is not full sets the level for all that follow.
    open_level = F.when(F.col("level") * F.col("weight") <= F.col("capacity"), F.col("level"))
    per = per.withColumn("level", F.first(open_level, ignorenulls=True).over(filling.rowsBetween(Window.unboundedPreceding, 0)))
    return per.select(
        "source", "source_size", "weight", F.coalesce(F.col("level") * F.col("weight"), F.col("capacity").cast("double")).alias("target")
    )


def _rank(key: Column, p: Column, seed: int) -> Column:
    u = uniform(key, seed)
    return (u / (1 - u)) / (p / (1 - p))


def _inclusion(propensity: Column, of=F.col) -> Column:
    p = of("left") / F.greatest(of("source_size"), F.lit(1)) * propensity
    return F.least(F.greatest(p, F.lit(1e-12)), F.lit(1.0 - 1e-12))


def plan(
    sizes: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    max_copies: int = 2,
    seed: int = 17,
) -> DataFrame:
    """One row a source, from (key, source, size, propensity): source_size,
    target, whole (certain copies), left (words to draw) and cut (the last rank taken)."""
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = targets(sizes, weights, share, max_copies).withColumn("whole", F.floor(ratio).cast("long"))
    left = F.col("target") - F.col("whole") * F.col("source_size")
    goal = cut(goal.withColumn("left", F.when(left >= 0.5, left).otherwise(F.lit(0.0))))
    named = small(goal.select(F.col("source").alias("__source"), "source_size", "left"))
    rows = sizes.join(named, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    rows = rows.withColumn("rank", _rank(F.col("key"), _inclusion(F.col("propensity")), seed))
    # Bins by the rank times its source's odds: with even propensities that is the uniform number itself.
    odds = _inclusion(F.lit(1.0))
    rows = rows.withColumn("even", F.col("rank") * (odds / (1 - odds)))
    rows = rows.withColumn("bin", F.least(F.floor(F.col("even") / (1 + F.col("even")) * BINS), F.lit(BINS - 1)).cast("int"))

    earlier = lambda by: Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda z, by: F.coalesce(F.sum(z).over(earlier(by)), F.lit(0))
    bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("z")).withColumn("before", before("z", "bin"))
    bins = bins.join(named.select("__source", "left"), F.col("source").eqNullSafe(F.col("__source")))
    border = (
        bins.filter((F.col("before") < F.col("left")) & (F.col("before") + F.col("z") >= F.col("left")))
        .groupBy(F.col("source").alias("__border_source"))
        .agg(F.min("bin").alias("border"), F.min("before").alias("passed"))
    )
    border = cut(border)
    # Rows of one rank (one key) are summed first, so the window sees distinct ranks of one bin a source.
    inside = (
        rows.join(small(border), F.col("source").eqNullSafe(F.col("__border_source")) & (F.col("bin") == F.col("border")))
        .groupBy("source", "rank")
        .agg(F.sum("size").alias("z"), F.min("passed").alias("passed"), F.min("left").alias("left"))
        .withColumn("before", F.col("passed") + before("z", "rank"))
        .filter(2 * (F.col("left") - F.col("before")) > F.col("z"))
        .groupBy(F.col("source").alias("__cut_source"))
        .agg(F.max("rank").alias("last"))
    )
    b = border.select("__border_source", F.col("border"))
    out = goal.join(b, F.col("source").eqNullSafe(F.col("__border_source")), "left").join(
        inside, F.col("source").eqNullSafe(F.col("__cut_source")), "left"
    )
    # Nothing taken in the border bin: the cut is just before that bin.  No border: nothing is left to draw.
    start = F.col("border") / F.lit(float(BINS))
    below = F.when(F.col("border").isNotNull(), start / (1 - start) / (odds / (1 - odds)) * (1 - 1e-12)).otherwise(F.lit(-1.0))
    out = out.select(
        F.col("source").alias("mix_source"), "source_size", "target", "whole", "left", F.coalesce("last", below).alias("cut")
    )
    return cut(out)


def by_length(size: Column) -> Column:
    """A propensity: documents of LONG_DOCUMENT words and more are half as likely again as shorter ones."""
    return F.when(size >= LONG_DOCUMENT, F.lit(1.5)).otherwise(F.lit(1.0))


def _propensity(propensity: Propensity, size: Column) -> Column:
    if propensity is None:
        return F.lit(1.0)
    return (propensity(size) if callable(propensity) else propensity).cast("double")


def _sizes(docs: DataFrame, key: str, text: str, source: str, propensity: Propensity) -> DataFrame:
    size = n_words(F.col(f"`{text}`").cast("string"))
    return cut(
        docs.select(
            F.col(f"`{key}`").alias("key"),
            F.col(f"`{source}`").cast("string").alias("source"),
            size.alias("size"),
            _propensity(propensity, size).alias("propensity"),
        )
    )


def _copies(key: Column, propensity: Column, seed: int, max_copies: int, of=F.col) -> Column:
    """Copies of a row; ``of`` gives a column of its source's line of the plan."""
    drawn = (of("left") > 0) & (_rank(key, _inclusion(propensity, of), seed) <= of("cut"))
    return F.least(of("whole") + drawn.cast("long"), F.lit(max_copies).cast("long"))


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, max_copies: int = 2, seed: int = 17,
    propensity: Propensity = None,
) -> DataFrame:
    """One row per document: (key, source, size, source_size, target, copies, taken)."""
    sizes = _sizes(docs, key, text, source, propensity)
    per = plan(sizes, weights, share, max_copies, seed)
    rows = sizes.join(small(per), F.col("source").eqNullSafe(F.col("mix_source")))
    return rows.withColumn("copies", _copies(F.col("key"), F.col("propensity"), seed, max_copies)).select(
        "key", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed_rows(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, max_copies: int = 2, seed: int = 17,
    propensity: Propensity = None,
) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken.

    A row needs only its source's line of the plan, so texts are joined to one
    row a source and never regrouped by document.
    """
    per = plan(_sizes(docs, key, text, source, propensity), weights, share, max_copies, seed)
    per = per.select(*[F.col(c).alias(free_name(docs, c)) if c == "mix_source" else F.col(c) for c in per.columns])
    mine = free_name(docs, "mix_source")
    many, line_name = free_name(docs, "__copies"), free_name(docs, "__plan")
    packed = per.select(F.col(mine), F.struct("source_size", "left", "whole", "cut").alias(line_name))
    joined = docs.join(small(packed), F.col(f"`{source}`").cast("string").eqNullSafe(F.col(mine)))
    line = lambda c: F.col(line_name)[c]
    often = _copies(F.col(f"`{key}`"), _propensity(propensity, n_words(F.col(f"`{text}`").cast("string"))), seed, max_copies, line)
    return (
        joined.withColumn(many, often)
        .filter(F.col(many) > 0)
        .withColumn(many, F.explode(F.array_repeat(F.lit(1), F.col(many).cast("int"))))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
