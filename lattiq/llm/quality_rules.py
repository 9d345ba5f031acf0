"""Quality rules as a bitmask ledger, in DataFrame expressions only.

Every rule is evaluated once per document.  The ledger keeps what was measured
and one bit per failed rule (``fail_bits``), so a policy - a versioned mask of
rules - is applied afterwards by one bitwise *and*, and ablations (what a rule
removes alone, what a policy would keep without it) are bitwise aggregates over
at most ``2 ** rules`` pre-aggregated bit patterns, with no second look at text.

Defined results: a null or blank text has no words, fails ``few_words`` and is
not kept.  Repeated rows are judged alike, each for itself; columns of the input
are carried along and never read except the text, and new columns whose names
are taken get a trailing underscore.  An empty table gives an empty ledger.

Exactness: windows of words are compared by 64-bit hash within one document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.llm.common import free_name, words

SYMBOLS = "[#*$%&|<>]"
WINDOW = 8

#: Name and failing condition of each rule over the measurements, in bit order.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 40 * n_lines"),
    ("shouting", "100 * n_upper > 40 * word_chars"),
    ("exclamations", "2 * n_exclaim > n_words"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
)
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_exclaim",
)


@dataclass(frozen=True)
class Policy:
    """A named, versioned choice of rules; a document passes if it fails none of them."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        bits = {name: 1 << i for i, (name, _) in enumerate(RULES)}
        return sum(bits[r] for r in set(self.rules))


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
FULL = Policy("full", 1, tuple(name for name, _ in RULES))
POLICIES = (BASE, FULL)


def _held(made: Column) -> Column:
    """The same value, in a projection that later filters stay above.

    A filter pushed below would be rewritten in terms of the text, and would
    evaluate each step again inside the lambdas of the next.
    """
    return F.when(F.monotonically_increasing_id() >= 0, made)


def _repeat_words(df: DataFrame, tokens: str, out: str) -> DataFrame:
    """Adds ``out``: words inside windows of WINDOW words that occur twice or more.

    Each step is a projection of its own because a lambda that names an
    expression (not a column) would evaluate it again for every element.
    """
    hashes, windows, ranked, places = (free_name(df, f"__{x}") for x in ("hash", "windows", "ranked", "places"))
    df = df.withColumn(hashes, _held(F.transform(tokens, lambda w: F.xxhash64(w))))
    starts = F.sequence(F.lit(1), F.size(hashes) - F.lit(WINDOW - 1))
    df = df.withColumn(
        windows,
        _held(F.when(F.size(hashes) >= WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, WINDOW))))),
    )
    repeats = F.size(F.array_distinct(windows)) < F.size(windows)
    df = df.withColumn(
        ranked,
        _held(F.when(repeats, F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))),
    )
    df = df.withColumn(
        places,
        _held(
            F.sort_array(
                F.transform(
                    F.filter(
                        ranked,
                        lambda x, j: F.coalesce(F.get(ranked, j - 1)["h"] == x["h"], F.lit(False))
                        | F.coalesce(F.get(ranked, j + 1)["h"] == x["h"], F.lit(False)),
                    ),
                    lambda x: x["i"],
                )
            )
        ),
    )
    covered = F.aggregate(
        F.transform(places, lambda p, j: F.coalesce(F.least(F.lit(WINDOW), F.get(places, j + 1) - p), F.lit(WINDOW))),
        F.lit(0),
        lambda total, x: total + x,
    )
    return df.withColumn(out, _held(F.coalesce(covered, F.lit(0)).cast("long"))).drop(hashes, windows, ranked, places)


def measure(df: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``df`` with the measurements; also the name that each one got."""
    name: dict[str, str] = {}
    for m in MEASURES:
        name[m] = free_name(df, m)
    body, tokens, lines = (free_name(df, f"__{x}") for x in ("body", "tokens", "lines"))
    out = df.withColumn(body, F.coalesce(F.col(text).cast("string"), F.lit("")))
    out = out.withColumn(tokens, _held(words(F.col(body)))).withColumn(
        lines, _held(F.filter(F.split(F.col(body), "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    )
    count = lambda pattern: F.regexp_count(F.col(body), F.lit(pattern)).cast("long")
    out = out.withColumns(
        {
            name["n_words"]: F.size(tokens).cast("long"),
            name["word_chars"]: F.length(F.array_join(tokens, "")).cast("long"),
            name["n_symbols"]: count(SYMBOLS),
            name["n_lines"]: F.size(lines).cast("long"),
            name["n_dup_lines"]: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            name["n_upper"]: count("[A-Z]"),
            name["n_exclaim"]: count("!"),
        }
    )
    return _repeat_words(out, tokens, name["n_repeat_words"]).drop(body, tokens, lines), name


def ledger(df: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``df`` with measurements and ``fail_bits``; also the names that were given."""
    out, name = measure(df, text)
    bits: Column = F.lit(0).cast("long")
    for i, (_, condition) in enumerate(RULES):
        for m in MEASURES:
            condition = " ".join(f"`{name[m]}`" if x == m else x for x in condition.split(" "))
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    name["fail_bits"] = free_name(out, "fail_bits")
    return out.withColumn(name["fail_bits"], bits), name


def passes(fail_bits: str | Column, policy: Policy) -> Column:
    """True where a document fails no rule of the policy."""
    bits = F.col(fail_bits) if isinstance(fail_bits, str) else fail_bits
    return bits.bitwiseAND(F.lit(policy.mask)) == 0


def apply_policy(df: DataFrame, policy: Policy, text: str = "text") -> DataFrame:
    """The rows of ``df`` that pass, with its own columns only."""
    out, name = ledger(df, text)
    return out.filter(passes(name["fail_bits"], policy)).select(*[F.col(f"`{c}`") for c in df.columns])


def ablation(book: DataFrame, policies: tuple[Policy, ...] = POLICIES, fail_bits: str = "fail_bits") -> DataFrame:
    """Per policy and rule: documents that fail it, that fail it alone, and that
    the policy would keep without it.  The ledger is reduced to its bit patterns
    first (map-side combined, at most ``2 ** rules`` rows)."""
    patterns = book.groupBy(F.col(fail_bits).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    spark = book.sparkSession
    grid = spark.createDataFrame(
        [(p.name, p.version, rule, p.mask, 1 << i) for p in policies for i, (rule, _) in enumerate(RULES) if rule in p.rules],
        "policy string, version int, rule string, mask bigint, bit bigint",
    )
    has = F.col("bits").bitwiseAND(F.col("bit")) != 0
    failed = F.col("bits").bitwiseAND(F.col("mask"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    # Both sides are bounded by the number of rules, never by the documents.
    return (
        patterns.join(F.broadcast(grid))
        .groupBy("policy", "version", "rule")
        .agg(
            total(has).alias("n_failed"),
            total(failed == F.col("bit")).alias("n_failed_alone"),
            total(failed.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("n_kept_without"),
        )
    )
