"""Secret scans with corpus-wide ownership, in DataFrame expressions only.

*Base spans*: three kinds of match, leftmost and non-overlapping for each kind
(``KINDS``), found in whole texts.  *Candidates* are the values in them and in
the matches of further kinds (``MORE_KINDS``).  A candidate's hash is counted
over distinct repositories and owners in the whole corpus: a value that more
than ``MAX_OWNERS`` owners or ``MAX_REPOS`` repositories have is a copied example;
one that stays with few of both and doesn't look like a placeholder is
*live-looking*.  The method adds the spans of live-looking matches of the further
kinds; base spans always stay.

Positions come from cutting the text at the matches: match ``i`` starts after
the pieces and matches before it, so no expression works per character in
Python and nothing is exploded but matches.

Counting: the owners and repositories of a hash are made distinct with map-side
combining before they are counted, so a value on a third of all rows arrives
once a task for each of them.  Only the hashes of copied examples go back to the
candidates, by a salted join; base spans travel there without their values.

Defined results: a null or empty text has no spans and the hash of the empty
string; null owners or repositories count as one owner or repository; repeated
rows are scanned each for itself; very long texts, and texts with very many
matches, are scanned whole; other columns are carried by the caller.  An empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.llm.common import cut

#: Kinds as they are given: name, pattern, capture group of the value, least characters of that group (fixed values).
KINDS: tuple[tuple[str, str, int, int], ...] = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
MORE_KINDS: tuple[tuple[str, str, int, int], ...] = (
    ("bearer", r"[Bb]earer\x20+([A-Za-z0-9._~+/-]{20,})", 1, 20),
    ("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 28),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]+", 0, 64),
)
#: Cheap patterns, one of which is in any text that has a match of the kind.
HINTS = {
    "assign": r"(?i)password|passwd|secret|token|api_?key", "access": "AKIA", "hex": "[0-9a-f]{24}", "bearer": "earer ",
    "forge": "gh[pousr]_", "jwt": "eyJ", "pem": "PRIVATE KEY-----",
}
PLACEHOLDER = r"(?i)example|placeholder|changeme|your|dummy|sample|xxxx|test|^(.)\1+$|123456"
MAX_OWNERS = 2
MAX_REPOS = 4
SALT = 16
STRETCH = 256

SPAN = "struct<kind:string, rank:int, start:int, end:int, value:string>"


def _matches(text: Column, kind: tuple[str, str, int, int], rank: int) -> Column:
    """The spans of a kind, in order of start."""
    name, pattern, group, least = kind
    p, none = F.lit(pattern), F.array().cast(f"array<{SPAN}>")
    whole = F.regexp_extract_all(text, p, F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, p, F.lit(group))
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
    parts = F.zip_with(F.arrays_zip(between.alias("gap"), whole.alias("hit")), value, lambda x, v: F.struct(
        F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), v.alias("value")))
    spans = F.when(F.size(whole) > 0, _let(parts, lambda found: _spans(found, name, rank, least)))
    return F.when(text.rlike(HINTS[name]), F.coalesce(spans, none)).otherwise(none)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spans(parts: Column, name: str, rank: int, least: int) -> Column:
    """Spans from (gap, hit, value), whose places are running sums.

    Sums run within stretches of STRETCH matches, and over the stretches, so a
    text with very many matches doesn't copy all it has found at each of them.
    """
    stretches = F.transform(F.sequence(F.lit(1), F.size(parts), F.lit(STRETCH)), lambda k: F.slice(parts, k, STRETCH))
    length = lambda stretch: F.aggregate(stretch, F.lit(0), lambda n, x: n + x["gap"] + x["hit"])

    def places(each: Column) -> Column:
        """Where each stretch begins."""
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        step = lambda acc, x: F.struct((acc["at"] + length(x)).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all"))
        return F.aggregate(each, start, step, lambda acc: acc["all"])

    def one(stretch: Column, begin: Column) -> Column:
        start = F.struct(begin.alias("at"), F.array().cast(f"array<{SPAN}>").alias("found"))

        def step(acc: Column, x: Column) -> Column:
            first = acc["at"] + x["gap"]
            end = first + x["hit"]
            span = F.struct(F.lit(name).alias("kind"), F.lit(rank).alias("rank"), first.alias("start"), end.alias("end"), x["value"].alias("value"))
            found = F.when(F.length(x["value"]) >= least, F.concat(acc["found"], F.array(span))).otherwise(acc["found"])
            return F.struct(end.alias("at"), found.alias("found"))

        return F.aggregate(stretch, start, step, lambda acc: acc["found"])

    return _let(stretches, lambda each: _let(places(each), lambda at: F.flatten(F.transform(each, lambda x, k: one(x, F.get(at, k))))))


def _packed(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"])))
    return F.array_join(
        F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, n_repos, n_owners) from (hash, repo, owner)."""
    name = lambda owns, c: F.struct(F.lit(owns).alias("owns"), F.col(c).alias("name"))
    # Owners and repositories of a hash are made distinct in one combined step, and counted in another.
    seen = candidates.select("hash", F.inline(F.array(name(True, "owner"), name(False, "repo")))).distinct()
    return seen.groupBy("hash").agg(F.count_if(~F.col("owns")).alias("n_repos"), F.count_if("owns").alias("n_owners"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", repo: str | Column = "source", owner: str | Column = "source", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """(row, key, base, more, n_live, n_example) of every row; ``more`` are the added spans."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    column = lambda c: (F.col(f"`{c}`") if isinstance(c, str) else c).cast("string")
    of = docs.select(F.col(f"`{key}`").alias("key"), column(repo).alias("repo"), column(owner).alias("owner"), body.alias("body"))
    kinds = [*KINDS, *MORE_KINDS]
    found = of.select("key", "repo", "owner", *[_matches(F.col("body"), k, i).alias(k[0]) for i, k in enumerate(kinds)])
    book = found.select(
        F.monotonically_increasing_id().alias("row"), "key", "repo", "owner",
        F.concat(*[F.col(k[0]) for k in KINDS]).alias("base"), F.concat(*[F.col(k[0]) for k in MORE_KINDS]).alias("extra"),
    )
    book = cut(book)  # spans only, no text; row numbers are fixed from here on
    span = F.col("span")
    each = book.select("row", "repo", "owner", F.explode(F.concat("base", "extra")).alias("span")).select(
        "row", "repo", "owner", F.unhex(F.sha2(span["value"], 256)).alias("hash"), (~span["value"].rlike(PLACEHOLDER)).alias("plain"),
        F.when(span["rank"] >= len(KINDS), span).alias("extra"),
    )
    counts = ownership(each.select("hash", "repo", "owner"))
    copies = counts.filter((F.col("n_owners") > max_owners) | (F.col("n_repos") > max_repos))
    salted = copies.select("hash", F.lit(True).alias("copied"), F.explode(F.array(*[F.lit(i) for i in range(SALT)])).alias("salt"))
    classed = each.drop("repo", "owner").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALT)).cast("int")).join(salted, ["hash", "salt"], "left")
    copied = F.col("copied").isNotNull()
    live = ~copied & F.col("plain")
    per = classed.groupBy(F.col("row").alias("__row")).agg(
        F.collect_list(F.when(live, F.col("extra"))).alias("more"),
        F.sum(live.cast("long")).alias("n_live"),
        F.sum(copied.cast("long")).alias("n_example"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return book.join(per, F.col("row") == F.col("__row"), "left").select(
        "row", "key", "base", F.coalesce(F.col("more"), F.array().cast(f"array<{SPAN}>")).alias("more"), zero("n_live"), zero("n_example")
    )


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans and all spans as text."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select(
        "key", *[count(k[0]) for k in KINDS], F.sha2(_packed(F.col("base")), 256).alias("base_sha256"),
        _packed(F.concat("base", "more")).alias("spans"), "n_live", "n_example",
    )
