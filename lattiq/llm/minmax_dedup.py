"""Near-duplicate documents by min-max hashing.

A document is its set of distinct ``width``-word shingles (A-Z in lower case);
with fewer words, the whole sequence is the one shingle.  Under each of
``PERMUTATIONS`` permutations both the smallest and the largest value are kept,
so a signature of ``2 * PERMUTATIONS`` places costs half the hash evaluations,
and it estimates Jaccard without bias and with lower variance than as many
independent minima.  Bands of ``ROWS`` places are keys; documents that share a
key are candidates, and links are confirmed on full sets.

The job is whole without pairing every group with itself:

1. Documents with the same set are one *class*, represented by the smallest id.
2. In every bucket each class is compared with the bucket's smallest one: a
   number of pairs that is linear in the bucket, however large it is.
3. Links give components.  A bucket whose members are then all in one component
   is done.  Members of the other buckets are compared across components, in
   blocks of ``BLOCK`` classes a task: the block pairs are dealt over tasks, sets
   travel once a block pair, and only confirmed links come out.
4. Components of all links, by large-star and small-star steps.

Nothing is capped: no bucket is skipped, whatever its size.  A pair of
similarity J shares no key with probability (1 - J ** ROWS) ** BANDS: 6.7e-6 at
0.80, 2.3e-8 at 0.85; such a pair is compared only if other links lead to it.

Defined results: null, empty and blank texts have no shingles and are linked
with nothing; rows with a null id are linked with nothing, kept, and have a null
component; repeated rows of one id are one document and all say the same; other
columns are carried by the caller.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.llm import hashing
from lattiq.llm.common import cut, free_name, mix, window_hashes

PERMUTATIONS = 75
ROWS = 5
BANDS = 30
BLOCK = 256
SEED = 20240229

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    if not text:
        return np.empty(0, np.uint64)
    h, _ = hashing.words(text.translate(_LOWER))
    if len(h) < width:
        # Told apart from windows, and from each other, by their number of words.
        return window_hashes(np.append(h, np.uint64(len(h))), len(h) + 1) ^ np.uint64(0x5BD1E995) if len(h) else h
    return np.unique(window_hashes(h, width))


def _factors() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(SEED)
    return draw.integers(0, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 1 << 63, PERMUTATIONS, np.uint64)


def signature(found: np.ndarray, factors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Minimum and maximum under each permutation, a permutation's two side by side."""
    a, b = factors
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(a), np.uint64)
    for lo in range(0, len(found), 512):
        x = found[lo : lo + 512, None] * a + b
        x ^= x >> np.uint64(32)
        x *= a
        np.minimum(low, x.min(axis=0), out=low)
        np.maximum(high, x.max(axis=0), out=high)
    return np.stack([low, high], axis=1).ravel()


def bands(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key a band; the places of a band come from ROWS different permutations."""
    table = sig.reshape(PERMUTATIONS, 2).T.reshape(-1)[: ROWS * BANDS].reshape(BANDS, ROWS)
    return mix(window_sum(table) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def window_sum(table: np.ndarray) -> np.ndarray:
    out = np.zeros(len(table), np.uint64)
    for k in range(table.shape[1]):
        out = mix(out + table[:, k])
    return out


def _describe(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(id, n, class, keys) of each row: set size, 128-bit hash of the set, band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _factors()
        for batch in batches:
            n, classes, keys = [], [], []
            for t in batch.column(1):
                found = shingles(t.as_py(), width)
                n.append(len(found))
                classes.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                keys.append(bands(signature(found, factors)) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(classes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["id", "n", "class", "keys"],
            )

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("binary").alias("text"))
    return rows.mapInArrow(run, "id bigint, n bigint, class binary, keys array<bigint>")


def _sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(id, found) for the ids in ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), width).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["id", "found"])

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("binary").alias("text"))
    return rows.join(wanted, "id", "left_semi").mapInArrow(run, "id bigint, found array<bigint>").dropDuplicates(["id"])


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("found").alias("fa"))
    right = sets.select(F.col("id").alias("b"), F.col("found").alias("fb"))
    both = F.size(F.array_intersect("fa", "fb"))
    every = F.size("fa") + F.size("fb") - both
    return pairs.join(left, "a").join(right, "b").filter(100 * both >= percent * every).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b): the smallest id that it reaches.

    Large-star then small-star, until nothing changes; each round is written to
    the checkpoint folder.  Every step is a minimum per node with map-side
    combining and a join of one row a node, so a node with very many links only
    adds rows that a skewed join can split.
    """
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    state = None
    while True:
        around = both(edges)
        least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        star = around.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = star.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            star.join(down, "a")
            .select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .filter("a <> b")
            .distinct()
        )
        edges = cut(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first()
        if now == state:
            break
        state = now
    return cut(edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()))


def _blocks(buckets: DataFrame, sets: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """Links across components within buckets that hold more than one component."""
    labelled = buckets.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = labelled.groupBy("key").agg(
        F.count(F.lit(1)).alias("members"), F.min("component").alias("lo"), F.max("component").alias("hi")
    ).filter("lo <> hi AND members > 2")
    # The same members meet in many buckets: one bucket of each membership is enough.
    mixed = labelled.join(mixed, "key")
    same = mixed.groupBy("key", "members").agg(F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("who"))
    once = same.groupBy("who", "members").agg(F.min("key").alias("key"))
    mixed = mixed.drop("members").join(once.select("key", "members"), "key")
    parts = F.ceil(F.col("members") / BLOCK).cast("int")
    mixed = mixed.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = mixed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "component", "id"
    )

    def run(table: pa.Table) -> pa.Table:
        ids, comps, part = (table.column(c).to_numpy() for c in ("id", "component", "part"))
        found = [np.asarray(x.values) for x in table.column("found").combine_chunks()] if table.num_rows else []
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        sizes = np.array([len(f) for f in found])
        left = np.flatnonzero(part == i)
        right = np.flatnonzero(part == j)
        out: list[tuple[int, int]] = []
        for x in left:
            near = right[(comps[right] != comps[x]) & ((ids[right] > ids[x]) | (i != j))]
            near = near[100 * np.minimum(sizes[near], sizes[x]) >= percent * np.maximum(sizes[near], sizes[x])]
            for y in near:
                both = len(np.intersect1d(found[x], found[y], assume_unique=True))
                if 100 * both >= percent * (sizes[x] + sizes[y] - both):
                    out.append((ids[x], ids[y]))
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return dealt.join(sets, "id").groupBy("key", "i", "j").applyInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row of ``docs``."""
    book = cut(_describe(docs, key, text, width))
    classes = cut(book.filter("id IS NOT NULL AND class IS NOT NULL").groupBy("class").agg(
        F.min("id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys")))
    buckets = classes.select("id", "n", F.explode("keys").alias("key"))
    first = buckets.groupBy("key").agg(F.min(F.struct("id", "n")).alias("first"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    shared = cut(buckets.join(first, "key"))
    stars = (
        shared.filter(F.col("id") != F.col("first")["id"])
        .filter(100 * F.least("n", F.col("first")["n"]) >= percent * F.greatest("n", F.col("first")["n"]))
        .select(F.col("first")["id"].alias("a"), F.col("id").alias("b"))
        .distinct()
    )
    # Sets are needed where a pair is to be compared, or a bucket has a third member.
    wanted = shared.select("id").distinct()
    sets = cut(_sets(docs, wanted, key, text, width))
    links = cut(_confirm(stars, sets, percent))
    label = components(links)
    more = cut(_blocks(shared.select("key", "id"), sets, label, percent))
    if more.limit(1).count():
        label = components(links.unionByName(more))
    of_class = classes.select("class", "id").join(label, "id", "left").select("class", F.coalesce("component", "id").alias("component"))
    named = book.select("id", "n", "class").join(of_class, "class", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return named.select(
        F.col("id").alias("key"), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each group."""
    name = free_name(docs, "__gone")
    gone = near_duplicates(docs, key, text, width, percent).filter(~F.col("kept")).select(F.col("key").alias(name)).distinct()
    return docs.join(cut(gone), F.col(f"`{key}`").cast("long") == F.col(name), "left_anti")
