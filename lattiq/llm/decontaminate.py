"""Benchmark decontamination by latent semantic retrieval.

*Words* are compared in lower case (A-Z) without ASCII punctuation.

1. *Statistics.*  Document frequencies of the benchmark's words over the whole
   corpus.  Words in more than ``MAX_DF`` of the documents weigh nothing, except
   for items that would keep fewer than ``MIN_TERMS`` words.
2. *Latent spaces.*  The benchmark's passages (``WINDOW`` words, every ``STRIDE``),
   ``RANK`` to a space, as TF-IDF rows of a distributed matrix; randomised SVD with power iterations:
   partitions multiply their rows by a thin matrix, partial products are summed
   by term, and only the thin matrix (terms of some spaces, ``TERMS`` or one
   space, by ``RANK`` plus ``OVERSAMPLE``) reaches the driver.  A space is fitted on the passages that
   are searched for, because rare words tell passages apart and would fall out of
   a space fitted on the corpus; as it has no more passages than RANK, no inner
   product with them is lost, however large the benchmark.
3. *Candidates.*  Every window of every document - whole texts, windows of
   ``WINDOW`` words every ``STRIDE`` - is projected into each space; a window is a candidate for a
   passage if the cosine is at least ``COSINE`` and it holds ``CONTAINED`` of the
   passage's own weight.
4. *Checks.*  The longest common subsequence of the item and the window with its
   surroundings, over the item's length: ``SURE`` or more is a hit; from
   ``POSSIBLE`` on it is one if the answer - its own column, or what follows
   "answer:", or the item's last words - is found too (``ANSWERED`` of its
   distinct words): a paraphrase.

Items go in blocks of ``ITEMS`` items or passages, each searched against all rows
in one pass; what is sent to the executors is bounded by a block, but for the
passages of its last item.

Defined results: null, empty and blank texts hit nothing; items without words
are hit by nothing; items of fewer than ``LEAST_WORDS`` words must be there in
full (every word, in order and together); repeated rows are judged alike; null
ids are judged by their text; a very long text is searched whole, WINDOWS windows
at a time; other columns are carried by the caller.  An empty
corpus or benchmark gives no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW = 64
STRIDE = 32
WINDOWS = 2048
RANK = 256
OVERSAMPLE = 32
POWER = 2
SEED = 7
ITEMS = 4096
TERMS = 32768
MAX_DF = 0.05
MIN_TERMS = 8
COSINE = 0.4
CONTAINED = 0.4
SURE = 0.75
POSSIBLE = 0.5
ANSWERED = 0.6
LEAST_WORDS = 8

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
HIT = "array<struct<item:bigint,cosine:double,lcs:double,answered:boolean,start:int>>"


def normal_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_LOWER, _PUNCTUATION).split()


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, one bit a word of ``a``."""
    where: dict = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        if u := row & where.get(w, 0):
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


@dataclass
class Space:
    """The latent space of at most RANK passages, in which no inner product with them is lost."""

    local: np.ndarray  # row in ``basis`` of each word of the vocabulary, or -1
    basis: np.ndarray  # terms of these passages x rank, times idf
    passages: np.ndarray  # passages x rank, raw
    owner: np.ndarray
    norm: np.ndarray


@dataclass
class Model:
    """What a block of items needs to be searched for."""

    items: list[int]
    texts: list[list[bytes]]
    answers: list[set[bytes]]
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    idf: np.ndarray = field(default_factory=lambda: np.empty(0, np.float32))
    spaces: list[Space] = field(default_factory=list)

    def hits(self, text: bytes | None) -> list[tuple[int, float, float, bool, int]]:
        """(item, cosine, lcs share, answered, first word of the window), the best of each item."""
        words = normal_words(text)
        if not words or not self.spaces:
            return []
        terms = np.fromiter((self.vocabulary.get(w, -1) for w in words), np.int64, len(words))
        at = np.flatnonzero(terms >= 0)
        at = at[self.idf[terms[at]] > 0]
        best: dict[int, tuple[int, float, float, bool, int]] = {}
        tried: dict[tuple[int, int], tuple[float, bool]] = {}
        for space in self.spaces:
            for i, start, cosine in self.candidates(space, terms, at):
                if (i, start) not in tried:
                    tried[i, start] = self.check(i, words, start)
                share, answered = tried[i, start]
                if (share >= SURE or (share >= POSSIBLE and answered)) and (i not in best or (share, cosine) > (best[i][2], best[i][1])):
                    best[i] = (self.items[i], cosine, share, answered, start)
        return sorted(best.values())

    def candidates(self, space: Space, terms: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(item, first word of the window, cosine); ``at`` are the places of the words that weigh something.

        Windows are two neighbouring blocks of STRIDE words; a block is projected
        once, WINDOWS at a time, so a very long text needs no more room.
        """
        row = space.local[terms[at]]
        at, row = at[row >= 0], row[row >= 0]
        block = at // STRIDE
        for lo in range(0, len(terms) // STRIDE + 1, WINDOWS):
            a, b = np.searchsorted(block, [lo, lo + WINDOWS + 1])
            if a < b:
                yield from self._near(space, block[a:b] - lo, row[a:b], self.idf[terms[at[a:b]]], lo)

    def _near(self, space: Space, block: np.ndarray, row: np.ndarray, weight: np.ndarray, lo: int) -> Iterator[tuple[int, int, float]]:
        """The candidates of WINDOWS windows from the ``lo``-th on."""
        mass = np.bincount(block, weight, WINDOWS + 1)
        # |z| is at most the sum of weights: windows below the least passage can hold nothing.
        some = mass[:-1] + mass[1:] >= CONTAINED * space.norm.min()
        need = np.append(some, False)
        need[1:] |= some
        keep = need[block]
        block, row = block[keep], row[keep]
        if not len(block):
            return
        used = np.flatnonzero(some)
        first = np.flatnonzero(np.diff(block, prepend=-1))
        spot = np.full(WINDOWS + 1, len(first))
        spot[block[first]] = np.arange(len(first))
        z = np.vstack([np.add.reduceat(space.basis[row], first, axis=0), np.zeros((1, space.basis.shape[1]), np.float32)])
        z = z[spot[used]] + z[spot[used + 1]]
        length = np.linalg.norm(z, axis=1)
        inner = z @ space.passages.T
        fit = (inner >= CONTAINED * space.norm**2) & (inner >= COSINE * length[:, None] * space.norm)
        for w, p in zip(*np.nonzero(fit), strict=True):
            yield int(space.owner[p]), (lo + int(used[w])) * STRIDE, float(inner[w, p] / (length[w] * space.norm[p]))

    def check(self, i: int, words: list[bytes], start: int) -> tuple[float, bool]:
        item = self.texts[i]
        around = STRIDE if len(item) <= WINDOW else len(item)
        near = words[max(0, start - around) : start + WINDOW + around]
        if len(item) < LEAST_WORDS:
            whole = any(near[k : k + len(item)] == item for k in range(len(near) - len(item) + 1))
            return float(whole), whole
        answer = self.answers[i]
        found = len(answer.intersection(near)) if answer else 0
        return lcs(item, near) / len(item), bool(answer) and found >= ANSWERED * len(answer)


def _answer(words: list[bytes], given: bytes | None) -> set[bytes]:
    if given:
        return set(normal_words(given))
    if b"answer" in words[:-1]:
        return set(words[len(words) - words[::-1].index(b"answer") :])
    return set(words[-max(3, len(words) // 4) :])


def _spans(n: int) -> list[tuple[int, int]]:
    """Passages of an item of ``n`` words."""
    if n <= WINDOW:
        return [(0, n)]
    return [(s, min(n, s + WINDOW)) for s in range(0, n - STRIDE, STRIDE)]


def document_frequency(docs: DataFrame, text: str, vocabulary: dict[bytes, int]) -> tuple[int, np.ndarray]:
    """Number of documents, and in how many each word of the vocabulary is."""
    shared, size = docs.sparkSession.sparkContext.broadcast(vocabulary), len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total, seen = shared.value, np.zeros(size, np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                seen += 1
                found = np.fromiter((known[w] for w in known.keys() & set(normal_words(t.as_py()))), np.int64)
                total[found] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], seen))], names=["term", "n"])

    rows = docs.select(F.col(f"`{text}`").cast("binary").alias("text")).mapInArrow(run, "term bigint, n bigint")
    got = rows.groupBy("term").agg(F.sum("n").alias("n")).toPandas()  # one row a word of the block
    out = np.zeros(size + 1, np.int64)
    out[got["term"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return int(out[-1]), out[:-1]


def randomised_svd(rows: DataFrame, terms: int, rank: int = RANK, oversample: int = OVERSAMPLE, power: int = POWER, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(V, singular values) of the sparse matrix in ``rows`` (idx array<int>, val array<double>)."""
    return block_svd(rows, [terms], rank, oversample, power, seed)[0]


def block_svd(
    rows: DataFrame, parts: list[int], rank: int = RANK, oversample: int = OVERSAMPLE, power: int = POWER, seed: int = SEED
) -> list[tuple[np.ndarray, np.ndarray]]:
    """(V, singular values) of each part of a matrix whose columns fall into parts that no row crosses.

    Each pass sends every partition the thin matrix Q (terms x width) and sums
    the partitions' parts of A'(A Q) by term, for all parts of the matrix at once.
    """
    spark, terms = rows.sparkSession, sum(parts)
    ends = np.cumsum(parts).tolist()
    widths = [min(n, rank + oversample) for n in parts]
    width = max(widths)

    def product(thin: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(thin)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, part = shared.value, {}
            for batch in batches:
                for idx, val in zip(batch.column(0), batch.column(1), strict=True):
                    i, v = np.asarray(idx.values), np.asarray(val.values)
                    y = v @ q[i]
                    for t, x in zip(i.tolist(), v.tolist(), strict=True):
                        part[t] = part[t] + x * y if t in part else x * y
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(part), pa.int32()), pa.array([p.tobytes() for p in part.values()], pa.binary())], names=["term", "part"]
            )

        def add(table: pa.Table) -> pa.Table:
            total: dict[int, np.ndarray] = {}
            for t, p in zip(table.column("term").to_pylist(), table.column("part").to_pylist(), strict=True):
                total[t] = total.get(t, 0) + np.frombuffer(p)
            return pa.table({"term": pa.array(list(total), pa.int32()), "part": pa.array([p.tobytes() for p in total.values()], pa.binary())})

        schema = "term int, part binary"
        summed = rows.mapInArrow(run, schema).withColumn("lot", F.pmod(F.hash("term"), F.lit(256))).groupBy("lot")
        out = np.zeros((terms, width))
        for r in summed.applyInArrow(lambda t: add(t), schema).collect():  # terms x width of at most TERMS terms or one space
            out[r["term"]] = np.frombuffer(r["part"])
        shared.unpersist()
        return out

    places = [(slice(e - n, e), slice(0, w)) for n, e, w in zip(parts, ends, widths, strict=True)]
    draw, q = np.random.default_rng(seed), np.zeros((terms, width))
    for at in places:
        q[at] = np.linalg.qr(draw.standard_normal(q[at].shape))[0]
    for _ in range(power):
        out = product(q)
        for at in places:
            q[at] = np.linalg.qr(out[at])[0]
    out, found = product(q), []
    for at in places:
        gram = q[at].T @ out[at]
        values, turn = np.linalg.eigh((gram + gram.T) / 2)
        order = np.argsort(values)[::-1][:rank]
        values = np.sqrt(np.maximum(values[order], 0))
        good = values > 1e-6 * max(values.max(initial=0), 1e-30)
        found.append((q[at] @ turn[:, order[good]], values[good]))
    return found


def fit(docs: DataFrame, items: list[tuple[int, bytes | None, bytes | None]], text: str = "text") -> Model:
    """The model of one block of items, with statistics over all of ``docs``."""
    words = [normal_words(t) for _, t, _ in items]
    model = Model([i for i, _, _ in items], words, [_answer(w, a) if w else set() for w, (_, _, a) in zip(words, items, strict=True)])
    model.vocabulary = {w: k for k, w in enumerate(sorted({w for ws in words for w in ws}))}
    if not model.vocabulary:
        return model
    n, df = document_frequency(docs, text, model.vocabulary)
    idf = np.log((1 + n) / (1 + df)) + 1e-3
    ids = [np.array([model.vocabulary[w] for w in ws], np.int64) for ws in words]
    common = df > MAX_DF * n
    spared = [np.unique(i) for i in ids if len(i) and len(np.unique(i[~common[i]])) < min(MIN_TERMS, len(np.unique(i)))]
    if spared:
        common[np.concatenate(spared)] = False
    idf[common] = 0
    model.idf = idf.astype(np.float32)
    spans = [(k, i[a:b]) for k, i in enumerate(ids) if len(i) for a, b in _spans(len(i))]
    rows = []
    for k, part in spans:
        at, times = np.unique(part, return_counts=True)
        weight = times * idf[at]
        if (weight > 0).any():
            rows.append((k, at[weight > 0], weight[weight > 0]))
    lots: list[list] = [[]]
    terms = 0
    for a in range(0, len(rows), RANK):
        part = rows[a : a + RANK]
        used = np.unique(np.concatenate([i for _, i, _ in part]))
        if lots[-1] and terms + len(used) > TERMS:
            lots.append([])
            terms = 0
        lots[-1].append((part, used))
        terms += len(used)
    model.spaces = [space for lot in lots if lot for space in _spaces(docs.sparkSession, lot, idf)]
    return model


def _spaces(spark: SparkSession, lot: list[tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray]], idf: np.ndarray) -> Iterator[Space]:
    """The spaces of some lists of at most RANK passages (item, terms, weights), each with its terms, fitted together."""
    shift = np.cumsum([0] + [len(used) for _, used in lot]).tolist()
    data = [((np.searchsorted(used, i) + s).tolist(), v.tolist()) for (part, used), s in zip(lot, shift, strict=False) for _, i, v in part]
    matrix = spark.createDataFrame(data, "idx array<int>, val array<double>").repartition(min(64, 1 + len(data) // 64))
    for (part, used), (basis, _) in zip(lot, block_svd(matrix, [len(used) for _, used in lot]), strict=True):
        local = np.full(len(idf), -1, np.int32)
        local[used] = np.arange(len(used), dtype=np.int32)
        passages = np.stack([v @ basis[local[i]] for _, i, v in part]).astype(np.float32)
        norm = np.linalg.norm(passages, axis=1).astype(np.float32)
        yield Space(local, (basis * idf[used, None]).astype(np.float32), passages, np.array([k for k, _, _ in part], np.int64), norm)


def found_in(text: Column, model: Model, spark: SparkSession) -> Column:
    """The hits of a text (array of structs), given as a column of bytes."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(HIT)
    def search(texts: pd.Series) -> pd.Series:
        names = ("item", "cosine", "lcs", "answered", "start")
        return pd.Series([[dict(zip(names, h, strict=True)) for h in shared.value.hits(t)] for t in texts], dtype=object)

    return search(text.cast("binary"))


def _models(docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str, answer: str | None) -> Iterator[Model]:
    """A model for each block of at most ITEMS items, closed when its passages reach ITEMS."""
    rows = benchmark.select(
        F.col(f"`{item}`").cast("long"), F.col(f"`{item_text}`").cast("binary"), (F.col(f"`{answer}`") if answer else F.lit(None)).cast("binary")
    ).toLocalIterator()
    block: list = []
    passages = 0
    for r in rows:
        block.append((r[0], bytes(r[1]) if r[1] is not None else None, bytes(r[2]) if r[2] is not None else None))
        passages += len(_spans(len(normal_words(block[-1][1]))))
        if len(block) == ITEMS or passages >= ITEMS:
            yield fit(docs, block, text)
            block, passages = [], 0
    if block:
        yield fit(docs, block, text)


def search(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    answer: str | None = None,
) -> DataFrame:
    """(key, item, cosine, lcs, answered, start): a row for each item in each document."""
    out = None
    for model in _models(docs, benchmark, text, item, item_text, answer):
        hits = docs.select(F.col(f"`{key}`").alias("key"), F.explode(found_in(F.col(f"`{text}`"), model, docs.sparkSession)).alias("hit"))
        hits = hits.select("key", "hit.item", "hit.cosine", "hit.lcs", "hit.answered", "hit.start")
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        empty = "item bigint, cosine double, lcs double, answered boolean, start int"
        out = docs.select(F.col(f"`{key}`").alias("key")).limit(0).join(docs.sparkSession.createDataFrame([], empty))
    return out


def clean(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", answer: str | None = None
) -> DataFrame:
    """The rows of ``docs`` that hold no item; judged in place, so no row is matched by id."""
    out = docs
    for model in _models(docs, benchmark, text, item, item_text, answer):
        out = out.filter(F.size(found_in(F.col(f"`{text}`"), model, docs.sparkSession)) == 0)
    return out
