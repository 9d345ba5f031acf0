"""Repeated word sequences across documents, by fixed-block anchors.

A window of ``WINDOW`` words that two documents share holds at least one whole
block of ``BLOCK`` words that is aligned (at a multiple of BLOCK) in the first of
them, because 2 * BLOCK - 1 <= WINDOW.  So:

1. *Index and probe.*  Every document's aligned blocks are the index; every
   rolling window of BLOCK words probes it.  Entries meet by hash: a probe is a
   hit if an earlier document has that block, a block is a hit if a later
   document probes it.  Entries are distinct per document, travel packed (a
   4-byte hash inside a bucket, about a byte for the document), and only hits
   come back.
2. *Extend.*  Around each hit, the WINDOW-word sequences that hold it are the
   candidates; a sequence is repeated where a smaller document id has the same
   (by 80 bits of hash).  Runs of repeated sequences are the maximal repeats;
   their words are removed.

No pair of documents is ever formed: a block or sequence that very many
documents share costs one entry each.  What is kept of the first document that
has a passage is decided on the input, not on what is left.

Defined results: null and blank texts have no words; rows with a null id are
neither searched nor removed from; repeated rows of one id don't remove each
other; a text of fewer than WINDOW words keeps all; other columns are carried
by the caller.  An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.llm import exchange, hashing
from lattiq.llm.common import mix, shuffle_partitions, window_hashes

WINDOW = 13
BLOCK = 7
CHUNK_WORDS = 2_000_000
BUCKETS_PER_PARTITION = 3

_ANCHOR = {"hash": "<u4", "doc": "<u4"}
_SEQUENCE = {"hash": "<u8", "more": "<u2", "doc": "<u4", "pos": "<u4"}
_LAST = np.iinfo(np.int64).max


def _anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the rolling windows of BLOCK words, and which of them are aligned blocks."""
    rolling = window_hashes(words, BLOCK)
    found = np.unique(rolling)
    aligned = np.zeros(len(found), bool)
    aligned[np.searchsorted(found, rolling[::BLOCK])] = True
    return found, aligned


def _split(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a hash, by bits that its low 32 don't tell."""
    return ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], of: Callable, flush: Callable) -> Iterator[pa.RecordBatch]:
    """Feeds rows to ``of(row number in the chunk, columns)`` and flushes every CHUNK_WORDS."""
    ids: list[int] = []
    parts: list[tuple] = []
    n = 0
    for batch in batches:
        for row in range(len(batch)):
            got = of(len(ids), batch, row)
            if got is None:
                continue
            ids.append(batch.column(0)[row].as_py())
            parts.append(got)
            n += len(got[0])
            if n >= CHUNK_WORDS:
                yield from flush(ids, parts)
                ids, parts, n = [], [], 0
    if parts:
        yield from flush(ids, parts)


def _probe(texts: DataFrame, buckets: int) -> DataFrame:
    def of(number: int, batch: pa.RecordBatch, row: int):
        if not batch.column(0)[row].is_valid:
            return None
        found, _ = hashing.words(batch.column(1)[row].as_py() or b"")
        if len(found) < WINDOW:
            return None
        hashes, aligned = _anchors(found)
        return hashes, np.uint32(2 * number) + aligned.astype(np.uint32)

    def flush(ids: list[int], parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        hashes = np.concatenate([p[0] for p in parts])
        doc = np.concatenate([p[1] for p in parts])
        columns = {"hash": hashes.astype(np.uint32), "doc": doc}
        yield from exchange.pack(_split(hashes, buckets), columns, ("hash",), np.array(ids, np.int64))

    return texts.mapInArrow(lambda batches: _chunks(batches, of, flush), exchange.SCHEMA)


def _gather(table: pa.Table, columns: dict[str, str], hashes: tuple[str, ...]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """All entries of a bucket, and the document id of each."""
    got, ids = [], []
    for payload in table.column("payload"):
        entries, shared = exchange.unpack(payload.as_py(), columns, hashes)
        got.append(entries)
        ids.append(shared[entries["doc"] >> 1 if columns is _ANCHOR else entries["doc"]])
    return {k: np.concatenate([g[k] for g in got]) for k in columns}, np.concatenate(ids)


def _hits(table: pa.Table) -> pa.Table:
    bucket = table.column("bucket")[0].as_py()
    entries, doc = _gather(table, _ANCHOR, ("hash",))
    block = (entries["doc"] & 1).astype(bool)
    order = np.argsort(entries["hash"], kind="stable")
    h, doc, block = entries["hash"][order], doc[order], block[order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    size = np.diff(np.append(starts, len(h)))
    first = np.repeat(np.minimum.reduceat(np.where(block, doc, _LAST), starts), size)
    last = np.repeat(np.maximum.reduceat(doc, starts), size)
    hit = (doc > first) | (block & (doc < last))
    key = (np.int64(bucket) << np.int64(32)) | h[hit].astype(np.int64)
    return pa.table({"id": doc[hit], "key": key})


def _candidates(joined: DataFrame, buckets: int) -> DataFrame:
    def of(number: int, batch: pa.RecordBatch, row: int):
        if not batch.column(2)[row].is_valid:
            return None
        words, _ = hashing.words(batch.column(1)[row].as_py() or b"")
        rolling = window_hashes(words, BLOCK)
        key = (_split(rolling, buckets) << np.int64(32)) | rolling.astype(np.uint32).astype(np.int64)
        keys = np.asarray(batch.column(2)[row].values)
        at = np.flatnonzero(np.isin(key, keys))
        n = len(words) - WINDOW + 1
        if n <= 0 or not len(at):
            return None
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, np.maximum(at - (WINDOW - BLOCK), 0), 1)
        np.add.at(edge, np.minimum(at, n - 1) + 1, -1)
        pos = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        h = window_hashes(words, WINDOW)[pos]
        more = (mix(window_hashes(words ^ np.uint64(0xD6E8FEB86659FD93), WINDOW)[pos]) & np.uint64(0xFFFF)).astype(np.uint16)
        return h, more, np.full(len(pos), number, np.uint32), pos.astype(np.uint32)

    def flush(ids: list[int], parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        columns = {k: np.concatenate([p[i] for p in parts]) for i, k in enumerate(_SEQUENCE)}
        bucket = (columns["hash"] % np.uint64(buckets)).astype(np.int64)
        yield from exchange.pack(bucket, columns, ("hash", "more"), np.array(ids, np.int64))

    return joined.mapInArrow(lambda batches: _chunks(batches, of, flush), exchange.SCHEMA)


def _repeats(table: pa.Table) -> pa.Table:
    entries, doc = _gather(table, _SEQUENCE, ("hash", "more"))
    order = np.lexsort((entries["more"], entries["hash"]))
    h, more, doc, pos = entries["hash"][order], entries["more"][order], doc[order], entries["pos"][order]
    starts = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (more[1:] != more[:-1])]))
    first = np.repeat(np.minimum.reduceat(doc, starts), np.diff(np.append(starts, len(h))))
    hit = first < doc
    return pa.table({"id": doc[hit], "start": pos[hit].astype(np.int32)})


def repeats(texts: DataFrame) -> DataFrame:
    """(id, starts): the starts of the repeated sequences of each document that has any.

    ``texts`` has (doc, text as binary), the document ids as longs.
    """
    buckets = BUCKETS_PER_PARTITION * shuffle_partitions(texts.sparkSession)
    hits = _probe(texts, buckets).groupBy("bucket").applyInArrow(_hits, "id bigint, key bigint")
    hits = hits.groupBy("id").agg(F.collect_list("key").alias("keys"))
    # An outer join, as the last one is: both read one shuffle of the texts.
    joined = texts.join(hits, texts["doc"] == hits["id"], "left").select("doc", "text", "keys")
    found = _candidates(joined, buckets).groupBy("bucket").applyInArrow(_repeats, "id bigint, start int")
    # A document's own starts are gathered, never those of others.
    return found.groupBy("id").agg(F.collect_list("start").alias("starts"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_removed, kept_text) of every row."""
    texts = docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").cast("binary").alias("text"))
    found = repeats(texts)
    joined = texts.join(found, texts["doc"] == found["id"], "left").select("doc", "text", "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept = [], [], []
            for t, s in zip(batch.column(1), batch.column(2), strict=True):
                words = (t.as_py() or b"").split()
                n.append(len(words))
                if s.is_valid:
                    edge = np.zeros(len(words) + 1, np.int64)
                    at = np.unique(np.asarray(s.values))
                    edge[at] += 1
                    edge[at + WINDOW] -= 1
                    covered = np.cumsum(edge[:-1]) > 0
                    gone.append(int(covered.sum()))
                    words = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
                else:
                    gone.append(0)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())],
                names=["key", "n_words", "n_removed", "kept_text"],
            )

    return joined.mapInArrow(run, "key bigint, n_words bigint, n_removed bigint, kept_text binary")


def digest(removed: DataFrame) -> DataFrame:
    """The kept text by its hash."""
    return removed.select("key", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def sha256(words: list[bytes]) -> str:
    """What :func:`digest` gives for these words."""
    return hashlib.sha256(b" ".join(words)).hexdigest()
