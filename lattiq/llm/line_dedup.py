"""Near-duplicate lines by an exact set-similarity join.

A line is its set of distinct words (unchanged); a pair is linked when the sets'
Jaccard is at least ``PERCENT`` / 100.  A line goes if an equal or linked line
stands earlier - in a document with a smaller id, or before it in its own - on
the input, not on what is left.  Lines without words always stay.

1. *Rarity.*  Words are counted over all lines in ``BINS`` hashed bins; a word's
   order is (logarithm of the lines of its bin, hash).  Any total order keeps the
   join exact, this one puts rare words first; its table has a fixed size.
2. *Prefix.*  Lines with one set are one class.  A class of ``n`` words puts its
   ``n - ceil(t * n) + 1`` first words into an index, each with ``n``, its place
   and 64 bits to which every word of the set adds one (without carry); 128 beyond
   ``LONG`` words and 256 beyond ``LONGER``, where the sets may differ in so many
   words that fewer bits tell nothing.  Two entries of a word are a candidate if
   their lengths allow the threshold, if the words that can follow both places do
   (positional filter), and if the sets' bits differ in no more places than the
   sets may differ in words.  None of these can lose a link.  Words of one line
   only, and classes whose length admits no other partner, are not indexed.
3. *Verify.*  Entries with a candidate are marked, one row an entry.  Candidates of
   one word that are connected share a room, and the lines of marked classes go to
   the buckets of their rooms, where full sets decide: pair by pair, or by a product
   of incidence matrices where many sets of a block are alike.  A link counts in
   one of the rooms that both sets were sent to.  Only counts and the earliest
   partner of a class leave a task, so nothing that travels grows with the pairs
   of a group.
4. *Remove.*  A class's earliest place is that of itself and its links.

Entries travel packed, by buckets of words; a word on very many classes is
compared in slices of ``SLICE`` and blocks of ``BLOCK`` entries.  Copies of a line
are one class and never pair.

Words are told apart by 42 bits of hash until sets are compared (there by 64);
classes are named by 128 bits; marks carry 64 of them, and what two classes share
there is told apart again when sets are compared.

Defined results: null and empty texts have one line without words; rows with a
null id come before all others; repeated rows of one id are told apart by their
text only, so of two equal rows the lines of both stay or go alike; other
columns are carried by the caller.  A text of any length is read whole; a line of
very many words has a long prefix and is compared like any other.  An empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.llm import exchange, hashing, url_filter
from lattiq.llm.common import MASK64, cut, mix, shuffle_partitions

PERCENT = 80
BINS = 1 << 22
SEGMENTS = 16
TOKEN_BITS = 42
LINE_BITS = 64 - TOKEN_BITS
RANK_BITS = 10
SLICE = 2048
SHORT = 64
LONG = 96
LONGER = 224
BLOCK = 256
FEW = 4096
LOT = 20_000
CHUNK_BYTES = 4 << 20
SENT_BYTES = 16 << 20
ENTRIES = 1 << 19
BUCKETS_PER_PARTITION = 3
_ENTRY = {"word": "<u4", "bits": "<u8", "rest": "<u4", "n": "<u4", "place": "<u4", "half": "<u8", "second": "<u8", "fourth": "<u8"}
_HASHES = ("bits", "rest")
_SET = {"room": "<i8", "doc": "<i8", "line": "<i4"}
_NULL = np.iinfo(np.int64).min  # stands for a null id, which comes first


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").cast("binary").alias("text"))


def _chunks(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first, texts) of stretches of about CHUNK_BYTES."""
    first, texts, size = 0, [], 0
    for k, t in enumerate(column):
        texts.append(t.as_py() or b"")
        size += len(texts[-1])
        if size >= CHUNK_BYTES:
            yield first, texts
            first, texts, size = k + 1, [], 0
    if texts:
        yield first, texts


@dataclass
class Lines:
    """The lines of some texts that have words, as sets of tokens (words' hashes cut to TOKEN_BITS)."""

    counts: np.ndarray  # all lines of each text
    line: np.ndarray  # numbers of the lines that have words
    token: np.ndarray  # distinct tokens, line after line, in order
    edge: np.ndarray  # where each line begins in ``token``
    bits: np.ndarray  # one bit a token of the line, added without carry
    rest: np.ndarray  # with ``bits``, 96 bits that name the set

    @property
    def size(self) -> np.ndarray:
        return np.diff(np.append(self.edge, len(self.token)))

    @property
    def a(self) -> np.ndarray:
        return name(self.bits, self.rest)

    @property
    def b(self) -> np.ndarray:
        """64 bits more of the set's name."""
        return mix(hashing.sums(mix(self.token ^ np.uint64(0xA0761D6478BD642F)), self.edge)).view(np.int64)


def name(bits: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return mix(bits + rest.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)).view(np.int64)


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines of each text; hash and line of every word."""
    whole = b"\n".join(texts)
    counts = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
    word, start = hashing.words(whole)
    breaks = np.flatnonzero(np.frombuffer(whole, np.uint8) == 10)
    upto = np.append(np.searchsorted(start, breaks), len(start))
    return counts, word, np.repeat(np.arange(len(upto)), np.diff(upto, prepend=0))


def _distinct(word: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, word), each once, in order."""
    order = np.lexsort((word, line))
    word, line = word[order], line[order]
    new = np.ones(len(word), bool)
    new[1:] = (word[1:] != word[:-1]) | (line[1:] != line[:-1])
    return line[new], word[new]


def _lines(texts: list[bytes]) -> Lines:
    counts, word, line = _words(texts)
    token = word >> np.uint64(LINE_BITS)
    if counts.sum() < 1 << LINE_BITS:  # line and token fit one number, which sorts fast
        key = np.sort((line.astype(np.uint64) << np.uint64(TOKEN_BITS)) | token)
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        key = key[new]
        line, token = (key >> np.uint64(TOKEN_BITS)).astype(np.int64), key & np.uint64((1 << TOKEN_BITS) - 1)
    else:
        line, token = _distinct(token, line)
    return _named(counts, line, token)


def _named(counts: np.ndarray, line: np.ndarray, token: np.ndarray) -> Lines:
    """Lines from (line, token) in order, each once."""
    edge = np.flatnonzero(np.diff(line, prepend=-1))
    bits = np.bitwise_xor.reduceat(np.uint64(1) << (token >> np.uint64(TOKEN_BITS - 6)), edge) if len(edge) else np.empty(0, np.uint64)
    # A sum of mixed tokens names a set whatever its order.
    rest = (mix(hashing.sums(mix(token), edge)) >> np.uint64(32)).astype(np.uint32)
    return Lines(counts, line[edge], token, edge, bits, rest)


def _by_rank(found: Lines, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank, word) of the tokens of every line, rarest first; a word is the upper 32 bits of its token."""
    low = token_rank(found.token, rank).astype(np.uint64) << np.uint64(32) | found.token >> np.uint64(RANK_BITS)
    line = np.repeat(np.arange(len(found.edge)), found.size)
    if len(found.edge) < 1 << LINE_BITS:
        low = np.sort((line.astype(np.uint64) << np.uint64(TOKEN_BITS)) | low)
    else:
        low = low[np.lexsort((low, line))]
    return (low >> np.uint64(32)) & np.uint64((1 << RANK_BITS) - 1), low.astype(np.uint32)


def token_rank(token: np.ndarray, rank: np.ndarray) -> np.ndarray:
    return rank[(token & np.uint64(BINS - 1)).astype(np.int64)]


def occurrences(texts: DataFrame) -> DataFrame:
    """(doc, a, b) of every document, the class of each line (0 without words), and
    after them (segment, counts): in how many lines of the task the tokens of each bin are.

    A task's counts stop at 255, which no rare word reaches.
    """
    part = BINS // SEGMENTS
    schema = pa.schema(
        [("doc", pa.int64()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64())), ("segment", pa.int32()), ("counts", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, n = np.zeros(BINS, np.uint32), [], 0

        def count() -> None:
            nonlocal total, n
            if waiting:
                total += np.bincount(np.concatenate(waiting), minlength=BINS).astype(np.uint32)
            waiting.clear()
            n = 0

        for batch in batches:
            for first, chunk in _chunks(batch.column(1)):
                found = _lines(chunk)
                offsets = pa.array(np.concatenate([[0], np.cumsum(found.counts)]), pa.int32())
                names = []
                for value in (found.a, found.b):
                    every = np.zeros(int(found.counts.sum()), np.int64)
                    every[found.line] = value
                    names.append(pa.ListArray.from_arrays(offsets, pa.array(every, pa.int64())))
                docs = batch.column(0)[first : first + len(chunk)]
                yield pa.RecordBatch.from_arrays([docs, *names, pa.nulls(len(docs), pa.int32()), pa.nulls(len(docs), pa.binary())], schema=schema)
                waiting.append((found.token & np.uint64(BINS - 1)).astype(np.int32))
                n += len(found.token)
                if n >= BINS:
                    count()
        count()
        press = zstandard.ZstdCompressor(level=1)
        small = np.minimum(total, 255).astype(np.uint8).reshape(SEGMENTS, part)
        used = np.flatnonzero(small.any(axis=1))
        none = pa.nulls(len(used), pa.list_(pa.int64()))
        packed = pa.array([press.compress(small[k].tobytes()) for k in used], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.nulls(len(used), pa.int64()), none, none, pa.array(used, pa.int32()), packed], schema=schema)

    return texts.mapInArrow(run, "doc bigint, a array<bigint>, b array<bigint>, segment int, counts binary")


def ranks(counted: DataFrame) -> np.ndarray:
    """A rank for each bin from (segment, counts): 0 for a bin of one line at most, then by the logarithm of its lines."""
    part = BINS // SEGMENTS

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(part, np.int64)
        for batch in batches:
            for packed in batch.column("counts"):
                total += np.frombuffer(zstandard.ZstdDecompressor().decompress(packed.as_py()), np.uint8)
        steps = (1 << RANK_BITS) / 40
        rank = np.minimum(np.log2(np.maximum(total, 1)) * steps, (1 << RANK_BITS) - 1).astype("<u2")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([rank.tobytes()], pa.binary())], names=["segment", "ranks"])

    out = np.zeros(BINS, np.uint16)
    for r in counted.groupBy("segment").applyInArrow(_by_batches(add), "segment int, ranks binary").collect():  # BINS numbers
        out[r["segment"] * part : (r["segment"] + 1) * part] = np.frombuffer(r["ranks"], "<u2")
    return out


def _by_batches(add):
    """A group's batches one after another."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from add(key, batches)

    return run


def least_size(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The fewest words that a partner of a line of ``n`` words can have."""
    return -(-n * percent // 100)


def finer_bits(found: Lines, which: np.ndarray) -> dict[str, np.ndarray]:
    """The bits of the lines ``which`` dealt into quarters by two more bits of each token: ``half`` is the third
    quarter with the fourth, for sets of more than LONG words; ``second`` and ``fourth`` are for more than LONGER."""
    out = {k: np.zeros(len(which), np.uint64) for k in ("half", "second", "fourth")}
    size = found.size
    long = np.flatnonzero(size[which] > LONG)
    if len(long):
        n = size[which[long]]
        edge = np.cumsum(n) - n
        token = Sets(found.token, found.edge, size).rows(which[long])[1]
        bit, quarter = np.uint64(1) << (token >> np.uint64(TOKEN_BITS - 6)), token >> np.uint64(TOKEN_BITS - 8) & np.uint64(3)
        added = lambda which: np.bitwise_xor.reduceat(np.where(which, bit, np.uint64(0)), edge)
        out["half"][long] = added(quarter > 1)
        longer = n > LONGER
        if longer.any():
            out["second"][long[longer]] = added(quarter == 1)[longer]
            out["fourth"][long[longer]] = added(quarter == 3)[longer]
    return out


def _differ(e: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many of their 256 bits (128 where ``x`` has no more than LONGER words) the entries differ; ``y`` are not shorter."""
    longer = e["n"][x] > LONGER
    bits, half = e["bits"][x] ^ e["bits"][y], e["half"][x] ^ e["half"][y]
    second, fourth = (np.where(longer, e[k][x] ^ e[k][y], np.uint64(0)) for k in ("second", "fourth"))
    quarters = (bits ^ half ^ second, second, half ^ fourth, fourth)
    return sum(np.bitwise_count(q).astype(np.int32) for q in quarters)


def _index(texts: DataFrame, rank: np.ndarray, percent: int, buckets: int) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(rank)

    def entries(chunk: list[bytes]) -> dict[str, np.ndarray]:
        found = _lines(chunk)
        n = found.size
        # One line of each class; none where no other length fits and equal sets are the only partners.
        _, one = np.unique(found.a, return_index=True)
        alone = (least_size(n, percent) == n) & (least_size(n + 1, percent) > n)
        one = one[~alone[one]]
        prefix = (n - least_size(n, percent) + 1)[one]
        at = np.repeat(np.arange(len(one)), prefix)
        place = np.arange(len(at)) - np.repeat(np.cumsum(prefix) - prefix, prefix)
        order, word = _by_rank(found, shared.value)
        spot = found.edge[one][at] + place
        met = order[spot] > 0  # a word of one line meets no other
        at, place, word, line = at[met], place[met], word[spot[met]], one[at[met]]
        finer = {k: v[at] for k, v in finer_bits(found, one).items()}
        return {"word": word, "bits": found.bits[line], "rest": found.rest[line], "n": n[line].astype(np.uint32), "place": place.astype(np.uint32), **finer}

    def pack(parts: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        e = {k: np.concatenate([p[k] for p in parts]) for k in _ENTRY}
        parts.clear()
        _, one = np.unique(mix(e["word"].astype(np.uint64)) ^ name(e["bits"], e["rest"]).view(np.uint64), return_index=True)
        # A bucket is a range of words; in order of words most of their bytes repeat, and the bits that short sets lack lie together.
        word, n = e["word"][one].astype(np.uint64), e["n"][one]
        bucket = word * np.uint64(buckets) >> np.uint64(32)
        level = (n > LONG).astype(np.uint64) + (n > LONGER)
        order = np.argsort(bucket << np.uint64(34) | level << np.uint64(32) | word)
        e = {k: v[one[order]] for k, v in e.items()}
        yield from exchange.pack(bucket[order].astype(np.int64), e, _HASHES, np.zeros(1, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            for _, chunk in _chunks(batch.column(1)):
                parts.append(entries(chunk))
                n += len(parts[-1]["word"])
                if n >= ENTRIES:
                    yield from pack(parts)
                    parts, n = [], 0
        if n:
            yield from pack(parts)

    return texts.mapInArrow(run, exchange.SCHEMA)


def _most(nx: np.ndarray, ny: np.ndarray, percent: int) -> np.ndarray:
    """How many words two linked sets may have that are not in both."""
    return (100 - percent) * (nx + ny) // (100 + percent)


def _compare(n: np.ndarray, bits: np.ndarray, percent: int, place: np.ndarray | None = None):
    """A test of entries ``x`` against ``y``, which are not shorter: whether lengths, bits and
    places (if known) leave room for the threshold."""

    def run(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        nx, ny = n[x], n[y]
        most = _most(nx, ny, percent)
        fit = (100 * nx >= percent * ny) & (np.bitwise_count(bits[x] ^ bits[y]) <= most)
        if place is not None:
            fit &= nx + ny - 2 * np.minimum(nx - place[x], ny - place[y]) <= most
        return fit

    return run


def _short(size: np.ndarray, run: np.ndarray, n: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of entries within the short runs at once: every entry with the one ``step`` places on, as long as lengths fit."""
    near = np.flatnonzero(np.repeat((size <= SHORT) & (size > 1), size))
    for step in range(1, SHORT):
        near = near[near + step < len(run)]
        near = near[(run[near] == run[near + step]) & (100 * n[near] >= percent * n[near + step])]
        if not len(near):
            return
        yield near, near + step


def _blocks(lo: int, hi: int, n: np.ndarray, percent: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of a run's entries, in order of length, that may hold partners."""
    for s in range(lo, hi, block):
        x = np.arange(s, min(s + block, hi))
        top = int(np.searchsorted(n[lo:hi], 100 * n[x[-1]] // percent, side="right")) + lo
        for r in range(s, top, block):
            yield x, np.arange(r, min(r + block, top))


def _runs(word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First, end and size of each run of one word; the run of each entry."""
    starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.empty(0, np.int64)
    size = np.diff(np.append(starts, len(word)))
    return starts, starts + size, size, np.repeat(np.arange(len(starts)), size)


def _unite(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Joins the groups of each pair; ``root`` names the group of every entry by its first one."""
    while len(x):
        a, b = root[x], root[y]
        apart = a != b
        if not apart.any():
            return
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        parent = np.arange(len(root))
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        root[:] = parent[root]


def _marks(percent: int):
    """The entries of a bucket that have a candidate: one row an entry, however many candidates there are.

    ``partners`` is a sum that names the candidates, ``room`` the smallest class
    that the entry is connected to by candidates of this word.
    """

    def run(table: pa.Table) -> pa.Table:
        got = [exchange.unpack(p.as_py(), _ENTRY, _HASHES)[0] for p in table.column("payload")]
        e = {k: np.concatenate([g[k] for g in got]) for k in _ENTRY}
        order = np.lexsort((e["rest"], e["bits"], e["n"], e["word"]))
        e = {k: v[order] for k, v in e.items()}
        new = np.ones(len(order), bool)
        new[1:] = (e["word"][1:] != e["word"][:-1]) | (e["rest"][1:] != e["rest"][:-1]) | (e["bits"][1:] != e["bits"][:-1])
        e = {k: v[new] for k, v in e.items()}
        word, bits, n, place = e["word"], e["bits"], e["n"].astype(np.int32), e["place"].astype(np.int32)
        starts, ends, size, of = _runs(word)
        compare, own = _compare(n, bits, percent, place), name(bits, e["rest"])
        mixed, met, partners = mix(own.view(np.uint64)), np.zeros(len(word), bool), np.zeros(len(word), np.uint64)
        root = np.arange(len(word))

        def mark(x: np.ndarray, y: np.ndarray) -> None:
            fit = n[x] <= LONG
            long = np.flatnonzero(~fit)
            fit[long] = _differ(e, x[long], y[long]) <= _most(n[x[long]], n[y[long]], percent)
            x, y = x[fit], y[fit]
            met[x] = met[y] = True
            np.add.at(partners, x, mixed[y])
            np.add.at(partners, y, mixed[x])
            _unite(root, x, y)

        for x, y in _short(size, of, n, percent):
            fit = compare(x, y)
            mark(x[fit], y[fit])
        for lo, hi in zip(starts[size > SHORT], ends[size > SHORT], strict=True):
            for x, y in _blocks(lo, hi, n, percent, SLICE):
                i, j = np.nonzero(compare(x[:, None], y[None, :]) & (x[:, None] < y[None, :]))
                mark(x[i], y[j])
        room = np.full(len(word), np.iinfo(np.int64).max)
        np.minimum.at(room, root[met], own[met])
        return pa.table({"a": own[met], "word": word[met].astype(np.int64), "partners": partners[met].view(np.int64), "room": room[root[met]]})

    return run


def _wanted_lines(texts: DataFrame, marked: DataFrame) -> DataFrame:
    """(rooms, a, b, doc, line, text) of lines whose class is in ``marked`` (a, rooms).

    A Bloom filter of bounded size tells most other lines apart before they travel,
    packed by buckets of classes; what it lets through in error finds no rooms.
    Of equal lines only the first of some megabytes travels.
    """
    blocks, buckets = url_filter.n_blocks(marked.count()), shuffle_partitions(texts.sparkSession)
    shared = texts.sparkSession.sparkContext.broadcast(url_filter.build(marked, "a", blocks))

    def pack(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        a, b, doc, line = (np.concatenate([p[k] for p in parts]) for k in range(4))
        lines = [t for p in parts for t in p[4]]
        one = _firsts(a, b, doc, line)
        columns = {"a": a[one], "b": b[one], "doc": doc[one], "line": line[one].astype(np.int32)}
        yield from exchange.pack(columns["a"] % buckets, columns, ("a", "b"), np.zeros(1, np.int64), [lines[k] for k in one.tolist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for first, chunk in _chunks(batch.column(1)):
                found = _lines(chunk)
                if not len(found.line):
                    continue
                docs = batch.column(0)[first : first + len(chunk)].fill_null(_NULL).to_numpy()
                doc = np.repeat(docs, found.counts)[found.line]
                line = found.line - np.repeat(np.cumsum(found.counts) - found.counts, found.counts)[found.line]
                a, b = found.a, found.b
                one = np.flatnonzero(url_filter.may_contain(a, shared.value))
                one = one[_firsts(a[one], b[one], doc[one], line[one])]
                lines = b"\n".join(chunk).split(b"\n")
                parts.append((a[one], b[one], doc[one], line[one], [lines[k] for k in found.line[one].tolist()]))
                size += sum(map(len, parts[-1][4]))
                if size >= SENT_BYTES:
                    yield from pack(parts)
                    parts, size = [], 0
        if size:
            yield from pack(parts)

    def meet(table: pa.Table, classes: pa.Table) -> pa.Table:
        kinds = {"a": "<i8", "b": "<i8", "doc": "<i8", "line": "<i4"}
        got = [exchange.unpack(p.as_py(), kinds, ("a", "b"), True) for p in table.column("payload")]
        a, b, doc, line = (np.concatenate([g[0][k] for g in got] or [np.empty(0, kind)]) for k, kind in kinds.items())
        lines = [t for g in got for t in g[2]]
        known = classes.column("a").to_numpy()
        order = np.argsort(known)
        at = np.minimum(np.searchsorted(known[order], a), max(len(known) - 1, 0))
        one = np.flatnonzero(known[order][at] == a) if len(known) else np.empty(0, np.int64)
        rooms = classes.column("rooms").take(pa.array(order[at[one]] if len(one) else np.empty(0, np.int64)))
        return pa.table(
            {
                "rooms": rooms, "a": a[one], "b": b[one], "doc": doc[one], "line": line[one],
                "text": pa.array([lines[k] for k in one.tolist()], pa.binary()),
            }
        )

    by = marked.select(F.pmod("a", F.lit(buckets)).cast("int").alias("bucket"), "a", "rooms").groupBy("bucket")
    packed = texts.mapInArrow(run, exchange.SCHEMA).groupBy("bucket")
    return packed.cogroup(by).applyInArrow(meet, "rooms array<bigint>, a bigint, b bigint, doc bigint, line int, text binary")


def _firsts(a: np.ndarray, b: np.ndarray, doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """The earliest place of each class."""
    order = np.lexsort((line, doc, b, a))
    new = np.ones(len(order), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    return order[new]


def _sent(wanted: DataFrame, buckets: int) -> DataFrame:
    """Lines with their places, packed, to the bucket of each of their rooms; from (rooms, a, b, doc, line, text).

    Before each text stand the smaller ones of its rooms, sixteen digits each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one = np.sort(_firsts(*(batch.column(k).to_numpy() for k in (1, 2, 3, 4))))
            batch = batch.take(pa.array(one))
            texts, lists = batch.column(5).to_pylist(), batch.column(0).to_pylist()
            docs, rows = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            room, at, sent, size = [], [], [], 0
            for k, (text, rooms) in enumerate(zip(texts, lists, strict=True)):
                before = b""
                for r in sorted(rooms):
                    room.append(r)
                    at.append(k)
                    sent.append(before + b" " + text)
                    before += b"%016x" % (r & MASK64)
                    size += len(sent[-1])
                if size >= SENT_BYTES or k + 1 == len(texts):
                    columns = {"room": np.array(room, np.int64), "doc": docs[at], "line": rows[at]}
                    yield from exchange.pack(_bucket(columns["room"], buckets), columns, ("room",), np.zeros(1, np.int64), sent)
                    room, at, sent, size = [], [], [], 0

    return wanted.select("rooms", "a", "b", "doc", "line", "text").mapInArrow(run, exchange.SCHEMA)


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(key.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


@dataclass
class Sets:
    """Sets of numbers, one after another."""

    value: np.ndarray
    edge: np.ndarray
    size: np.ndarray

    def rows(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, number) of the sets ``t``."""
        n = self.size[t]
        row = np.repeat(np.arange(len(t)), n)
        return row, self.value[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + self.edge[t][row]]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers the sets of each pair share."""
        (r, x), (s, y) = self.rows(i), self.rows(j)
        top = int(self.value.max(initial=0)) + 1
        key = np.sort(np.concatenate([r * top + x, s * top + y]))
        return np.bincount(key[1:][key[1:] == key[:-1]] // top, minlength=len(i))

    def table(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many numbers each set of ``x`` shares with each of ``y``: a product of incidence matrices."""
        p, q = self.rows(x), self.rows(y)
        shared = np.intersect1d(p[1], q[1])
        if not len(shared):
            return np.zeros((len(x), len(y)), np.float32)
        tables = []
        for (row, value), n in ((p, len(x)), (q, len(y))):
            at = np.minimum(np.searchsorted(shared, value), len(shared) - 1)
            ok = shared[at] == value
            table = np.zeros((n, len(shared)), np.float32)
            table[row[ok], at[ok]] = 1
            tables.append(table)
        return tables[0] @ tables[1].T


def _counts(percent: int):
    """The links of a bucket's entries: for each entry how many, and the place of the earliest partner.

    Two sets may meet in several rooms; a link counts in the smallest of the rooms
    that both were sent to, and nowhere else.
    """

    def run(table: pa.Table) -> pa.Table:
        got = [exchange.unpack(p.as_py(), _SET, ("room",), True) for p in table.column("payload")]
        e = {k: np.concatenate([g[0][k] for g in got]) for k in _SET}
        number: dict[bytes, int] = {}
        text, before = [], []
        for g in got:
            for t in g[2]:
                head, _, t = t.partition(b" ")
                before.append(head)
                text.append(number.setdefault(t, len(number)))
        text = np.array(text)
        _, word, line = _words(list(number))
        line, word = _distinct(word, line)
        token = word >> np.uint64(LINE_BITS)
        new = np.ones(len(word), bool)
        new[1:] = (token[1:] != token[:-1]) | (line[1:] != line[:-1])
        names = _named(np.ones(len(number), np.int64), line[new], token[new])
        a, b = names.a, names.b
        edge = np.flatnonzero(np.diff(line, prepend=-1))  # every line that came has words
        sets = Sets(np.unique(word, return_inverse=True)[1], edge, np.diff(np.append(edge, len(word))))
        # One entry a room and class, the earliest, in order of length.
        order = np.lexsort((e["line"], e["doc"], b[text], a[text], sets.size[text], e["room"]))
        w, t = e["room"][order], text[order]
        new = np.ones(len(order), bool)
        new[1:] = (w[1:] != w[:-1]) | (a[t][1:] != a[t][:-1]) | (b[t][1:] != b[t][:-1])
        order = order[new]
        w, t, doc, row = e["room"][order], text[order], e["doc"][order], e["line"][order]
        heads = [before[k] for k in order.tolist()]
        size = np.fromiter(map(len, heads), np.int64, len(heads)) // 16
        joined = np.frombuffer(bytes.fromhex(b"".join(heads).decode()), ">u8")
        smaller = Sets(np.unique(joined, return_inverse=True)[1], np.cumsum(size) - size, size)
        n, bits = sets.size[t], names.bits[t]
        starts, ends, many, of = _runs(w)
        early = np.empty(len(w), np.int64)
        by_place = np.lexsort((row, doc))
        early[by_place] = np.arange(len(w))
        links, best = np.zeros(len(w), np.int64), np.full(len(w), len(w), np.int64)
        compare, waiting, held = _compare(n, bits, percent), [], 0

        def check() -> None:
            """Counts the links among the pairs that wait."""
            nonlocal held
            x, y = (np.concatenate([p[k] for p in waiting]) if waiting else np.empty(0, np.int64) for k in (0, 1))
            waiting.clear()
            held = 0
            for lo in range(0, len(x), LOT):
                i, j = x[lo : lo + LOT], y[lo : lo + LOT]
                both = sets.common(t[i], t[j])
                ok = 100 * both >= percent * (n[i] + n[j] - both)
                i, j = i[ok], j[ok]
                met = np.zeros(len(i), bool)
                some = np.flatnonzero((size[i] > 0) & (size[j] > 0))
                met[some] = smaller.common(i[some], j[some]) > 0
                i, j = i[~met], j[~met]
                np.add.at(links, i, 1)
                np.add.at(links, j, 1)
                np.minimum.at(best, i, early[j])
                np.minimum.at(best, j, early[i])

        def wait(x: np.ndarray, y: np.ndarray) -> None:
            nonlocal held
            waiting.append((x, y))
            held += len(x)
            if held >= 10 * LOT:
                check()

        for x, y in _short(many, of, n, percent):
            fit = compare(x, y)
            wait(x[fit], y[fit])
        for lo, hi in zip(starts[many > SHORT], ends[many > SHORT], strict=True):
            for x, y in _blocks(lo, hi, n, percent, BLOCK):
                fit = compare(x[:, None], y[None, :]) & (x[:, None] < y[None, :])
                i, j = np.nonzero(fit)
                if len(i) <= FEW:
                    wait(x[i], y[j])
                    continue
                both = sets.table(t[x], t[y])
                fit &= 100 * both >= percent * (n[x][:, None] + n[y][None, :] - both)
                if size[x].any() and size[y].any():
                    fit &= smaller.table(x, y) == 0
                links[x] += fit.sum(axis=1)
                links[y] += fit.sum(axis=0)
                best[x] = np.minimum(best[x], np.where(fit, early[y][None, :], len(w)).min(axis=1))
                best[y] = np.minimum(best[y], np.where(fit, early[x][:, None], len(w)).min(axis=0))
        check()
        some = np.flatnonzero(links)
        other = by_place[best[some]]
        return pa.table(
            {
                "a": a[t[some]], "b": b[t[some]], "doc": doc[some], "line": row[some].astype(np.int32), "n_links": links[some],
                "other_doc": doc[other], "other_line": row[other].astype(np.int32),
            }
        )

    return run


def _place(doc: str, line: str):
    """A place with its null id."""
    return F.struct(F.when(F.col(doc) != _NULL, F.col(doc)).alias("doc"), F.col(line).alias("line"))


def links(texts: DataFrame, rank: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """(a, b, first, n_links, other) of every class that has links: its own earliest place, and that of its earliest partner.

    Entries that have a candidate are marked.  Of the words at which a class has
    the same candidates the smallest one is enough: whatever the others are that a
    candidate is marked at, the smallest word at which two classes are candidates
    stays with both.  The candidates of a word fall into groups, and a group's room
    is named by its smallest class, so that most words of a class lead to the same
    room.  The lines of marked classes go to the buckets of their rooms and are
    compared there.  What travels is in proportion to the entries; pairs never
    leave the task that compares them.
    """
    buckets = BUCKETS_PER_PARTITION * shuffle_partitions(texts.sparkSession)
    marks = _index(texts, rank, percent, buckets).groupBy("bucket").applyInArrow(_marks(percent), "a bigint, word bigint, partners bigint, room bigint")
    gathered = marks.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("partners", "word", "room"))).alias("m"))
    least = F.filter("m", lambda x, i: (i == 0) | (x["partners"] != F.get("m", i - 1)["partners"]))
    marked = cut(gathered.select("a", F.array_distinct(F.transform(least, lambda x: x["room"])).alias("rooms")))
    sent = _sent(_wanted_lines(texts, marked), buckets)
    schema = "a bigint, b bigint, doc bigint, line int, n_links bigint, other_doc bigint, other_line int"
    found = sent.groupBy("bucket").applyInArrow(_counts(percent), schema)
    return found.groupBy("a", "b").agg(
        F.min(_place("doc", "line")).alias("first"), F.sum("n_links").alias("n_links"), F.min(_place("other_doc", "other_line")).alias("other")
    )


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc, n_lines, n_links, removed, match_docs): per row, the numbers (from 0) of the
    lines that go, and for each the document of the earliest match."""
    texts = _texts(docs, key, text)
    book = cut(occurrences(texts).withColumn("row", F.monotonically_increasing_id()))
    rows = book.filter("segment IS NULL").select("row", "doc", "a", "b")
    each = rows.select("row", "doc", F.posexplode(F.arrays_zip("a", "b")).alias("line", "name")).select(
        "row", "doc", "line", F.col("name")["a"].alias("a"), F.col("name")["b"].alias("b")
    ).filter("a <> 0 OR b <> 0")
    rank = ranks(book.filter("segment IS NOT NULL").select("segment", "counts"))
    copied = each.groupBy("a", "b").agg(F.min(F.struct("doc", "line")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    linked = links(texts, rank, percent).select("a", "b", F.least("first", "other").alias("first"), "n_links")
    # A class of one line without links stays as it is.
    known = cut(copied.select("a", "b", "first", F.lit(0).cast("bigint").alias("n_links")).unionByName(linked))
    known = known.groupBy("a", "b").agg(F.min("first").alias("earliest"), F.sum("n_links").alias("n_links"))
    marked = each.join(known, ["a", "b"])
    place = F.struct("doc", "line")
    per = marked.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(place > F.col("earliest"), F.struct("line", F.col("earliest")["doc"].alias("doc"))))).alias("gone"),
        F.sum("n_links").alias("n_links"),
    )
    empty = F.array().cast("array<struct<line:int,doc:bigint>>")
    gone = F.coalesce(F.col("gone"), empty)
    return rows.join(per, "row", "left").select(
        "doc", F.size("a").cast("long").alias("n_lines"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.transform(gone, lambda g: g["line"]).alias("removed"), F.transform(gone, lambda g: g["doc"]).alias("match_docs"),
    )


def keep_lines(text: str, removed: str):
    """The text without the lines whose numbers (from 0) are in ``removed``."""
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda _, i: ~F.array_contains(removed, i))
    return F.array_join(lines, "\n")
