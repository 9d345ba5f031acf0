"""Token ids in Parquet list columns.

Documents are range-partitioned by id (a hash of the text breaks ties, so an id
that very many rows share is still cut into several files), sorted within their
partition, encoded batch by batch and written by Spark's Parquet writer with

* ids dictionary-encoded where a page's vocabulary is small, delta or plain
  packed beyond (writer version 2); starts and lengths delta-packed;
* row groups of ``ROW_GROUP`` bytes and pages of ``PAGE_ROWS`` rows at most, with
  the column and offset indexes, so a reader that wants a few documents, or only
  the metadata columns, reads little else.

Files hold (part, local_start, doc_id, n_tokens, ids): file ``part`` has the
documents between those of its neighbours, and ``local_start`` counts ids from
the start of the file.  Global starts are one prefix sum over one row a file.

Encoding goes word by word where the vocabulary's normaliser and pre-tokeniser
never look across ASCII white space: the distinct words of some megabytes are cut
into pieces at once, the tokenizers library's steps are run on each new piece (or
unusual word), and their ids are remembered (a bounded number).  A text that holds
the mark of an added token, or any text under another pipeline, is encoded whole.

Defined results: a null or empty text has the end id only; null document ids
come first; repeated rows are all written; malformed UTF-8 is read with
replacement characters; an empty table gives an empty folder that can be read.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattiq.llm.common import shuffle_partitions, small

ROW_GROUP = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2000
END_ID = 2
MEMO = 400_000
SCHEMA = "part int, local_start bigint, doc_id bigint, n_tokens int, ids array<int>"
_encoders: dict[str, "Encoder"] = {}

#: The pipeline whose steps never look across ASCII white space (fixed values of the vocabulary file).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BY_WORD = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    None,
    "BPE",
]
#: The same split for visible ASCII and Latin-1 letters in lower case, and the end of each word.
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff\n]+|\n").findall
ODD = re.compile("[^\n!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]").search
PLAIN = re.compile("[!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]+").fullmatch
SPACE = re.compile(rb"[\x20\x09-\x0D]")
SLICE_BYTES = 4 << 20
LOT = 2048


def _byte_letters() -> dict[int, int]:
    """Byte-level letters: printable Latin-1 stands for itself, the rest for 256 and up in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: 256 + i for i, b in enumerate(rest)}


LETTERS = _byte_letters()


class Pieces(dict):
    """Numbers of pieces (visible ASCII and Latin-1 letters) and of unusual words, which have a mark before them; and the ids of each number."""

    END, UNUSUAL = "\n", "\0"

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.tokenize = tokenizer, tokenizer.model.tokenize
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.ids, self.size = array("I"), array("I")
        for stand_in in (self.END, self.UNUSUAL):
            self[stand_in] = self.add([])

    def add(self, ids: list[int]) -> int:
        self.ids.extend(ids)
        self.size.append(len(ids))
        return len(self.size) - 1

    def __missing__(self, piece: str) -> int:
        if piece[0] == self.UNUSUAL:
            normal = self.tokenizer.normalizer.normalize_str(piece[1:])
            ids = [t.id for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal) for t in self.tokenize(p)]
        else:
            letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(LETTERS)
            ids = [t.id for t in self.tokenize(letters)]
        number = self[piece] = self.add(ids)
        return number


class Encoder:
    """Texts to ids.

    Words are taken apart only for the pipeline in ``BY_WORD``; with any other
    normaliser or pre-tokeniser texts are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = Pieces(self.tokenizer)
        self.marks = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        told = json.loads(self.tokenizer.to_str())
        steps = [told["normalizer"], told["pre_tokenizer"], told["post_processor"], told["model"]["type"]]
        self.by_word = json.dumps(steps, sort_keys=True) == json.dumps(BY_WORD, sort_keys=True)

    def whole(self, text: bytes) -> bytes:
        """Little-endian 32-bit integers."""
        found = self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.array(found, "<u4").tobytes()

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words (without white space), one after another, and how many each has."""
        if not len(words):
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        if len(self.pieces) >= MEMO or len(self.pieces.ids) >= 8 * MEMO:
            self.pieces.reset()
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")
        text = joined[0].as_buffer().to_pybytes().decode("utf-8", "replace")
        unusual = []
        if ODD(text):  # visible ASCII is normal but for case, and Latin-1 letters have no other composition; the rest goes word by word
            each = text.split("\n")
            at = [k for k, w in enumerate(each) if w and not PLAIN(w)]
            unusual = [self.pieces[Pieces.UNUSUAL + each[k]] for k in at]
            for k in at:
                each[k] = Pieces.UNUSUAL
            text = "\n".join(each)
        found = PIECES(text.lower())
        number = np.fromiter(map(self.pieces.__getitem__, found), np.int64, len(found))
        number[number == self.pieces[Pieces.UNUSUAL]] = unusual
        of = np.cumsum(number == self.pieces[Pieces.END])
        size = np.array(self.pieces.size, np.int64)
        start = np.cumsum(size) - size
        n = size[number]
        ids = np.array(self.pieces.ids, "<u4")[np.repeat(start[number] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        return ids, np.bincount(of, n, len(words)).astype(np.int64)

    def texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, one after another, and how many each has.

        All words are split and numbered at once; only the distinct ones are looked up.
        """
        whole = [not self.by_word or any(m in t for m in self.marks) for t in texts]
        parts = [b"" if w else t for t, w in zip(texts, whole, strict=True)]
        found = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.string(), len(parts), pa.array(parts, pa.binary()).buffers()))
        words = found.values.dictionary_encode()
        flat, size = self.words(words.dictionary)
        ends = found.offsets.to_numpy()[1:].astype(np.int64)
        index = words.indices.to_numpy().astype(np.int64)
        if any(whole):  # such a text is one more word
            at = np.flatnonzero(whole)
            index = np.insert(index, ends[at], len(size) + np.arange(len(at)))
            packed = [self.whole(texts[k]) for k in at.tolist()]
            flat = np.concatenate([flat, np.frombuffer(b"".join(packed), "<u4")])
            size = np.concatenate([size, np.fromiter(map(len, packed), np.int64, len(packed)) // 4])
            ends += np.cumsum(whole)
        at = np.cumsum(size) - size
        n = size[index]
        upto = np.cumsum(n)
        ids = flat[np.repeat(at[index] - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)]
        return ids, np.diff(np.concatenate([[0], upto])[ends], prepend=0)


def _parts(texts: list[bytes], marks: list[bytes]) -> Iterator[tuple[list[bytes], list[bool]]]:
    """Texts of about SLICE_BYTES together; a longer one in parts, cut at white space.  Flags tell where a text ends."""
    lot: list[bytes] = []
    ends: list[bool] = []
    size = 0
    for t in texts:
        at = 0
        while True:
            cut = SPACE.search(t, at + SLICE_BYTES) if len(t) - at > SLICE_BYTES and not any(m in t for m in marks) else None
            part = t[at : cut.start() if cut else len(t)] if at or cut else t
            if lot and size + len(part) > SLICE_BYTES:
                yield lot, ends
                lot, ends, size = [], [], 0
            lot.append(part)
            ends.append(cut is None)
            size += len(part)
            if cut is None:
                break
            at = cut.start()
    if lot:
        yield lot, ends


def _encoder(path: str) -> Encoder:
    """One encoder a Python worker, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_texts(encoder: Encoder, texts: list[bytes], end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after another, each with the end id after it, and how many each has."""
    found, counts, waiting = [], [], 0
    for parts, ends in _parts(texts, encoder.marks):
        ids, n = encoder.texts(parts)
        # The end id goes after the last part of each text.
        upto = np.cumsum(n)
        done = np.array(ends, bool)
        found.append(np.insert(ids, upto[done], np.uint32(end_id)))
        made = np.diff(upto[done], prepend=0)
        if len(made):
            made[0] += waiting
            waiting = int(upto[-1] - upto[done][-1])
            counts.append(made + 1)
        else:
            waiting += int(upto[-1])
    return np.concatenate(found), np.concatenate(counts)


def encode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """The rows of the files, range-partitioned and in order of ``key``."""
    schema = pa.schema(
        [("part", pa.int32()), ("local_start", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.list_(pa.int32()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo in range(0, len(batch), LOT):
                keys, texts = batch.column(0)[lo : lo + LOT], [x.as_py() or b"" for x in batch.column(1)[lo : lo + LOT]]
                ids, counts = encode_texts(encoder, texts, end_id)
                offsets = np.concatenate([[0], np.cumsum(counts)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(texts), part, np.int32)),
                        pa.array(start + offsets[:-1]),
                        keys,
                        pa.array(counts.astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.view(np.int32))),
                    ],
                    schema=schema,
                )
                start += int(offsets[-1])

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    n = shuffle_partitions(docs.sparkSession)
    ordered = rows.repartitionByRange(n, F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return ordered.mapInArrow(run, SCHEMA)


def write(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> str:
    """Encode ``docs`` into token files at ``path``."""
    (
        encode(docs, tokenizer, key, text, end_id)
        .write.mode("overwrite")
        .option("parquet.block.size", ROW_GROUP)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#local_start", "false")
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("compression", "zstd")
        .option("parquet.compression.codec.zstd.level", "1")
        .parquet(path)
    )
    return path


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, with global starts."""
    files = spark.read.schema(SCHEMA).parquet(path)
    per = files.groupBy("part").agg(F.sum(F.col("n_tokens").cast("long")).alias("n"))
    # One row a file.
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = small(per.select(F.col("part").alias("__part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    return files.join(offsets, F.col("part") == F.col("__part")).select(
        "doc_id", (F.col("offset") + F.col("local_start")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids"
    )


def checksums(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from rows with ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            values = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))
            offsets = ids.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return rows.select("doc_id", "start", "ids").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
