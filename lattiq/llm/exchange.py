"""Packed exchanges: many small fixed-width entries travel as a few binary rows.

A mapper hands over arrays of entries and the bucket of each; the entries of a
bucket become one row ``(bucket, payload)``.  Columns named in ``hashes`` are
stored as they are (hashes don't compress); the others byte by byte, transposed
and compressed, so numbers that rise slowly cost about a byte.  Entries may each
bring a line of text; the lines of a row are compressed together.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

SCHEMA = "bucket int, payload binary"
ARROW = pa.schema([("bucket", pa.int32()), ("payload", pa.binary())])


def pack(
    bucket: np.ndarray, columns: dict[str, np.ndarray], hashes: tuple[str, ...], shared: np.ndarray, lines: list[bytes] | None = None
) -> Iterator[pa.RecordBatch]:
    """Rows of the entries, a row a bucket; ``shared`` (int64) goes into every row.  ``lines`` are without newlines, one an entry."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cols = {k: v[order] for k, v in columns.items()}
    edges = np.flatnonzero(np.diff(b)) + 1
    starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(b)]])
    press = zstandard.ZstdCompressor(level=1)
    common = press.compress(_bytes(np.diff(shared, prepend=np.int64(0))))
    out = []
    for lo, hi in zip(starts, ends, strict=True):
        parts = [common] + [v[lo:hi].tobytes() if k in hashes else press.compress(_bytes(v[lo:hi])) for k, v in cols.items()]
        if lines is not None:
            parts.append(zstandard.ZstdCompressor(level=3).compress(b"\n".join([lines[k] for k in order[lo:hi].tolist()])))
        out.append(struct.pack(f"<{len(parts) + 1}I", hi - lo, *map(len, parts)) + b"".join(parts))
    yield pa.RecordBatch.from_arrays([pa.array(b[starts].astype(np.int32)), pa.array(out, pa.binary())], schema=ARROW)


def unpack(payload: bytes, columns: dict[str, str], hashes: tuple[str, ...], lines: bool = False) -> tuple:
    """The entries of one row by column, and the shared array; with ``lines``, their lines too."""
    head = struct.unpack_from(f"<{len(columns) + 2 + lines}I", payload)
    at = 4 * len(head)
    press = zstandard.ZstdDecompressor()
    parts = []
    for size in head[1:]:
        parts.append(payload[at : at + size])
        at += size
    shared = np.cumsum(_array(press.decompress(parts[0]), "<i8"))
    out = {
        k: np.frombuffer(p, kind) if k in hashes else _array(press.decompress(p), kind)
        for (k, kind), p in zip(columns.items(), parts[1 : len(columns) + 1], strict=True)
    }
    return (out, shared, press.decompress(parts[-1]).split(b"\n")) if lines else (out, shared)


def _bytes(values: np.ndarray) -> bytes:
    values = np.ascontiguousarray(values)
    return values.view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()


def _array(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()
