"""Hashes of all words of a text at once, without a Python step per word.

Words are found by the edges of white space; each is read eight bytes at a time,
all words together, and mixed with its length, so a word of at most eight bytes
costs one load.  Words of more than ``LONG_WORD`` bytes are hashed one by one.
"""

from __future__ import annotations

import numpy as np
import xxhash

from lattiq.llm.common import mix

PIECE = 1 << 18
LONG_WORD = 256
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LENGTH = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _piece(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of the words of a short text."""
    padded = text + b" " * 8
    space = _SPACE[np.frombuffer(padded, np.uint8)[: len(text) + 1]]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(text) and not space[0]:
        edge = np.concatenate([[0], edge])
    first, size = edge[0::2], edge[1::2] - edge[0::2]
    load = np.ndarray((len(text) + 1,), "<u8", padded, strides=(1,))
    h = mix((load[first] & _MASK[np.minimum(size, 8)]) + size.astype(np.uint64) * _LENGTH)
    more, at = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(more):
        h[more] = mix(h[more] * _LENGTH + (load[first[more] + at] & _MASK[np.minimum(size[more] - at, 8)]))
        at += 8
        more = more[size[more] > at]
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        h[k] = xxhash.xxh3_64_intdigest(text[first[k] : first[k] + size[k]])
    return h, first


def words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of every word, in order."""
    if len(text) <= PIECE:
        return _piece(text)
    data, at, hashes, starts = np.frombuffer(text, np.uint8), 0, [], []
    while at < len(data):
        end = min(len(data), at + PIECE)
        if end < len(data):  # cut after white space; a longer word makes a longer piece
            gap = np.flatnonzero(_SPACE[data[at:end]])
            if len(gap):
                end = at + int(gap[-1]) + 1
            else:
                later = np.flatnonzero(_SPACE[data[end:]])
                end = end + int(later[0]) if len(later) else len(data)
        h, first = _piece(text[at:end])
        hashes.append(h)
        starts.append(first + at)
        at = end
    return np.concatenate(hashes), np.concatenate(starts)


def sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums (modulo 2 ** 64) of the stretches that begin at ``edges``; all are non-empty."""
    return np.add.reduceat(values, edges) if len(edges) else np.empty(0, np.uint64)
