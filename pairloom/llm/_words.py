"""Vectorised hashing of the words and bytes of whole texts (NumPy on Arrow buffers)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: White space that parts words: space and \t to \r (fixed values).
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
#: Bytes of text hashed at a time; a longer text makes one longer block of its own.
BLOCK = 1 << 18
_tables: dict[int, np.ndarray] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x + U((seed * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE = mix(np.arange(256, dtype=U), 77)


def _powers(base: int, n: int) -> np.ndarray:
    have = _tables.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK) + 1
        x = np.full(size, base, U)
        x[0] = 1
        have = np.multiply.accumulate(x)
        if size <= 4 * BLOCK:
            _tables[base] = have
    return have[:n]


def blocks(column: pa.Array, block: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, its bytes, offsets) of runs of whole texts; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + block, "right")) - 1)
        end = min(end, len(column))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, text indexes and 64-bit hashes of a block's words, in order."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    full = ~SPACE[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = full[:-1]
    starts = np.flatnonzero(full & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = full[1:]
    ends = np.flatnonzero(full & (~after | edge[1:])) + 1
    doc = np.searchsorted(offsets, starts, "right") - 1
    h = np.empty(n + 1, U)
    h[0] = 0
    np.cumsum(BYTE[data] * _powers(_BASE, n), out=h[1:])
    return starts, ends, doc, mix((h[ends] - h[starts]) * _powers(_INVERSE, n)[starts])


def shingles(doc: np.ndarray, hashes: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of every run of ``n`` words; a shorter text with a word gives one of all its words."""
    if not len(doc):
        return doc, hashes
    out_doc, out = doc[: max(0, len(doc) - n + 1)], np.zeros(max(0, len(doc) - n + 1), U)
    for k in range(n):
        out = mix(out * U(0x2545F4914F6CDD1D) + hashes[k : k + len(out)])
    whole = out_doc == doc[n - 1 :] if len(out) else np.zeros(0, bool)
    counts = np.bincount(doc)
    short = np.flatnonzero((counts > 0) & (counts < n))
    firsts = np.searchsorted(doc, short)
    extra = np.zeros(len(short), U)
    for k in range(n - 1):
        has = counts[short] > k
        extra[has] = mix(extra[has] * U(0x2545F4914F6CDD1D) + hashes[firsts[has] + k])
    extra = mix(extra, 3)
    if not len(short):
        return out_doc[whole], out[whole]
    all_doc, all_out = np.concatenate([out_doc[whole], short]), np.concatenate([out[whole], extra])
    order = np.argsort(all_doc, kind="stable")
    return all_doc[order], all_out[order]


def counted(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash) with their counts, sorted by both."""
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(first)
    return doc[at], hashes[at], np.diff(np.append(at, len(doc)))
