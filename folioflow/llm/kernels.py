"""Vectorised text kernels over Arrow batches: tokens and shingles as arrays of 64-bit hashes.

A word is a maximal run of bytes that are not separators. UTF-8 never uses ASCII bytes inside a
longer sequence, so byte-wise splitting and A-Z folding agree with the same rules on code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_Q = pow(_P, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything ASCII but letters and digits separates.
PUNCT = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = {_P: np.ones(1, U), _Q: np.ones(1, U)}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers[base]
    if len(have) < n:
        size = 1 << (n - 1).bit_length()
        step = np.full(size, base, U)
        step[0] = 1
        have = _powers[base] = np.multiply.accumulate(step)
    return have[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: a bijection for each seed."""
    x = x ^ U((seed * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & (2**64 - 1))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def raw(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string array; null counts as empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = pc.fill_null(text.cast(pa.large_string()), "")
    off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], limit: int = 2 << 20, rows: int = 8192) -> Iterator[pa.RecordBatch]:
    """Batches of at most limit bytes of text (column 'text') and so many rows; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index("text")
        start = 0
        for part in text_slices(batch.column(at), limit, rows):
            yield batch.slice(start, len(part))
            start += len(part)


def text_slices(text: pa.Array, limit: int = 1 << 19, rows: int = 8192) -> Iterator[pa.Array]:
    """Consecutive parts of a string array of at most limit bytes and so many rows; a longer text stands alone."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    off = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(text), 0), dtype=np.int64)])  # lengths only: raw() copies texts with nulls
    start = 0
    while start < len(text):
        end = int(np.searchsorted(off, off[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), start + rows, len(text))
        yield text.slice(start, end - start)
        start = end


def released(results: Iterator) -> Iterator:
    """The results; after them Arrow's pool gives back what it keeps of the batches, which an idle worker would hold on to."""
    yield from results
    pa.default_memory_pool().release_unused()


class Words:
    """Words of the texts of a batch: hash, doc (row number), start and end byte of each word, in order."""

    def __init__(self, text: pa.Array, sep: np.ndarray = SPACE, fold: bool = True) -> None:
        data, off = raw(text)
        self.data, self.off, self.n_docs = data, off, len(off) - 1
        inside = ~sep[data]
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        if len(data):
            edge = off[(off > 0) & (off < len(data))]
            before[edge] = False
            after[edge - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.doc = np.searchsorted(off[1:], self.start, side="right")
        self._sums = np.zeros(len(data) + 1, U)
        np.cumsum(((LOWER[data] if fold else data).astype(U) + U(1)) * powers(_P, len(data)), out=self._sums[1:])
        self.hash = self.hashed(self.start, self.end)
        self.count = np.bincount(self.doc, minlength=self.n_docs)

    def hashed(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the byte ranges [start, end)."""
        return mix((self._sums[end] - self._sums[start]) * powers(_Q, max(1, len(self.data)))[start])

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(doc, hash) of each run of k words; a text of fewer words gives its whole sequence as one."""
        h, doc, n = self.hash, self.doc, len(self.hash)
        if not n:
            return doc, h
        acc = np.full(n, U(k))
        for j in range(k):
            acc[: n - j] = mix(acc[: n - j]) * U(_P) + h[j:]
        full = np.zeros(n, bool)
        if n >= k:
            full[: n - k + 1] = doc[: n - k + 1] == doc[k - 1 :]
        out_doc, out = doc[full], mix(acc[full])
        first = np.cumsum(self.count) - self.count
        short = np.flatnonzero((self.count > 0) & (self.count < k))
        if len(short):
            more = np.zeros(len(short), U)
            for i, d in enumerate(short):
                one = np.full(1, U(self.count[d]))
                for j in range(self.count[d]):
                    one = mix(one) * U(_P) + h[first[d] + j : first[d] + j + 1]
                more[i] = mix(one)[0]
            out_doc, out = np.concatenate([out_doc, short]), np.concatenate([out, more])
        return out_doc, out


def distinct(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (doc, value), sorted."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[keep], value[keep]


def starts(sorted_keys: np.ndarray, n: int) -> np.ndarray:
    """n + 1 offsets of the runs of keys 0..n-1."""
    return np.searchsorted(sorted_keys, np.arange(n + 1))
