"""Words of a batch of texts as flat numpy arrays, and 64-bit hashes of words and word runs.

A word is a run of bytes outside `[\\x20\\x09-\\x0D]`, or outside another set of ASCII
separators; multi-byte characters are never cut. Texts are handled in blocks of a MB, so
memory follows the longest single text and not the size of a batch.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True

# Everything in ASCII but digits and small letters.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[0x00:0x30] = NOT_ALNUM[0x3A:0x61] = NOT_ALNUM[0x7B:0x80] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BLOCK_BYTES = 1 << 20
_LONG_WORD = 64
_TAIL = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_bytes(word: bytes) -> int:
    """The hash that `Words.hashes` gives this word."""
    return int(_hash_spans(np.frombuffer(word + b"\0" * 8, np.uint8),
                           np.array([0]), np.array([len(word)]))[0])


def _hash_spans(padded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lanes = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    size = ends - starts
    out = size.astype(np.uint64) * _ODD
    todo = np.arange(len(starts))
    for lane in range(_LONG_WORD // 8):
        todo = todo[size[todo] > 8 * lane]
        if not len(todo):
            break
        left = np.minimum(size[todo] - 8 * lane, 8)
        out[todo] = mix(out[todo] ^ (lanes[starts[todo] + 8 * lane] & _TAIL[left])) + _ODD
    for i in np.flatnonzero(size > _LONG_WORD):
        digest = hashlib.blake2b(padded[starts[i]:ends[i]].tobytes(), digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


class Words:
    """Words of some texts, in order: `starts` and `ends` in `data`, `first[t]:first[t + 1]`
    being the words of text t, and `text` the number of each word's text."""

    def __init__(self, texts: pa.Array, separators: np.ndarray = SPACES, lower: bool = False):
        self.offsets, data = text_bytes(texts)
        self.data = LOWER[data] if lower else data
        inside = ~separators[self.data]
        begins, closes = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        edges = self.offsets[:-1][self.offsets[:-1] < self.offsets[1:]]
        begins[edges] = inside[edges]
        lasts = self.offsets[1:][self.offsets[:-1] < self.offsets[1:]] - 1
        closes[lasts] = inside[lasts]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(len(texts)), self.counts)
        self._hashes: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = self.span_hashes(self.ends)
        return self._hashes

    def span_hashes(self, ends: np.ndarray) -> np.ndarray:
        """Hashes of what each word holds up to `ends`."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        return _hash_spans(padded, self.starts, ends)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]].tobytes()

    def position(self) -> np.ndarray:
        """The place of each word in its text, from 0."""
        return np.arange(len(self)) - np.repeat(self.first[:-1], self.counts)

    def runs(self, length: int) -> np.ndarray:
        """True where a run of so many words of one text starts."""
        fits = np.zeros(len(self), bool)
        if length <= len(self):
            fits[:len(self) - length + 1] = self.text[:len(self) - length + 1] == self.text[length - 1:]
        return fits

    def run_hashes(self, length: int) -> np.ndarray:
        """Hash of the run of so many words from each word on; see `runs` for which are whole."""
        return run_hashes(self.hashes, length)


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hash of `length` neighbours from each place on; the last ones, which are not
    whole, are 0."""
    n = len(hashes)
    out = np.zeros(n, np.uint64)
    if n < length:
        return out
    power = np.full(n + 1, _STEP, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    back = np.full(n, _BACK, np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(hashes + _ODD) * power[:n], out=total[1:])
    whole = n - length + 1
    out[:whole] = mix((total[length:] - total[:whole]) * back[:whole])
    return out


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0, and the bytes, of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if not len(texts) or at[-1] == at[0]:
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.uint8)
    return at - at[0], np.frombuffer(data, np.uint8)[at[0]:at[-1]]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text",
           block_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about a MB of text, or one longer text."""
    try:
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(column)), 0)
            group = np.cumsum(np.asarray(size, np.int64)) // block_bytes
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
            for low, high in zip(cuts, cuts[1:]):
                if high > low:
                    yield batch.slice(low, high - low)
    finally:
        give_back()


def give_back() -> None:
    """Freed memory goes back to the system: Python workers outlive their tasks, and what each keeps
    for later adds up over the stages of a job."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
