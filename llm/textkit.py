"""Vectorised word and n-gram hashing over Arrow string columns.

Words are maximal runs of bytes other than space and \\t..\\r; those separators
are ASCII, so scanning UTF-8 bytes splits exactly as the code-point pattern
``[^\\x20\\x09-\\x0D]+`` does.  A hash is a polynomial over a random byte table
modulo 2**64, read off prefix sums, then mixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WORD = r"[^\x20\x09-\x0D]+"
U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_WORD_ODD = 0xC2B2AE3D27D4EB4F
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Spaces and all other ASCII that is neither letter nor digit, for features that should not see glued punctuation.
_PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=U) * U(_ODD))
#: Longer tables, for a single very long text, are made and dropped.
KEPT_POWERS = 1 << 20
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(odd: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, at least n of each."""
    have = _POWERS.get(odd)
    if have is None or len(have[0]) < n:
        inverse = pow(odd, -1, 1 << 64)
        size = 1 << max(16, (n - 1).bit_length())
        out = []
        for base in (odd, inverse):
            p = np.full(size, base, U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = (out[0], out[1])
        if size <= KEPT_POWERS:
            _POWERS[odd] = have
    return have


class Words:
    """The words of a slice of texts.

    data: bytes (lower-cased if asked; punctuation: ASCII punctuation separates too); start, end: byte bounds of each word;
    first: index of each text's first word, with the total at the end;
    doc: each word's text; hash: each word's 64-bit hash.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, punctuation: bool = False):
        self.data = _LOWER[data] if lower else data
        n = len(self.data)
        solid = ~(_PUNCTUATION if punctuation else _SPACE)[self.data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.zeros(n, bool)
        before[1:] = solid[:-1]
        self.start = np.flatnonzero(solid & (~before | edge[:n]))
        after = np.zeros(n, bool)
        after[:-1] = solid[1:]
        self.end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self._hash: np.ndarray | None = None
        self._made: tuple[np.ndarray, np.ndarray] | None = None

    def _sums(self) -> tuple[np.ndarray, np.ndarray]:
        if self._made is None:
            n = len(self.data)
            power, inverse = _powers(_ODD, n + 1)
            sums = np.zeros(n + 1, U)
            np.cumsum(_TABLE[self.data] * power[:n], out=sums[1:])
            self._made = sums, inverse
        return self._made

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            sums, inverse = self._sums()
            self._hash = mix((sums[self.end] - sums[self.start]) * inverse[self.start])
        return self._hash

    def forget(self) -> None:
        """Hash the words and drop the sums over bytes."""
        _ = self.hash
        self._made = None

    def prefixes(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Words longer than width bytes, and the hash of that many bytes of each."""
        sums, inverse = self._sums()
        at = np.flatnonzero(self.end - self.start > width)
        s = self.start[at]
        return at, mix((sums[s + width] - sums[s]) * inverse[s] + U(width))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First-word indices of all n-word windows inside one text, and their hashes."""
        w = self.hash
        power, inverse = _powers(_WORD_ODD, len(w) + 1)
        sums = np.zeros(len(w) + 1, U)
        np.cumsum(w * power[: len(w)], out=sums[1:])
        at = np.flatnonzero(np.arange(len(w)) + n <= self.first[1:][self.doc])
        return at, mix((sums[at + n] - sums[at]) * inverse[at] + U(n))

    def word(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def column(batch, name: str) -> pa.Array:
    """A string column of a table or batch as one array with 64-bit offsets; null texts become empty."""
    col = batch.column(name)
    if isinstance(col, pa.ChunkedArray):
        col = col.cast(pa.large_string())
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_string())
    return col.cast(pa.large_string()).fill_null("")


def slices(col: pa.Array, most_bytes: int = 1_000_000):
    """(from, to, data, offsets) for runs of texts of about most_bytes; a longer text comes alone, whole."""
    n = len(col)
    if not n:
        return
    buffers = col.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(texts, lower: bool = False) -> Words:
    """Words of a list of strings (None: empty)."""
    col = pa.array([t or "" for t in texts], pa.large_string())
    parts = list(slices(col, 1 << 62))
    if not parts:
        return Words(np.zeros(0, np.uint8), np.zeros(1, np.int64), lower)
    _, _, data, offsets = parts[0]
    return Words(data, offsets, lower)
