"""Vectorised words and shingles: 64-bit hashes of words and of runs of words, from Arrow text columns.

A word's hash is a polynomial of its bytes modulo 2^64, from differences of running sums; a shingle's hash is a
polynomial of its words' hashes. Both are mixed at the end. Bytes are worked on in blocks cut at white space, so memory
stays bounded for texts of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes worked on at once; a longer word makes its block longer.
BLOCK = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i for i up to n at least."""
    if "p" not in _powers or len(_powers["p"]) <= n:
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        for name, base in (("p", _P), ("i", inverse)):
            steps = np.full(max(n, BLOCK) + 2, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["p"], _powers["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise: every bit of the input changes about half the bits of the output."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is as long as an empty text."""
    column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, count=len(column) + 1, offset=8 * column.offset) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8) if len(column) else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, prefixes: tuple[int | None, ...] = (None,)) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Runs of bytes of one class (class 0 separates): (hashes for each prefix length, classes of the runs, runs of each text).

    A prefix of None hashes whole runs, n their first n bytes. A-Z count as a-z.
    """
    if len(data) == 0:
        return [np.zeros(0, np.uint64) for _ in prefixes], np.zeros(0, np.uint8), np.zeros(len(offsets) - 1, np.int64)
    kind = classes[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    edge[offsets] = True
    at = np.flatnonzero(edge)
    solid = kind[at[:-1]] != 0
    starts, ends = at[:-1][solid], at[1:][solid]
    counts = np.diff(np.searchsorted(starts, offsets))
    hashes = [np.empty(len(starts), np.uint64) for _ in prefixes]
    at = 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(starts, starts[at] + BLOCK)))
        lo, hi = starts[at], ends[upto - 1]
        power, inverse = _power_tables(int(hi - lo))
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((LOWER[data[lo:hi]].astype(np.uint64) + np.uint64(1)) * power[: hi - lo], out=sums[1:])
        s, e = starts[at:upto] - lo, ends[at:upto] - lo
        for h, n in zip(hashes, prefixes, strict=True):
            h[at:upto] = mix((sums[e if n is None else np.minimum(e, s + n)] - sums[s]) * inverse[s])
        at = upto
    return hashes, kind[starts], counts


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): hashes of all lower-cased (A-Z) words in order, and the number of words of each text."""
    (hashes,), _, counts = runs(data, offsets, (~SPACE).astype(np.uint8))
    return hashes, counts


def shingles(word_hashes: np.ndarray, counts: np.ndarray, size: int = 5) -> Iterator[np.ndarray]:
    """For each text the hashes of its runs of `size` words, in order; the whole sequence as one if it is shorter."""
    n = len(word_hashes)
    rolled = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size if len(rolled) else 0):
        rolled = rolled * _Q + word_hashes[k : n - size + 1 + k]
    rolled = mix(rolled)
    at = 0
    for c in counts:
        if c >= size:
            yield rolled[at : at + c - size + 1]
        elif c:
            yield short_runs(word_hashes[at : at + c], int(c))
        else:
            yield rolled[:0]
        at += c


def short_runs(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of a text's runs of n words, each as `shingles` gives for a text of just these n words."""
    h = np.full(max(0, len(word_hashes) - n + 1), n, np.uint64)
    for k in range(n):
        h = h * _Q + word_hashes[k : k + len(h)]
    return mix(h)
