"""Periodic runs of words: a stretch that repeats itself at least four times, found by probing a grid for every period.

A run of period p and at least 4 p words holds four multiples of p in a row, so for each p only the words at jp and
(j + 1) p are compared, n / p pairs: n log n comparisons over all periods. Three equal pairs in a row survive; survivors
are extended to both sides by comparing arrays chunk by chunk, and grid points within a run already found are skipped.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwell.llm.shared import free_name

#: A run has at least LEAST_WORDS words and LEAST_PERIODS periods. The grid argument needs four periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
CHUNK = 64

RUN = "struct<start: bigint, length: bigint, period: bigint>"
RESULT = f"struct<runs: array<{RUN}>, collapsed: string>"


def find_runs(code: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of word numbers, by start, then period."""
    n = len(code)
    top, found = n // LEAST_PERIODS, _Found(code)
    if n < LEAST_WORDS:
        return []
    small = min(top, isqrt(n))
    for p in range(1, small + 1):
        grid = code[::p]
        same = grid[1:] == grid[:-1]
        found.extend(p, np.flatnonzero(same[:-2] & same[1:-1] & same[2:]) * p)
    low = small + 1
    while low <= top:  # periods below twice the least one of a block don't divide each other
        high = min(top, 2 * low - 1)
        periods, places = [], []
        before: list[np.ndarray] = []  # the two comparisons before this one, a row of all periods each
        last = np.full(high - low + 1, code[0])
        for j in range(1, (n - 1) // low + 1):
            most = min(high, (n - 1) // j)
            row = code[j * low : j * most + 1 : j]
            same = row == last[: len(row)]
            last = row
            if len(before) == 2:
                hit = np.flatnonzero(same & before[0][: len(same)] & before[1][: len(same)])
                periods.append(hit + low)
                places.append((hit + low) * (j - 3))
            before = [*before[-1:], same]
        if periods:
            ps, at = np.concatenate(periods), np.concatenate(places)
            order = np.lexsort((at, ps))
            ps, at = ps[order], at[order]
            cuts = np.flatnonzero(np.diff(ps)) + 1
            for part, of in zip(np.split(at, cuts), np.split(ps, cuts), strict=True):
                if len(of):
                    found.extend(int(of[0]), part)
        low = high + 1
    return sorted(((s, e - s, q) for s, e, q in found.runs), key=lambda r: (r[0], r[2]))


class _Found:
    """Runs found so far, periods ascending, and the extension of grid points to runs."""

    def __init__(self, code: np.ndarray):
        self.code, self.runs, self.table = code, [], np.empty((0, 3), np.int64)

    def extend(self, p: int, at: np.ndarray) -> None:
        """Add the runs of period p that hold the grid points `at` (ascending), three equal pairs in a row each."""
        if not len(at):
            return
        at = self._outside(p, at)
        step = 1
        while step < 2 * p and len(at):  # a run also agrees everywhere between its grid points
            at = at[self.code[at + step] == self.code[at + step + p]]
            step *= 2
        reach, grown = -1, False
        for i in at.tolist():
            if i < reach:
                continue
            reach, start = self._right(i, p), self._left(i, p)
            if reach + p - start >= max(LEAST_WORDS, LEAST_PERIODS * p):
                self.runs.append((start, reach + p, p))
                grown = True
        if grown:
            self.table = np.array(sorted(self.runs), np.int64)

    def _outside(self, p: int, at: np.ndarray) -> np.ndarray:
        """Grid points not within a run whose period divides p: there, period p gives the same stretch once more.

        The places where words p apart agree within such a run are a whole stretch of such places, so no two overlap.
        """
        t = self.table[(p % self.table[:, 2] == 0) & (self.table[:, 1] - self.table[:, 0] > p)]
        if not len(t):
            return at
        i = np.searchsorted(t[:, 0], at, "right") - 1
        return at[(i < 0) | (at >= t[np.maximum(i, 0), 1] - p)]

    def _right(self, i: int, p: int) -> int:
        """First place from i on whose word differs from the one p later (or has none)."""
        code, end, size = self.code, len(self.code) - p, CHUNK
        while i < end:
            stop = min(end, i + size)
            differ = np.flatnonzero(code[i:stop] != code[i + p : stop + p])
            if len(differ):
                return i + int(differ[0])
            i, size = stop, size * 2
        return end

    def _left(self, i: int, p: int) -> int:
        """First place of the stretch through i whose words agree with those p later."""
        code, size = self.code, CHUNK
        while i > 0:
            stop = max(0, i - size)
            differ = np.flatnonzero(code[stop:i] != code[stop + p : i + p])
            if len(differ):
                return stop + int(differ[-1]) + 1
            i, size = stop, size * 2
        return 0


def collapse(text: str) -> tuple[list[tuple[int, int, int]], str]:
    """The runs of a text's words, and its words without each run's repeats, joined by a space."""
    words = text.encode().split()  # bytes split at ASCII white space only
    known: dict[bytes, int] = {}
    code = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    runs = find_runs(code)
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(keep).tolist()]
    return runs, b" ".join(words).decode()


def word_runs(docs: DataFrame, text: str | Column = "text", name: str = "periodic") -> DataFrame:
    """docs with a column `name` (as free_name gives it): struct of `runs`, by start, then period, and `collapsed`.

    Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0. A run is a stretch of smallest period q, at least 6 words and 4 q
    long, that can't be extended; `collapsed` keeps a run's first q words. A null text is an empty one: no run and an
    empty text. Rows are judged one by one, so repeated rows, ties and other columns don't matter; an empty table
    gives an empty one.
    """
    from pyspark.sql.functions import arrow_udf

    @arrow_udf(RESULT)
    def judged(texts: pa.Array) -> pa.Array:
        done = [collapse(x or "") for x in texts.to_pylist()]
        offsets = np.concatenate(([0], np.cumsum([len(runs) for runs, _ in done]))).astype(np.int32)
        flat = np.array([r for runs, _ in done for r in runs], np.int64).reshape(-1, 3)
        struct = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], names=["start", "length", "period"])
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), struct), pa.array([c for _, c in done], pa.string())], names=["runs", "collapsed"])

    column = F.col(f"`{text}`") if isinstance(text, str) else text
    return docs.withColumn(free_name(docs, name), judged(F.coalesce(column, F.lit(""))))
