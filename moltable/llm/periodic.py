"""Periodic runs of words, by seeds on diagonals that are extended once."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from moltable.llm.columns import WORD, with_text

LEAST_LENGTH = 6  # words of a run
LEAST_PERIODS = 4  # times its period that a run is long
SLICE_CHARS = 1_000_000  # texts are searched together up to this many characters
STRIDE = 64  # words compared in the first step of an extension

_WORD = re.compile(WORD)


def _dense(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each pair, 0, 1, ... by value; how often it occurs)."""
    pairs = first * (int(second.max(initial=0)) + 1) + second
    _, number, counts = np.unique(pairs, return_inverse=True, return_counts=True)
    return number, counts[number]


class _Grams:
    """Numbers of the k-grams at the positions where they are repeated; every other position has a number of its own.

    A longer gram is repeated only where both of its parts are, so each step looks at what the step before
    has left.
    """

    def __init__(self, words: np.ndarray) -> None:
        self.n = len(words)
        self.open = np.arange(self.n)
        self.number = self._placed(*_dense(words, np.zeros_like(words)))

    def _placed(self, number: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.arange(self.n, 2 * self.n)
        repeated = counts > 1
        out[self.open[repeated]] = number[repeated]
        self.open = self.open[repeated]
        return out

    def joined(self, first: np.ndarray, second: np.ndarray, shift: int, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, number) of repeated grams: ``first`` there, followed by ``second`` ``shift`` words later."""
        where = where[where + shift < self.n]
        number, counts = _dense(first[where], second[where + shift])
        return where[counts > 1], number[counts > 1]

    def doubled(self, length: int) -> None:
        """From grams of ``length`` words to grams of twice as many."""
        where, number = self.joined(self.number, self.number, length, self.open)
        out = np.arange(self.n, 2 * self.n)
        out[where] = number
        self.number, self.open = out, where


def _overlap(low: int) -> int:
    """Words over which a run whose period is from ``low`` to ``2 * low - 1`` agrees with itself one period on, at least."""
    return min(max(LEAST_LENGTH - q, (LEAST_PERIODS - 1) * q) for q in range(low, low + min(low, LEAST_LENGTH)))


def _seeds(words: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, lag) of equal k-grams that follow each other, for one class of lags after the other.

    Lags from 2**j to 2**(j + 1) - 1 form a class, and the least overlap of its runs with themselves is its k. Since k is
    at least 1.5 times the period, the same k-gram does not occur between its copies q words apart, or the run had a
    smaller period: only next occurrences are listed, never all pairs.
    """
    grams = _Grams(words)
    earlier = grams.number
    length, low = 1, 1
    while LEAST_PERIODS * low <= longest and len(grams.open):
        k = _overlap(low)
        while 2 * length <= k:
            earlier = grams.number
            grams.doubled(length)
            length *= 2
        where, number = grams.open, grams.number[grams.open]
        rest = k - length
        if rest:  # one of ``length`` words and one that ends with the k-gram
            part, size = (earlier, length // 2) if rest <= length // 2 else (grams.number, length)
            where, number = grams.joined(grams.number, part, k - size, grams.open)
        order = np.lexsort((where, number))
        at, same = where[order], number[order]
        lag = at[1:] - at[:-1]
        found = (same[1:] == same[:-1]) & (lag >= low) & (lag < 2 * low)
        yield at[:-1][found], lag[found]
        low *= 2


def _reach(words: np.ndarray, at: int, lag: int) -> int:
    """How many words from ``at`` on equal those ``lag`` further on; compared in strides that double."""
    start, step = at, STRIDE
    while start + lag < len(words):
        a, b = words[start : start + step], words[start + lag : start + lag + step]
        unequal = np.flatnonzero(a[: len(b)] != b)
        if len(unequal):
            return start + int(unequal[0]) - at
        start, step = start + len(b), 2 * step
    return max(start, at) - at


def find_runs(words: np.ndarray, longest: int | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in a sequence of numbers, by start, then period.

    A run is a stretch of smallest period q, at least ``max(6, 4 * q)`` long, that neither neighbour extends. Seeds of a
    lag are extended to both sides of their diagonal, and a table of the furthest word covered on each lag
    passes over all further seeds of the same stretch. ``longest`` bounds the length of a run.
    """
    covered: dict[int, int] = {}
    backwards = words[::-1]
    runs = []
    for position, lag in _seeds(words, len(words) if longest is None else longest):
        order = np.lexsort((position, lag))
        position, lag = position[order], lag[order]
        follows = np.zeros(len(position), bool)  # the next word on the same diagonal is within the seed before it
        follows[1:] = (lag[1:] == lag[:-1]) & (position[1:] == position[:-1] + 1)
        for at, q in zip(position[~follows].tolist(), lag[~follows].tolist(), strict=True):
            if at < covered.get(q, 0):
                continue
            right = at + _reach(words, at, q)
            left = at - _reach(backwards, len(words) - at - q, q) if at else 0
            covered[q] = right
            length = right - left + q
            if length >= max(LEAST_LENGTH, LEAST_PERIODS * q):
                runs.append((left, length, q))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _searched(texts: list[str]) -> tuple[list[list[str]], list[list[tuple[int, int, int]]]]:
    """(words, runs) of each text. Equal words of different texts are different numbers, so no run crosses texts."""
    split = [_WORD.findall(t) for t in texts]
    lengths = np.array([len(w) for w in split], np.int64)
    ids: dict[str, int] = {}
    flat = np.fromiter((ids.setdefault(w, len(ids)) for ws in split for w in ws), np.int64, int(lengths.sum()))
    numbered = flat + np.repeat(np.arange(len(split)), lengths) * (len(ids) + 1)
    starts = np.cumsum(lengths) - lengths
    runs: list[list[tuple[int, int, int]]] = [[] for _ in split]
    for start, length, q in find_runs(numbered, int(lengths.max(initial=0))):
        owner = int(np.searchsorted(starts, start, "right")) - 1
        runs[owner].append((start - int(starts[owner]), length, q))
    return split, runs


def _collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words that lie in no run after its first period, joined by spaces."""
    if not runs:
        return " ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        edges[start + q] += 1
        edges[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(edges)[:-1] == 0)
    return " ".join([words[i] for i in kept])


RUNS_DDL = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every whole text: its periodic runs, and its words without repetitions.

    Words are runs of anything but ASCII blanks. A run of period q repeats its first q words four times or more, over
    six words or more; ``collapsed`` leaves out whatever any run holds after its first q words. Texts
    stay where they are: no shuffle. A task searches some texts together, bounded in characters; the number
    of seeds is at most the number of words for each doubling of the period.

    A null or empty text has no words, no runs and an empty ``collapsed``; a null id stays null; repeated rows are searched
    each; a very long text is searched by itself. Other columns are not read. No rows give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                end, chars = at + 1, len(texts[at])
                while end < len(texts) and chars + len(texts[end]) <= SLICE_CHARS:
                    chars += len(texts[end])
                    end += 1
                split, runs = _searched(texts[at:end])
                rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in runs]
                yield pa.record_batch(
                    [
                        batch.column(0).slice(at, end - at),
                        pa.array([len(w) for w in split], pa.int64()),
                        pa.array(rows, pa.list_(_RUN)),
                        pa.array(list(map(_collapsed, split, runs)), pa.string()),
                    ],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )
                at = end

    return with_text(docs, id_col, text_col).mapInArrow(run, RUNS_DDL)
