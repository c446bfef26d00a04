"""Periodic runs of words by maximal pairs in an LCP-interval tree.

The words of a task's slice of texts are laid end to end, each text between
two marks of its own, and their suffixes are sorted by doubling. A bottom-up
pass over the tree of LCP intervals joins neighbouring intervals; a node
lists its positions by the word on their left (their class). Positions i < j
that come from different children of an interval of ``l`` words and have
different words on their left are a maximal pair: the ``l`` words at i are
those at j and can be extended on neither side. If ``j - i`` is small enough
against ``l``, the stretch from i over ``l + j - i`` words is a run; nothing is
extended afterwards.

For a run of smallest period q the pair is (start, start + q), and no other
position of its interval lies between the two: the ``l >= 2q`` words there
would have a shorter period too. So a position is compared only with its
neighbours in the order of positions, and a tree of n positions costs
``O(n log^2 n)`` however repetitive the text is.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialectic.llm.frames import slices, texts

RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
Pair = tuple[int, int, int]


def shortest_match(min_words: int, min_exponent: int) -> int:
    """The fewest words a maximal pair of a run has in common."""
    return min(max(min_words - q, (min_exponent - 1) * q) for q in range(1, max(2, min_words)))


class SuffixOrder:
    """Suffixes of ``words`` (numbers), sorted within groups of one text that
    share their first ``least`` words; suffixes that share them with none are
    left out. ``text`` numbers the text of every place. ``order`` holds the
    suffixes, ``lcp[k]`` the common words of ``order[k - 1]`` and ``order[k]`` (0
    between groups). Marks between texts must be different numbers."""

    def __init__(self, words: np.ndarray, text: np.ndarray, least: int) -> None:
        n = len(words)
        _, ranks = np.unique(words, return_inverse=True)
        self.levels: list[tuple[int, np.ndarray]] = [(1, ranks.astype(np.int64))]
        while 2 * self.levels[-1][0] <= least:
            size, r = self.levels[-1]
            self.levels.append((2 * size, self._join(r, r, size)))
        size, r = self.levels[-1]
        rest = least - size
        for step, s in reversed(self.levels[:-1]):
            if step <= rest:
                r, size, rest = self._join(r, s, size), size + step, rest - step
        _, r = np.unique(text * (int(r.max(initial=0)) + 1) + r, return_inverse=True)
        self.levels.append((size, r))
        order = np.argsort(r, kind="stable")
        begins = np.flatnonzero(np.append(True, np.diff(r[order]) > 0)) if n else np.zeros(0, np.int64)
        sizes = np.diff(np.append(begins, n))
        rank = np.empty(n, np.int64)
        rank[order] = np.repeat(begins, sizes)
        self.levels[-1] = (size, rank)
        shared = np.repeat(sizes > 1, sizes)
        self.order = order[shared]
        self.group = np.repeat(begins, sizes)[shared]
        self._refine()
        self._measure()

    @staticmethod
    def _join(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
        """Ranks by ``a`` at a place, then by ``b`` ``size`` places on."""
        later = np.zeros(len(a), np.int64)
        if size < len(a):
            later[:len(a) - size] = b[size:] + 1
        _, rank = np.unique(a * (int(b.max(initial=0)) + 2) + later, return_inverse=True)
        return rank

    def _refine(self) -> None:
        """Sort on by doubled length, only where suffixes are still equal."""
        size, rank = self.levels[-1]
        n, at = len(rank), np.arange(len(self.order))
        while len(at):
            places = self.order[at]
            after = places + size
            later = np.where(after < n, rank[np.minimum(after, max(n - 1, 0))] + 1, 0)
            here = rank[places]
            by = np.lexsort((later, here))
            self.order[at] = places[by]
            here, later = here[by], later[by]
            head = np.append(True, (np.diff(here) != 0) | (np.diff(later) != 0))
            first = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
            top = np.maximum.accumulate(np.where(np.append(True, np.diff(here) != 0), np.arange(len(at)), 0))
            rank = rank.copy()
            rank[self.order[at]] = here + first - top
            size *= 2
            self.levels.append((size, rank))
            many = np.diff(np.append(np.flatnonzero(head), len(at))) > 1
            at = at[np.repeat(many, np.diff(np.append(np.flatnonzero(head), len(at))))]

    def _measure(self) -> None:
        """Common words of neighbours, from the longest rank down."""
        same = np.append(False, np.diff(self.group) == 0) if len(self.order) else np.zeros(0, bool)
        k = np.flatnonzero(same)
        a, b = self.order[k - 1].copy(), self.order[k].copy()
        common = np.zeros(len(k), np.int64)
        for size, rank in reversed(self.levels):
            n = len(rank)
            equal = (a < n) & (b < n)
            equal[equal] = rank[a[equal]] == rank[b[equal]]
            step = np.where(equal, size, 0)
            a, b, common = a + step, b + step, common + step
        self.lcp = np.zeros(len(self.order), np.int64)
        self.lcp[k] = common


class Interval:
    """Positions of an LCP interval: by the class of their left word, and all
    of them in few sorted lists of doubling lengths."""

    __slots__ = ("size", "classes", "sorted_lists")

    def __init__(self, position: int, left: int) -> None:
        self.size, self.classes, self.sorted_lists = 1, {left: [position]}, [[position]]

    def neighbours(self, position: int) -> tuple[int, int]:
        """The nearest positions before and behind (-1: none)."""
        before = behind = -1
        for run in self.sorted_lists:
            at = bisect.bisect_left(run, position)
            if at and run[at - 1] > before:
                before = run[at - 1]
            if at < len(run) and (behind < 0 or run[at] < behind):
                behind = run[at]
        return before, behind

    def absorb(self, other: Interval) -> None:
        self.size += other.size
        for left, positions in other.classes.items():
            mine = self.classes.get(left)
            if mine is None:
                self.classes[left] = positions
            else:
                mine += positions
        for run in sorted(other.sorted_lists, key=len, reverse=True):
            while self.sorted_lists and len(self.sorted_lists[-1]) <= len(run):
                run = sorted(self.sorted_lists.pop() + run)
            self.sorted_lists.append(run)


def _pairs_between(small: Interval, large: Interval, l: int, left: list[int], widest: int) -> Iterator[Pair]:
    """Maximal pairs (i, j, l) of neighbouring positions at most ``widest`` apart."""
    for c, positions in small.classes.items():
        if len(large.classes) == 1 and c in large.classes:
            continue  # the same word on the left of all: none is maximal
        for p in positions:
            before, behind = large.neighbours(p)
            if before >= 0 and p - before <= widest and left[before] != c:
                yield before, p, l
            if behind >= 0 and behind - p <= widest and left[behind] != c:
                yield p, behind, l


def maximal_pairs(order: list[int], lcp: list[int], left: list[int], min_exponent: int) -> Iterator[Pair]:
    """Maximal pairs at most ``l // (min_exponent - 1)`` words apart among
    neighbouring positions, bottom up over the intervals of ``order``."""
    stack: list[tuple[Interval, int]] = []

    def join_last() -> Iterator[Pair]:
        node, l = stack.pop()
        other, bound = stack.pop()
        small, large = (node, other) if node.size < other.size else (other, node)
        yield from _pairs_between(small, large, l, left, l // (min_exponent - 1))
        large.absorb(small)
        stack.append((large, bound))

    for position, l in zip(order, lcp):
        while len(stack) > 1 and stack[-1][1] >= l:
            yield from join_last()
        if not l:
            stack.clear()  # another group of suffixes
        stack.append((Interval(position, left[position]), l))
    while len(stack) > 1:
        yield from join_last()


def runs_of(tokens: list[list], min_words: int = 6, min_exponent: int = 4) -> list[list[Pair]]:
    """The runs (start, length, period) of each list of hashable words, by start,
    then period: stretches of at least ``min_words`` words and ``min_exponent``
    (3 or more) times their smallest period, which no neighbouring word extends."""
    if min_exponent < 3 or min_words < 1:
        raise ValueError("min_exponent must be 3 or more, min_words 1 or more")
    sizes = np.array([len(t) for t in tokens], np.int64)
    flat = list(chain.from_iterable(tokens))
    found: list[dict[tuple[int, int], int]] = [{} for _ in tokens]
    if flat:
        codes = pa.array(flat).dictionary_encode().indices.to_numpy().astype(np.int64)
        # A mark of its own before every text and behind the last.
        marks = np.cumsum(sizes + 1) - sizes - 1
        words = np.empty(len(flat) + len(tokens) + 1, np.int64)
        words[:] = -1 - np.arange(len(words))
        inside = np.ones(len(words), bool)
        inside[marks], inside[-1] = False, False
        words[inside] = codes
        for i, j, l in _near_pairs(words, marks, min_words, min_exponent):
            doc = int(np.searchsorted(marks, i, side="right")) - 1
            key, q = (i - int(marks[doc]) - 1, l + j - i), j - i
            if key[1] >= max(min_words, min_exponent * q):
                found[doc][key] = min(q, found[doc].get(key, q))
    return [sorted((s, length, q) for (s, length), q in f.items()) for f in found]


def _near_pairs(words: np.ndarray, marks: np.ndarray, min_words: int, min_exponent: int) -> Iterator[Pair]:
    least = shortest_match(min_words, min_exponent)
    suffixes = SuffixOrder(words, np.searchsorted(marks, np.arange(len(words)), side="right"), least)
    order, lcp, group = suffixes.order, suffixes.lcp, suffixes.group
    if not len(order):
        return
    # A group whose positions in one text are all too far apart for its longest
    # common stretch holds no run: its part of the tree is not walked.
    begins = np.flatnonzero(lcp == 0)
    longest = np.maximum.reduceat(lcp, begins)
    number = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(order))))
    by = np.lexsort((order, number))
    gap = np.full(len(order), np.iinfo(np.int64).max)
    gap[1:] = np.where(np.diff(number[by]) == 0, np.diff(order[by]), gap[1:])
    nearest = np.minimum.reduceat(gap, begins)
    walked = (nearest <= longest // (min_exponent - 1))[number]
    yield from maximal_pairs(order[walked].tolist(), lcp[walked].tolist(),
                             np.append(words[-1:], words[:-1]).tolist(), min_exponent)


def without_repeats(words: list, runs: list[Pair]) -> list:
    """``words`` less those that any run holds behind its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, min_words: int = 6, min_exponent: int = 4) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row's whole ``text``.

    Words are stretches without ASCII white space, compared byte by byte;
    ``runs`` is sorted by start, then period; ``collapsed`` joins by one space
    the words that no run holds behind its first period. Null and empty texts
    have no words, no runs and an empty ``collapsed``. Rows with equal or null
    ids stay rows of their own; other columns are left behind.
    """
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_words", T.LongType()),
                           T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
        for batch in batches:
            for part in slices(batch, "text"):
                words = [t.encode().split() for t in texts(part)]
                runs = runs_of(words, min_words, min_exponent)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array([len(w) for w in words], pa.int64()),
                    pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs], kind),
                    pa.array([b" ".join(without_repeats(w, r)) for w, r in zip(words, runs)]).cast(pa.string()),
                ], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def strongest(runs: str) -> Column:
    """The run with the greatest length / period (compared without rounding);
    ties go to the first in the array; null if there is none."""
    r = F.col(runs)
    return F.aggregate(r, F.get(r, F.lit(0)),
                       lambda best, x: F.when(x.length * best.period > best.length * x.period, x).otherwise(best))
