"""Periodic runs of words by maximal-pair enumeration.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical) and a length of at least max(``LEAST``, ``TIMES`` * q) that no
neighbouring word extends. Two places p < r start a maximal pair of length l when
their next l words agree, the words behind those differ, and so do the words in
front. With d = r - p and l >= (TIMES - 1) * d, the l + d words from p have
period d and nothing extends them; the other way round, each run gives such pairs
for its period and its multiples. So the maximal pairs that meet the length
constraints are the runs, and the least distance per stretch is its period: by the
periodicity lemma every other one is a multiple.

The pairs come from the LCP-interval tree, walked from the bottom up. Suffixes are
sorted by doubling their known prefixes (the texts of a slice at once, each with a
separator of its own); places whose first words never recur in their text drop
out, as they are in no interval deep enough. Each interval holds its places by
their left word, sorted. Where a child joins, each place of the smaller side looks
in the lists of the other left words for places within l / (TIMES - 1); places of
one list are never paired, which keeps long runs cheap: their inner places
all have the same left word. Lists merge smaller into larger.

Defined results: a null or empty text has no words and no runs, bytes that are no
UTF-8 count as U+FFFD; rows are read one by one, so repeated rows share a result; a text of any
length is one suffix array, of a few dozen bytes a word; an empty table
gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, TIMES = 6, 4
#: Words of the texts that are sorted together; only speed hangs on it.
SLICE = 200_000


def _ranked(sym: np.ndarray, least: int):
    """Suffix ranks of ``sym`` and what finds them.

    Returns [(k, ranks by the first k symbols)] and the places whose first
    ``least`` symbols or so recur, in the order of their suffixes.
    """
    size = len(sym)
    count = np.bincount(sym)
    rank = (np.cumsum(count) - count)[sym]
    active = np.flatnonzero(count[sym] > 1)
    levels, k, held = [(1, rank.astype(np.int32))], 1, active if least < 2 else None
    while len(active):
        key = rank[active] * size + rank[active + k]
        order = np.argsort(key, kind="stable")
        place, key = active[order], key[order]
        at = np.arange(len(place))
        first = lambda new: np.maximum.accumulate(np.where(new, at, 0))
        new = np.concatenate(([True], key[1:] != key[:-1]))
        old = rank[place]
        start, before = first(new), first(np.concatenate(([True], old[1:] != old[:-1])))
        rank = rank.copy()
        rank[place] = old + start - before
        single = new & np.concatenate((new[1:], [True]))
        active, k = place[~single], 2 * k
        levels.append((k, rank.astype(np.int32)))
        if held is None and 2 * k > least:
            held = active
    held = active if held is None else held
    return levels, held[np.argsort(rank[held])]


def _common(levels, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of the suffixes at ``a`` and ``b``."""
    out = np.zeros(len(a), np.int64)
    for k, rank in reversed(levels):
        out += k * (rank[a + out] == rank[b + out])
    return out


class _Node:
    """Places below an interval: all, and by left word."""

    __slots__ = ("all", "by")

    def __init__(self, place: int, left: list[int]):
        self.all, self.by = [place], {left[place]: [place]}


def _pairs(places: list[int], depth: list[int], left: list[int], least: int, times: int, found: dict) -> None:
    """Adds to ``found`` (start, end) -> period of the pairs below the intervals of suffixes ``places``.

    ``depth[i]`` is the common prefix of the i-th suffix and the one before.
    """
    far = times - 1

    def join(a, b, length: int) -> _Node:
        if isinstance(a, int):
            a, b = b, a
        if isinstance(a, int):
            a = _Node(a, left)
        if not isinstance(b, int) and len(b.all) > len(a.all):
            a, b = b, a
        reach, every = length // far, a.all
        for p in (b,) if isinstance(b, int) else b.all:
            low, high, own = p - reach, p + reach, left[p]
            i = bisect_left(every, low)
            j = bisect_right(every, high, i)
            if i == j:
                continue
            if j - i <= len(a.by):
                others = [q for q in every[i:j] if left[q] != own]
            else:
                others = [q for c, held in a.by.items() if c != own
                          for q in held[bisect_left(held, low) : bisect_right(held, high)]]
            for q in others:
                d = abs(p - q)
                if length + d >= least:
                    span = (min(p, q), min(p, q) + length + d)
                    found[span] = min(d, found.get(span, d))
        if isinstance(b, int):
            insort(every, b)
            held = a.by.get(left[b])
            if held is None:
                a.by[left[b]] = [b]
            else:
                insort(held, b)
        else:
            every += b.all
            every.sort()   # two sorted stretches: linear
            for c, other in b.by.items():
                held = a.by.get(c)
                if held is None:
                    a.by[c] = other
                else:
                    held += other
                    held.sort()
        return a

    stack, node = [], places[0]
    for i in range(1, len(places) + 1):
        h = depth[i] if i < len(places) else -1
        while stack and stack[-1][0] > h:
            length, other = stack.pop()
            node = join(other, node, length)
        if h < 0:
            break
        if stack and stack[-1][0] == h:
            stack[-1] = (h, join(stack[-1][1], node, h))
        else:
            stack.append((h, node))
        node = places[i]


def runs(texts: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each list of words, by start, then period."""
    shortest = min(max(least - d, (times - 1) * d) for d in range(1, least + 1))
    parts, begins, base, ids = [], [], 0, 0
    for words in texts:
        number: dict[bytes, int] = {}
        part = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        parts += [part + ids, [ids + len(number)]]   # the separator is a symbol of its own
        begins.append(base)
        base += len(words) + 1
        ids += len(number) + 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not texts:
        return out
    sym = np.concatenate(parts).astype(np.int64)
    levels, held = _ranked(sym, shortest)
    if len(held) < 2:
        return out
    depth = np.concatenate(([0], _common(levels, held[:-1], held[1:])))
    edges = np.flatnonzero(depth < shortest)
    edges = np.append(edges, len(held))
    left = np.concatenate(([-1], sym[:-1]))
    left[begins] = -1
    left = left.tolist()
    place, depth, found = held.tolist(), depth.tolist(), {}
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a > 1:
            _pairs(place[a:b], depth[a:b], left, least, times, found)
    starts = np.array(begins)
    for (start, end), period in found.items():
        text = int(np.searchsorted(starts, start, "right")) - 1
        out[text].append((start - begins[text], end - start, period))
    for x in out:
        x.sort(key=lambda r: (r[0], r[2]))
    return out


def greatest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period; ties: smallest start, then period."""
    return max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that some run holds after its first period."""
    if not found:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [w for w, n in zip(words, np.cumsum(edge).tolist()) if not n]


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Per row: doc_id, n_words, runs (array of start, length, period), best (one of them or null) and the collapsed text."""
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    named = lambda r: None if r is None else dict(zip(("start", "length", "period"), r))

    def table(keys: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = runs(texts, least, times)
        return pa.RecordBatch.from_arrays(
            [keys, pa.array([len(w) for w in texts], pa.int64()),
             pa.array([[named(r) for r in f] for f in found], pa.list_(run_type)),
             pa.array([named(greatest(f)) for f in found], run_type),
             pa.array([b" ".join(collapsed(w, f)) for w, f in zip(texts, found)], pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "runs", "best", "collapsed"])

    def run(batches):
        for batch in batches:
            first, held, size = 0, [], 0
            for row, text in enumerate(batch.column(1)):
                held.append((text.as_py() or b"").split())
                size += len(held[-1])
                if size >= SLICE:
                    yield table(batch.column(0).slice(first, len(held)), held)
                    first, held, size = row + 1, [], 0
            if held:
                yield table(batch.column(0).slice(first, len(held)), held)

    kind = "struct<start: bigint, length: bigint, period: bigint>"
    text = F.make_valid_utf8(F.col("text").cast("string")).cast("binary")
    return (docs.select(F.col("doc_id").cast("long"), text.alias("text"))
            .mapInArrow(run, f"doc_id long, n_words long, runs array<{kind}>, best {kind}, collapsed string"))
