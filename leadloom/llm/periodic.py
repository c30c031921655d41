"""Runs of words: maximal stretches in which the words some period apart are the same.

A run is a maximal pair: two equal stretches, ``period`` words apart, that can be extended
neither to the left nor to the right. All maximal pairs are found in the LCP-interval tree
of the words' suffix array, from the leaves up: the positions of an interval are merged
child by child, and a pair of positions from two children is right-maximal as it is, and
left-maximal if the words to their left belong to different classes. Of these pairs those
whose distance is short enough for their length are the runs, with nothing to extend.

Positions nearer than half their common length form one progression in which all but the
first have the same word to the left. So for a position only the first one before it, or,
where it is the first itself, those after it are looked at: the work of an interval is the
smaller child's size times a logarithm, however often one word or line is repeated.

Before the suffix array is made, words whose five-grams do not come back near enough are
left out: inside a run every such gram comes back within one period.

Words are told apart exactly. Defined results: null and empty texts have no runs and an
empty collapsed text; rows are independent of each other, so repeated rows and rows without
an id give a row each; a run that has several periods counts with the smallest. Only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import Spans, run_on_chunks, texts

LEAST, TIMES = 6, 4        # words of a run, and how many periods it holds at least
CHUNK = 256 << 10          # text bytes whose words are looked at together; a longer text is one step
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def gram_size(least: int, times: int) -> int:
    """The longest grams of which every one inside a run comes back inside the run, one period away."""
    return max(1, min(max(least, times * q) - 2 * q + 1 for q in range(1, least + 1)))


def candidates(ids: np.ndarray, ends: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, piece numbers) of the words that a run may hold; the words of a piece follow each other in one text."""
    n, gram = len(ids), gram_size(least, times)
    none = np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    starts = np.flatnonzero(text[:max(0, n - gram + 1)] == text[gram - 1:])
    key = Spans(np.stack([ids, text], axis=1).ravel()).hash(2 * starts, 2 * (starts + gram))
    order = np.argsort(key, kind="stable")
    # distance to the nearest equal gram of the text
    gap = np.full(len(starts) + 1, n + 1, np.int64)
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    gap[same + 1] = starts[order[same + 1]] - starts[order[same]]
    near = np.empty(len(starts), np.int64)
    near[order] = np.minimum(gap[:-1], gap[1:])
    starts, near = starts[near <= n], near[near <= n]
    while len(starts):
        mark = np.zeros(n + 1, np.int64)
        np.add.at(mark, starts, 1)
        np.add.at(mark, starts + gram, -1)
        places = np.flatnonzero(np.cumsum(mark[:n]) > 0)
        piece = np.cumsum(np.append(False, (np.diff(places) != 1) | (np.diff(text[places]) != 0)))
        stay = near * times <= np.bincount(piece)[piece[np.searchsorted(places, starts)]]
        if stay.all():
            return places, piece
        starts, near = starts[stay], near[stay]
    return none, none


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and longest common prefixes (with the suffix before) by prefix doubling.

    Every text in ``symbols`` is closed by a symbol of its own, so no common prefix goes over its end.
    """
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int32)
    kept, width = [rank], 1
    while True:
        after = np.zeros(n, np.int64)
        after[:max(0, n - width)] = rank[width:].astype(np.int64) + 1
        pair = rank.astype(np.int64) * (n + 1) + after
        order = np.argsort(pair, kind="stable")
        new = np.cumsum(np.append(False, pair[order[1:]] != pair[order[:-1]])).astype(np.int32)
        rank = np.empty(n, np.int32)
        rank[order] = new
        if new[-1] == n - 1:
            break
        kept.append(rank)
        width *= 2
    lcp = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for level in range(len(kept) - 1, -1, -1):
        equal = (kept[level][np.minimum(a, n - 1)] == kept[level][np.minimum(b, n - 1)]) & (a < n) & (b < n)
        step = np.where(equal, 1 << level, 0)
        lcp[1:] += step
        a += step
        b += step
    return order, lcp


def maximal_pairs(order: np.ndarray, lcp: np.ndarray, left: np.ndarray, least: int, times: int) -> dict[tuple[int, int], int]:
    """(start, length) -> smallest period of the maximal pairs that hold ``times`` periods and ``least`` words."""
    floor = min(max(least - d, (times - 1) * d) for d in range(1, least + 1))
    word = left.tolist()
    found: dict[tuple[int, int], int] = {}

    def tell(a: int, b: int, common: int) -> None:
        if common + b - a >= least:
            spot = (a, common + b - a)
            found[spot] = min(b - a, found.get(spot, b - a))

    def merged(big: list[int], small: list[int], common: int) -> list[int]:
        if len(big) < len(small):
            big, small = small, big
        reach = common // (times - 1)
        for p in small:
            k = bisect_left(big, p - reach)
            if k < len(big) and big[k] < p and word[big[k]] != word[p]:
                tell(big[k], p, common)
            k = bisect_right(big, p)
            while k < len(big) and big[k] - p <= reach and word[big[k]] != word[p]:
                tell(p, big[k], common)
                k += 1
        if len(small) * 8 > len(big):
            return sorted(big + small)
        for p in small:
            insort(big, p)
        return big

    stack: list[tuple[int, list[int]]] = []          # open intervals: common length, positions by place
    last: list[int] = []
    for spot, common in zip(order.tolist() + [-1], lcp.tolist() + [0]):
        while stack and stack[-1][0] > common:
            depth, spots = stack.pop()
            last = merged(spots, last, depth)
        if common >= floor:
            if stack and stack[-1][0] == common:
                stack[-1] = (common, merged(stack[-1][1], last, common))
            else:
                stack.append((common, last))
        last = [spot]
    return found


def runs_of(ids: np.ndarray, ends: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of the runs of texts given as word numbers, by text, start and period."""
    if times < 3:
        raise ValueError("a run holds three periods at least")
    where, piece = candidates(ids, ends, least, times)
    none = np.zeros(0, np.int64)
    if not len(where):
        return none, none, none, none
    # the pieces one after another, each closed by a symbol of its own
    size = np.bincount(piece)
    n = len(where) + len(size)
    at = np.arange(len(where)) + piece
    symbols = np.full(n, -1, np.int64)
    symbols[at] = ids[where]
    closing = np.flatnonzero(symbols < 0)
    symbols[closing] = int(ids.max()) + 1 + np.arange(len(size))
    order, lcp = suffix_order(symbols)
    found = maximal_pairs(order, lcp, np.append(-1, symbols[:-1]), least, times)
    if not found:
        return none, none, none, none
    spots = np.array([(s, length, q) for (s, length), q in found.items()], np.int64)
    back = np.zeros(n, np.int64)
    back[at] = where
    start = back[spots[:, 0]]
    owner = np.searchsorted(ends, start, side="right") - 1
    start = start - ends[owner]
    put = np.lexsort((spots[:, 2], start, owner))
    return owner[put], start[put], spots[put, 1], spots[put, 2]


def plant_period(doc_id: int | None, words: list[str]) -> list[str]:
    """One document in ten (by its id's checksum) with its words from some place on replaced by repeats of the first of them."""
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES,
                  edit: Callable[[int | None, list[str]], list[str]] | None = None) -> DataFrame:
    """``doc_id``, ``runs`` (array of start, length, period in words), ``collapsed``: the words without the repeats, by one space.

    Of every run the first period stays. ``edit`` may change a document's words before they are looked at.
    """
    def step(chunk: pa.RecordBatch) -> pa.RecordBatch:
        words = [WORD.findall(t) for t in chunk.column("text").to_pylist()]
        if edit is not None:
            words = [edit(i, w) for i, w in zip(chunk.column("doc_id").to_pylist(), words)]
        ends = np.append(0, np.cumsum([len(w) for w in words]))
        flat = pa.array([x for w in words for x in w], pa.string())
        ids = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        text, start, length, period = runs_of(ids, ends, least, times)
        gone = np.zeros(len(ids) + 1, np.int64)
        np.add.at(gone, ends[text] + start + period, 1)
        np.add.at(gone, ends[text] + start + length, -1)
        keep = np.cumsum(gone[:-1]) == 0
        touched = set(text.tolist())
        kept = [" ".join([w[k] for k in np.flatnonzero(keep[ends[i]:ends[i + 1]]).tolist()] if i in touched else w)
                for i, w in enumerate(words)]
        told = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], ["start", "length", "period"])
        bounds = pa.array(np.searchsorted(text, np.arange(len(words) + 1)).astype(np.int32))
        return pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.ListArray.from_arrays(bounds, told), pa.array(kept, pa.string())],
                                          ["doc_id", "runs", "collapsed"])

    return run_on_chunks(texts(docs), step, "doc_id long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string",
                         limit=CHUNK)


def run_digest(found: DataFrame) -> DataFrame:
    """Counts, the longest run and digests of :func:`periodic_runs`."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    top = found.withColumn("top", longest)
    length, period = F.col("top.length"), -F.col("top.period")
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"), length.alias("length"),
        period.alias("period"), F.expr("top.length * 1000 div -top.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
