"""Periodic runs of words by maximal pairs: an LCP-interval tree, bottom-up, with left-word classes at its nodes."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of, text_slices

#: Words of a run at least, and repetitions of its period.
LEAST_WORDS, LEAST_TIMES = 24, 3
#: Bytes of text sorted together (a longer text alone). A word takes some 300 bytes in the worst case.
SLICE_BYTES = 1_000_000

Run = tuple[int, int, int]


def least_common(least_words: int = LEAST_WORDS, times: int = LEAST_TIMES) -> int:
    """The shortest common part of two places a period apart in a run: (times - 1) / times of the shortest run."""
    return max(1, -(-least_words * (times - 1) // times))


def repeated_places(ids: np.ndarray, owner: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """The texts in which some ``length`` words stand twice, perhaps with others (a hash decides): no other text
    has a node in its tree. ``ids`` are the words of all texts on end."""
    key = _mixed(ids.astype(np.uint64) + (owner.astype(np.uint64) << np.uint64(32)))
    whole, done, width = None, 0, 1
    # Windows of any length from doubled ones, by the bits of the length.
    while True:
        if length & width:
            part = key[done:]
            whole = part if whole is None else _mixed(whole[: len(part)] * np.uint64(0x9E3779B97F4A7C15) + part)
            done += width
        if done == length:
            break
        key = _mixed(key[:-width] * np.uint64(0xC2B2AE3D27D4EB4F) + key[width:]) if len(key) > width else key[:0]
        width *= 2
    at = np.flatnonzero(np.arange(len(whole)) + length <= ends[owner[: len(whole)]])
    order = at[np.argsort(whole[at], kind="stable")]
    same = whole[order][1:] == whole[order][:-1]
    return np.unique(owner[order[1:][same]])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sorted_suffixes(ids: np.ndarray, owner: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in suffix order and the words each has in common with the one before, of those places only that
    share ``least`` words with a neighbour (others get 0 in common); suffixes of two texts have none.

    Ranks of windows of 1, 2, 4, ... words; in each step only places whose window is not yet alone are
    sorted. The ranks of all steps are kept, and give the common words by halving.
    """
    n = len(ids)
    order = np.lexsort((ids, owner))
    first = np.r_[True, (ids[order][1:] != ids[order][:-1]) | (owner[order][1:] != owner[order][:-1])]
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.full(n + 1, -1, np.int32)
    rank[order] = start
    alone = first & np.r_[first[1:], True]
    open_ = np.sort(order[~alone])
    levels, width = [rank], 1
    while len(open_):
        behind = rank[np.minimum(open_ + width, n)]
        key = rank[open_].astype(np.int64) * (n + 2) + behind + 1
        order = np.argsort(key, kind="stable")
        places, key = open_[order], key[order]
        group = rank[places]
        new = np.r_[True, key[1:] != key[:-1]]
        new_group = np.r_[True, group[1:] != group[:-1]]
        index = np.arange(len(places))
        begin = np.maximum.accumulate(np.where(new, index, 0))
        group_begin = np.maximum.accumulate(np.where(new_group, index, 0))
        rank = rank.copy()
        rank[places] = group + (begin - group_begin)
        alone = new & np.r_[new[1:], True]
        open_ = np.sort(places[~alone])
        levels.append(rank)
        width *= 2
    order = np.argsort(levels[-1][:n], kind="stable")
    a, b = order[:-1], order[1:]
    # Only neighbours that agree in the widest power of two below ``least`` can reach it.
    floor = min(len(levels) - 1, max(0, least.bit_length() - 1))
    near = np.flatnonzero(levels[floor][a] == levels[floor][b])
    a, b, common = a[near], b[near], np.zeros(len(near), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        agree = levels[k][np.minimum(a + common, n)] == levels[k][np.minimum(b + common, n)]
        common += np.where(agree & (np.maximum(a, b) + common < n), 1 << k, 0)
    shared = np.zeros(n, np.int64)
    shared[near + 1] = np.where(common >= least, common, 0)
    kept = (shared >= least) | np.r_[shared[1:] >= least, False]
    return order[kept], shared[kept]


class Node:
    """Places of an LCP interval in order, and the same parted by the word to their left."""

    __slots__ = ("places", "classes")

    def __init__(self, place: int, left: int):
        self.places, self.classes = [place], {left: [place]}


def maximal_pairs(suffixes: list[int], common: list[int], left: list[int], least: int, times: int = LEAST_TIMES) -> Iterator[tuple[int, int, int]]:
    """(first place, second place, common words) of all maximal pairs with at least ``least`` common words and a
    distance of at most a (times - 1)-th of them.

    Suffixes of an interval share its words and go on differently between its children, so a pair from
    two children is maximal where the words to the left differ as well. Children are joined bottom-up,
    the smaller into the larger; for each of its places x the partners in reach are found by class.
    Within reach the string overlaps itself, so all its places there but the first stand behind the same
    word: to the right of x all partners lie in one class, the nearest's, and to the left only the
    outermost place can have another left word than x. So the work beyond the joins is that of the pairs
    given, of which a run has one for each multiple of its period.
    """
    stack: list[tuple[int, Node]] = []
    for place, shared in zip(suffixes, common[1:] + [0]):
        node = Node(place, left[place])
        while stack and stack[-1][0] >= shared:
            depth, other = stack.pop()
            node = yield from _joined(other, node, depth, left, depth // (times - 1))
        if shared >= least:
            stack.append((shared, node))


def _joined(a: Node, b: Node, depth: int, left: list[int], reach: int):
    if len(a.places) < len(b.places):
        a, b = b, a
    places = a.places
    for x in b.places:
        k = bisect_left(places, x)
        if k < len(places) and places[k] - x <= reach:
            own = left[places[k]]
            if own != left[x]:
                partners = a.classes[own]
                for at in range(bisect_left(partners, x), len(partners)):
                    if partners[at] - x > reach:
                        break
                    yield x, partners[at], depth
        if k and places[k - 1] >= x - reach:
            y = places[bisect_left(places, x - reach, 0, k)]
            if left[y] != left[x]:
                yield y, x, depth
    if len(b.places) * 8 < len(places):
        for x in b.places:
            _put(places, x)
        for word, group in b.classes.items():
            own = a.classes.setdefault(word, [])
            for x in group:
                _put(own, x)
    else:
        places += b.places
        places.sort()
        for word, group in b.classes.items():
            own = a.classes.setdefault(word, [])
            own += group
            own.sort()
    return a


def _put(places: list[int], x: int) -> None:
    if not places or x > places[-1]:
        places.append(x)
    else:
        insort(places, x)


def runs_by_text(words: list[list], least_words: int = LEAST_WORDS, times: int = LEAST_TIMES) -> list[list[Run]]:
    """The runs (start, length, period) of each list of words, by start, then period.

    A run of period q and length n is the maximal pair (start, start + q) with n - q common words, and
    every maximal pair whose common words reach (times - 1) q and give ``least_words`` with q is such a
    stretch. Pairs at a multiple of the period give the same stretch: its smallest distance counts.
    ``times`` is 3 or more: places within half of their common words are what the tree's reach rests on.
    """
    if times < 3:
        raise ValueError("runs of fewer than three periods are not supported")
    out: list[list[Run]] = [[] for _ in words]
    counts = np.array([len(w) if len(w) >= least_words else 0 for w in words], np.int64)
    if not counts.sum():
        return out
    flat = list(chain.from_iterable([w for w in words if len(w) >= least_words]))
    known = {w: k for k, w in enumerate(set(flat))}
    ids = np.array(itemgetter(*flat)(known), np.int64)
    owner = np.repeat(np.arange(len(words)), counts)
    ends = np.cumsum(counts)
    least = least_common(least_words, times)
    texts = repeated_places(ids, owner, ends, least)
    if not len(texts):
        return out
    mark = np.zeros(len(words), bool)
    mark[texts] = True
    chosen = mark[owner]
    ids, owner = ids[chosen], owner[chosen]
    begin = np.r_[True, owner[1:] != owner[:-1]]
    left = np.r_[0, ids[:-1]]
    # The first word of a text has nothing to its left.
    left[begin] = -1
    base = np.zeros(len(words), np.int64)
    base[owner[begin]] = np.flatnonzero(begin)
    suffixes, common = sorted_suffixes(ids, owner, least)
    found: dict[tuple[int, int], int] = {}
    for x, y, shared in maximal_pairs(suffixes.tolist(), common.tolist(), left.tolist(), least, times):
        period, end = y - x, y + shared
        if end - x >= least_words and period < found.get((x, end), end):
            found[x, end] = period
    texts_of = owner.tolist()
    shift = base.tolist()
    for (x, end), period in sorted(found.items(), key=lambda item: (item[0][0], item[1])):
        text = texts_of[x]
        out[text].append((x - shift[text], end - x, period))
    return out


def collapsed(words: list, runs: list[Run]) -> list:
    """The words without those that a run repeats: what stands in it after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    kept = np.cumsum(change[:-1]) == 0
    return [w for w, k in zip(words, kept.tolist()) if k]


def repeat_tail(key, words: list) -> list:
    """The words of a text into which a run is planted: where crc32 of the decimal key is divisible by 10, the
    words from a on repeat their first p. A null key counts as an empty one."""
    h = crc_of("" if key is None else key)
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[: n - a]


def find_runs(docs: DataFrame, prepare: Callable[[object, list], list] | None = None, least_words: int = LEAST_WORDS, times: int = LEAST_TIMES) -> DataFrame:
    """doc_id, runs (array of start, length, period; by start, then period), collapsed (text), of every whole text.

    Words are stretches without ASCII white space, numbered from 0; ``prepare(doc_id, words)`` may change
    them. ``collapsed`` is the words that stay when each run keeps its first period, joined by one space.

    Null and empty texts have no words and no run. Repeated rows give repeated rows, an empty table none;
    further columns of ``docs`` never reach Python.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1, SLICE_BYTES):
            # Bytes are parted at ASCII white space alone.
            words = [(t or "").encode().split() for t in batch.column(1).to_pylist()]
            if prepare:
                words = [prepare(k, w) for k, w in zip(batch.column(0).to_pylist(), words)]
            runs = runs_by_text(words, least_words, times)
            texts = [b" ".join(collapsed(w, r)).decode() for w, r in zip(words, runs)]
            items = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, item), pa.array(texts, pa.string())], names=["doc_id", "runs", "collapsed"])

    item = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period; of equal ones the one with the smallest start, then period."""

    def better(best: Column, run: Column) -> Column:
        higher = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | higher, run).otherwise(best)

    # The array is in the order of start and period, so the first of equals stays.
    return F.reduce(F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))), F.get(runs, 0), better)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period and exponent_milli of the strongest run, digests of all runs and of
    the collapsed text, of documents into which runs were planted (``repeat_tail``)."""
    found = find_runs(docs, repeat_tail).withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
