"""Runs (maximal repetitions) of words in texts, through longest previous factors.

A run is a stretch of words with smallest period q and a length of at least max(`least`, 2 q) that no
neighbouring word extends. Texts go through a task some hundred thousand words at a time:

1. Texts in which no six (half of `least`) consecutive words occur twice have no run and are done. The
   others become one string of numbers, in which each text has an alphabet of its own, so that nothing
   crosses from text to text.
2. Prefix doubling sorts the suffixes; the ranks of each step number the substrings of 2**k words, with
   which two positions' common extension, to the right or the left, is found in k comparisons. The
   suffix array and its LCP array give, taking suffixes away from the last to the first, the longest
   previous factor (LPF) of every position, and its source.
3. Factors of that length (one word where there is none) are the LZ blocks. A run that ends in a
   block and reaches its start has a period below the length of that block and the one before it
   together, so Main's extensions are tested at every boundary for these periods alone.
4. What is left are runs strictly inside a block: they are copied from the block's source, out of
   buckets by start, in text order.

Null texts have no words. Empty and very long texts are taken whole; a text longer than a chunk is a
chunk by itself. Repeated rows and null ids are rows like others, an empty table gives an empty
result, and other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import begin, shingle_hashes, slices, texts_of, type_name, words_by_row

#: Words of the texts that are taken together.
CHUNK = 200_000

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def doubled_ranks(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array, and for each k the ranks of the substrings of 2**k symbols (equal where they are
    equal), with -1 past the end."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    levels, width = [rank.astype(np.int32)], 1
    sizes = np.diff(np.append(starts, n))
    slots = np.flatnonzero(np.repeat(sizes, sizes) > 1)  # places of the suffix array still to be sorted
    while len(slots):
        some = order[slots]
        keys = rank[some] * (n + 2) + rank[np.minimum(some + width, n)] + 1
        by = np.argsort(keys, kind="stable")
        some, keys = some[by], keys[by]
        order[slots] = some
        first = np.concatenate(([True], keys[1:] != keys[:-1]))
        rank[some] = slots[np.flatnonzero(first)[np.cumsum(first) - 1]]
        levels.append(rank.astype(np.int32))
        alone = first & np.concatenate((first[1:], [True]))
        slots, width = slots[~alone], 2 * width
    return order, levels


def common_right(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols from i and from j on are equal; i and j differ."""
    far = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        far += (levels[k][i + far] == levels[k][j + far]).astype(np.int64) << k
    return far


def common_left(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols up to i and up to j, these included, are equal; -1 is before the first."""
    far = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = i - far - (1 << k) + 1, j - far - (1 << k) + 1
        inside = (a >= 0) & (b >= 0)
        far += (inside & (levels[k][np.where(inside, a, 0)] == levels[k][np.where(inside, b, 0)])).astype(np.int64) << k
    return far


def longest_previous(order: np.ndarray, levels: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """For each position the length of the longest factor from there that also starts earlier, and where."""
    n = len(order)
    lcp = [0] * (n + 2)
    if n > 1:
        lcp[2 : n + 1] = common_right(levels, order[:-1], order[1:]).tolist()
    place = np.empty(n, np.int64)
    place[order] = np.arange(1, n + 1)
    at, back, on = [0, *order.tolist(), 0], list(range(-1, n + 1)), list(range(1, n + 3))
    length, source = [0] * n, [0] * n
    for i, r in zip(range(n - 1, -1, -1), place[::-1].tolist()):
        p, q = back[r], on[r]
        lp, lq = lcp[r], lcp[q]
        if lp >= lq:
            length[i], source[i], lcp[q] = lp, at[p], lq
        else:
            length[i], source[i], lcp[q] = lq, at[q], lp
        on[p], back[q] = q, p
    return length, source


def blocks(length: list[int], start: int, end: int) -> list[int]:
    """Starts of the LZ blocks of a text."""
    out = []
    while start < end:
        out.append(start)
        start += length[start] or 1
    return out


def crossing_runs(symbols: np.ndarray, levels: list[np.ndarray], cuts: list[list[int]], starts: list[int], ends: list[int], least: int) -> np.ndarray:
    """(start, end, period) of the runs that cross or touch a boundary, by Main's extensions."""
    bound, lowest, highest, periods = [], [], [], []
    for cut, start, end in zip(cuts, starts, ends):
        at = np.array([*cut, end], np.int64)
        size = np.append(np.diff(at), 0)
        bound.append(at[1:])
        lowest.append(np.full(len(at) - 1, start))
        highest.append(np.full(len(at) - 1, end))
        periods.append(size[:-1] + np.maximum(size[1:], 1) - 1)
    periods = np.concatenate(periods)
    b, low, high = (np.repeat(np.concatenate(x), periods) for x in (bound, lowest, highest))
    p = np.arange(len(b)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    padded = np.append(symbols, -1)
    found = []
    for other in (b + p, b - p):  # the second repetition starts at the boundary, or the first one
        fits = (other <= high) & (other >= low)
        touch = fits & ((padded[np.where(fits, other, 0)] == padded[b]) & (b < high) & (other < high) | (padded[np.where(fits, other, 1) - 1] == padded[b - 1]) & (other > low))
        x, y, q = b[touch], other[touch], p[touch]
        right, left = np.where(np.maximum(x, y) < high[touch], common_right(levels, x, y), 0), np.where(np.minimum(x, y) > low[touch], common_left(levels, x - 1, y - 1), 0)
        first, last = np.minimum(x, y) - left, np.maximum(x, y) + right
        long = last - first >= np.maximum(least, 2 * q)
        found.append(np.stack([first[long], last[long], q[long]], axis=1))
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)  # of one stretch's periods the smallest
    return runs[new]


def copied_runs(runs: dict[int, list[tuple[int, int]]], cut: list[int], end: int, source: list[int], least: int) -> None:
    """Add to the runs (start to ends and periods) of a text those strictly inside its blocks."""
    for start, stop in zip(cut, [*cut[1:], end]):
        shift = start - source[start]
        for x in range(start - shift + 1, stop - shift - least):
            for last, period in runs.get(x, ()):
                if last < stop - shift:
                    runs[x + shift].append((last + shift, period))


def runs_of(texts: list[list[bytes]], least: int = 12) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of some texts of words, by start, then period."""
    known: dict[bytes, int] = {}
    ends = np.cumsum([len(t) for t in texts]).tolist()
    starts = [0, *ends[:-1]]
    symbols = np.array([known.setdefault(w, len(known)) for t in texts for w in t], np.int64)
    symbols += np.repeat(np.arange(len(texts)), [len(t) for t in texts]) * (len(known) + 1)
    if not len(symbols):
        return [[] for _ in texts]
    order, levels = doubled_ranks(symbols)
    length, source = longest_previous(order, levels)
    cuts = [blocks(length, a, b) for a, b in zip(starts, ends)]
    found = crossing_runs(symbols, levels, cuts, starts, ends, least)
    places = np.searchsorted(found[:, 0], [*starts, len(symbols)]).tolist()
    out = []
    for cut, start, end, lo, hi in zip(cuts, starts, ends, places, places[1:]):
        runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for first, last, period in found[lo:hi].tolist():
            runs[first].append((last, period))
        if runs:
            copied_runs(runs, cut, end, source, least)
        out.append(sorted(((x - start, last - x, period) for x, some in runs.items() for last, period in some), key=lambda r: (r[0], r[2])))
    return out


def _may_have_runs(hashes: np.ndarray, least: int) -> bool:
    """Whether some run of half of `least` words occurs twice: every run has one."""
    if len(hashes) < least:
        return False
    grams = np.sort(shingle_hashes(hashes, (least + 1) // 2))
    return bool((grams[1:] == grams[:-1]).any())


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame, *, least: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, runs (array of start, length, period, by start, then period), collapsed (the
    text's words joined by one space, without those that a run holds after its first period)."""

    def rows(batch):
        """Texts of a few rows: (words, runs)."""
        texts = [t or b"" for t in texts_of(batch.column(1))]
        may = [_may_have_runs(hashes, least) for _, hashes in words_by_row(texts, fold=False)]
        words, runs, some, held = [t.split() for t in texts], [[] for _ in texts], [], 0
        for k in range(len(texts)):
            if may[k]:
                some.append(k)
                held += len(words[k])
            if some and (held > CHUNK or k == len(texts) - 1):
                for i, found in zip(some, runs_of([words[i] for i in some], least)):
                    runs[i] = found
                some, held = [], 0
        return words, runs

    def run(batches):
        begin("periodic_runs")
        for batch in slices(batches):
            words, runs = rows(batch)
            offsets = pa.array(np.cumsum([0] + [len(r) for r in runs]), pa.int32())
            flat = np.array([r for some in runs for r in some], np.int64).reshape(-1, 3)
            struct = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(RUN))
            columns = [batch.column(0), pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(offsets, struct), pa.array([_collapsed(w, r) for w, r in zip(words, runs)], pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "runs", "collapsed"])

    schema = f"id {type_name(docs, id_col)}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return found.withColumnRenamed("id", id_col)
