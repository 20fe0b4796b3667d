"""N-gram Jaccard join with prefix trees, to connected components.

1. Each text becomes its set of distinct shingle hashes (64 bits; words are not compared again, so two
   shingles count as one with a chance of 2**-64 a pair). Equal sets fall together by digest; one
   representative stands for them.
2. Document frequencies are counted exactly, in packed form: tasks send sorted runs of hashes to
   the range of the hash space that counts them, and get back which are shared. A set can only
   link if at most a quarter of it is unshared, which leaves the near copies (a first pass over
   all texts counts half of the hash space, where the same bound holds).
3. The rest is ordered globally, rarest first. Two sets that link share an element within their
   prefixes, so sets connected by prefix elements make up coarse groups.
4. Each coarse group is joined by a trie of its ordered sets: a query set goes down level by level,
   the overlap of a path is shared by all sets below it, and a subtree is pruned once the overlap
   so far plus what remains on either side cannot reach the bound. Groups over `block` sets are cut
   into blocks, twice and differently; what is then outside the group's largest component is joined
   with all of that component, and among itself, in blocks that sizes allow.
5. Links (a spanning forest per block loses none) become components.

Null texts and texts without words have an empty set, link with nothing and are their own component.
Repeated rows are exact copies. Links are between texts: where one id has several texts, each of them
has the component of its own text, whose id is the smallest id of any row in it. A null id keeps its
row, with a null component, and gives its text no part in a link. Ids are whole numbers within 2**62
of zero. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import Forest, connected
from .textkit import begin, join_groups, materialize, mix64, shingle_hashes, slices, texts_of, words_by_row

_PACKET = "part bigint, tag bigint, kind int, blob binary"
_ELEMENT = np.dtype([("df", ">u4"), ("h", ">u8")])
_NAMES = ["part", "tag", "kind", "blob"]


def _needed(n, percent: int):
    """Elements that a set of n must share with another for a link."""
    return -(-percent * n // 100)


def _packets(rows: Iterable[tuple[list, list, np.ndarray, np.ndarray, list[bytes], list[np.ndarray]]], parts: int) -> Iterator[pa.RecordBatch]:
    """rows: (ids, text hashes, sizes, counted, digests, arrays to count) of up to 65,000 sets. Yields
    what the counting tasks need: per part the hashes with the row of each; and a head with the rest."""
    for k, (ids, marks, sizes, counted, digests, arrays) in enumerate(rows):
        tag = (TaskContext.get().partitionId() << 32) + k
        flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
        row = np.repeat(np.arange(len(arrays)), [len(x) for x in arrays]).astype("<u2")
        part = ((flat >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        flat, row, part = flat[order], row[order], part[order]
        found, starts = np.unique(part, return_index=True)
        ends = np.append(starts[1:], len(part))
        blobs = [flat[a:b].tobytes() + row[a:b].tobytes() for a, b in zip(starts, ends)]
        valid = np.array([x is not None for x in ids], np.uint8)
        head = np.array([x or 0 for x in ids], "<i8").tobytes() + valid.tobytes() + np.array(sizes, "<u4").tobytes() + np.array(counted, "<u4").tobytes() + np.array(marks, "<i8").tobytes() + b"".join(digests)
        columns = [[*found.tolist(), tag % parts], [tag] * (len(found) + 1), [1] * len(found) + [0], [*blobs, head]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], _NAMES)


def _count(full: bool):
    """Counting task: which hashes do two or more sets hold? Replies per tag; heads pass through."""

    def run(batches):
        tags, blobs = [], []
        for batch in batches:
            kinds = batch.column(2).to_numpy()
            if (head := batch.filter(pa.array(kinds == 0))).num_rows:
                yield head
            rest = batch.filter(pa.array(kinds == 1))
            tags += rest.column(1).to_pylist()
            blobs += rest.column(3).to_pylist()
        if not blobs:
            return
        sizes = [len(b) // 10 for b in blobs]
        flat = np.concatenate([np.frombuffer(b, "<u8", n) for b, n in zip(blobs, sizes)])
        row = np.concatenate([np.frombuffer(b, "<u2", n, 8 * n) for b, n in zip(blobs, sizes)])
        del blobs
        order = np.argsort(flat)
        ordered = flat[order]
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        runs = np.diff(np.append(first, len(ordered)))
        df = np.empty(len(flat), np.uint32)
        df[order] = np.repeat(runs, runs)
        at = 0
        for tag, n in zip(tags, sizes):
            shared = np.flatnonzero(df[at : at + n] > 1) + at
            at += n
            if not len(shared):
                continue
            if full:
                blob = flat[shared].astype("<u8").tobytes() + df[shared].astype("<u4").tobytes() + row[shared].astype("<u2").tobytes()
            else:
                rows, counts = np.unique(row[shared], return_counts=True)
                blob = rows.astype("<u2").tobytes() + counts.astype("<u4").tobytes()
            columns = [[0], [tag], [2], [blob]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], _NAMES)

    return run


def _by_tag(batches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes], list[bytes]]]:
    """(ids, valid, sizes, counted, text hashes, digests, replies) of each tag, from rows sorted by tag
    and kind."""
    tag, head, replies = None, None, []

    def unpacked():
        n = len(head) // 41
        cut = [0, 8 * n, 9 * n, 13 * n, 17 * n, 25 * n]
        ids, valid, sizes, counted, marks = (np.frombuffer(head[a:b], t) for a, b, t in zip(cut, cut[1:], ("<i8", "u1", "<u4", "<u4", "<i8")))
        return ids, valid.astype(bool), sizes, counted, marks, [head[25 * n + 16 * i : 25 * n + 16 * i + 16] for i in range(n)], replies

    for batch in batches:
        for t, kind, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if t != tag:
                if head is not None:
                    yield unpacked()
                tag, head, replies = t, None, []
            if kind == 0:
                head = blob
            else:
                replies.append(blob)
    if head is not None:
        yield unpacked()


def _exchange(packets: DataFrame, full: bool, parts: int) -> DataFrame:
    counted = packets.repartition(parts, "part").mapInArrow(_count(full), _PACKET)
    return counted.repartition(parts, "tag").sortWithinPartitions("tag", "kind")


def signatures(docs: DataFrame, *, width: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """(id, text_hash, n_shingles, digest, live): live where the set may link or has equal sets."""
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def rows(batches):
        begin("prefix_join")
        ids, marks, sizes, counted, digests, arrays, held = [], [], [], [], [], [], 0
        for batch in slices(batches):
            keys, hashes = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i, words in words_by_row(texts_of(batch.column(1))):
                whole = np.unique(shingle_hashes(words, width))
                half = whole[(whole & np.uint64(1)) == 0]
                ids.append(keys[i])
                marks.append(hashes[i])
                sizes.append(len(whole))
                counted.append(len(half))
                digests.append(hashlib.blake2b(whole.tobytes(), digest_size=16).digest())
                arrays.append(half)
                held += len(half)
                if held > 1 << 20 or len(ids) >= 60_000:
                    yield ids, marks, sizes, counted, digests, arrays
                    ids, marks, sizes, counted, digests, arrays, held = [], [], [], [], [], [], 0
        if ids:
            yield ids, marks, sizes, counted, digests, arrays

    def settle(batches):
        for ids, valid, sizes, counted, marks, digests, replies in _by_tag(batches):
            shared = np.zeros(len(ids), np.int64)
            for blob in replies:
                n = len(blob) // 6
                shared[np.frombuffer(blob, "<u2", n)] += np.frombuffer(blob, "<u4", n, 2 * n)
            sizes = sizes.astype(np.int64)
            live = (sizes > 0) & (counted - shared <= sizes - _needed(sizes, percent)) & valid
            columns = [pa.array(ids, pa.int64(), mask=~valid), pa.array(marks), pa.array(sizes), pa.array(digests, pa.binary()), pa.array(live)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "text_hash", "n_shingles", "digest", "live"])

    packets = docs.select(F.col(id_col).cast("bigint"), text_col, F.xxhash64(text_col)).mapInArrow(lambda b: _packets(rows(b), parts), _PACKET)
    return _exchange(packets, False, parts).mapInArrow(settle, "id bigint, text_hash bigint, n_shingles bigint, digest binary, live boolean")


def ordered_sets(docs: DataFrame, *, width: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """(id, n, elements, prefix): the shared elements of each set that may link, rarest first, as
    packed (document frequency, hash) pairs; prefix: how many of them a partner must meet."""
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def rows(batches):
        begin("prefix_join")
        ids, arrays, held = [], [], 0
        for batch in slices(batches):
            keys = batch.column(0).to_pylist()
            for i, words in words_by_row(texts_of(batch.column(1))):
                ids.append(keys[i])
                arrays.append(np.unique(shingle_hashes(words, width)))
                held += len(arrays[-1])
                if held > 1 << 20 or len(ids) >= 60_000:
                    yield ids, [0] * len(ids), [len(x) for x in arrays], [0] * len(ids), [b"\0" * 16] * len(ids), arrays
                    ids, arrays, held = [], [], 0
        if ids:
            yield ids, [0] * len(ids), [len(x) for x in arrays], [0] * len(ids), [b"\0" * 16] * len(ids), arrays

    def settle(batches):
        for ids, _, sizes, _, _, _, replies in _by_tag(batches):
            if not replies:
                continue
            lengths = [len(b) // 14 for b in replies]
            flat = np.concatenate([np.frombuffer(b, "<u8", n) for b, n in zip(replies, lengths)])
            df = np.concatenate([np.frombuffer(b, "<u4", n, 8 * n) for b, n in zip(replies, lengths)])
            row = np.concatenate([np.frombuffer(b, "<u2", n, 12 * n) for b, n in zip(replies, lengths)])
            order = np.lexsort((flat, df, row))
            flat, df, row = flat[order], df[order], row[order]
            cuts = np.searchsorted(row, np.arange(len(ids) + 1))
            out: list[list] = [[], [], [], []]
            for i, (doc_id, n) in enumerate(zip(ids.tolist(), sizes.tolist())):
                a, b = cuts[i], cuts[i + 1]
                prefix = (b - a) - _needed(n, percent) + 1
                if prefix > 0 and b > a:
                    elements = np.empty(b - a, _ELEMENT)
                    elements["df"], elements["h"] = df[a:b], flat[a:b]
                    for column, value in zip(out, (doc_id, n, elements.tobytes(), prefix)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.int32()))], ["id", "n", "elements", "prefix"])

    packets = docs.select(F.col(id_col).cast("bigint"), text_col).mapInArrow(lambda b: _packets(rows(b), parts), _PACKET)
    return _exchange(packets, True, parts).mapInArrow(settle, "id bigint, n bigint, elements binary, prefix int")


def _prefix_elements(batches):
    for batch in batches:
        tokens = [np.frombuffer(e, _ELEMENT, p)["h"].astype(np.uint64).view(np.int64) for e, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(tokens)), [len(t) for t in tokens]))), pa.array(np.concatenate(tokens) if tokens else [], pa.int64())], ["id", "token"])


class PrefixTree:
    """Radix trie over ordered sets of small integers, laid out level by level in flat arrays.

    An edge is cut where its sets' prefixes end, so that a path without a common element is left
    there, before the long rest is touched.
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, prefixes: np.ndarray):
        self.sets, self.sizes = sets, sizes
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        common = [0] * (len(order) + 1)
        for k in range(1, len(order)):
            a, b = sets[order[k - 1]], sets[order[k]]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            common[k] = int(differ[0]) if len(differ) else n
        levels: list[list[tuple]] = []
        # (first, end, depth, level): a run of sets in `order` that agree on their first `depth` elements
        todo = [(0, len(order), 0, 0, -1)]
        while todo:
            lo, hi, depth, level, parent = todo.pop()
            while len(levels) <= level:
                levels.append([])
            start = lo
            for k in range(lo + 1, hi + 1):
                if k < hi and common[k] > depth:
                    continue
                members = order[start:k]
                shortest = min(len(sets[i]) for i in members)
                reach = min([shortest, *common[start + 1 : k]])
                cut = int(max(prefixes[i] for i in members))
                if depth < cut < reach:
                    reach = cut
                here = [i for i in members if len(sets[i]) == reach]
                far = max(len(sets[i]) for i in members) - reach
                levels[level].append((parent, sets[members[0]][depth:reach], here, far, min(int(sizes[i]) for i in members)))
                if len(here) < len(members):
                    inner = start + len(here) if reach == shortest else start
                    todo.append((inner, k, reach, level + 1, len(levels[level]) - 1))
                start = k
        self.levels, self.single = [], []
        for nodes in levels:
            if not nodes:
                continue
            parent = np.array([x[0] for x in nodes])
            ends = np.cumsum([len(x[1]) for x in nodes])
            last = np.array([x[1][-1] if len(x[1]) else -1 for x in nodes], np.int64)
            owners = np.repeat(np.arange(len(nodes)), [len(x[2]) for x in nodes])
            held = np.array([i for x in nodes for i in x[2]], np.int64)
            self.levels.append((parent, np.concatenate([x[1] for x in nodes]), ends, last, np.array([x[3] for x in nodes]), np.array([x[4] for x in nodes]), owners, held))
            self.single.append(np.full(len(nodes), -1, np.int64))

    def settle(self, component: np.ndarray) -> None:
        """Note for every node which single component all its sets are in, or -1."""
        below: np.ndarray | None = None
        for k in range(len(self.levels) - 1, -1, -1):
            parent, _, _, _, _, _, owners, held = self.levels[k]
            low, high = np.full(len(parent), np.iinfo(np.int64).max), np.full(len(parent), -1, np.int64)
            np.minimum.at(low, owners, component[held])
            np.maximum.at(high, owners, component[held])
            if below is not None:
                up = self.levels[k + 1][0]
                np.minimum.at(low, up, below[0])
                np.maximum.at(high, up, below[1])
            below = low, high
            self.single[k] = np.where(low == high, low, -1)

    def partners(self, query: np.ndarray, size: int, percent: int, mark: np.ndarray, own: int = -2) -> np.ndarray:
        """Sets that link with the query, but for those in subtrees that settle() found to be all of
        component `own`; mark is a zeroed array over all elements."""
        mark[query] = 1
        found, active, overlap = [], None, None
        for k, (parent, elements, ends, last, far, least, owners, held) in enumerate(self.levels):
            if active is None:
                nodes = np.flatnonzero(self.single[k] != own)
                before = np.zeros(len(nodes), np.int64)
            else:
                alive = np.full(active[1], -1, np.int64)
                alive[active[0]] = overlap
                before = alive[parent]
                nodes = np.flatnonzero((before >= 0) & (self.single[k] != own))
                before = before[nodes]
            if not len(nodes):
                break
            starts = np.concatenate(([0], ends[:-1]))[nodes]
            lengths = ends[nodes] - starts
            total = np.concatenate(([0], np.cumsum(lengths)))
            if len(nodes) == len(parent):
                values = mark[elements]
            else:
                values = mark[elements[np.repeat(starts - total[:-1], lengths) + np.arange(total[-1])]]
            sums = np.concatenate(([0], np.cumsum(values)))
            so_far = before + sums[total[1:]] - sums[total[:-1]]
            here = np.full(len(parent), -1, np.int64)
            here[nodes] = so_far
            mine = here[owners]
            # 100 I >= p (n + m - I)  <=>  (100 + p) I >= p (n + m)
            hit = (mine >= 0) & ((100 + percent) * mine >= percent * (size + self.sizes[held]))
            found.append(held[hit])
            left = np.minimum(len(query) - np.searchsorted(query, last[nodes], side="right"), far[nodes])
            keep = ((100 + percent) * (so_far + left) >= percent * (size + least[nodes])) & (far[nodes] > 0)
            active, overlap = (nodes[keep], len(parent)), so_far[keep]
        mark[query] = 0
        return np.concatenate(found) if found else np.empty(0, np.int64)


def forest(ids: list, sizes: list[int], elements: list[bytes], prefixes: list[int], sides: list[int], roots: list, percent: int) -> list[tuple]:
    """A spanning forest of the links among the sets (sides all 0), or between sides 0 and 1, as
    stars around the smallest id.

    Sets of one root are in one component from the start. Sets that are in one component need no
    further link: subtrees of the query's own component are passed over, and the search ends when
    one component is left.
    """
    raw = [np.frombuffer(e, _ELEMENT) for e in elements]
    cuts = np.cumsum([0] + [len(x) for x in raw])
    hashes, df = (np.concatenate([x[f] for x in raw]).astype(t) for f, t in (("h", np.uint64), ("df", np.uint32)))
    kinds, first, codes = np.unique(hashes, return_index=True, return_inverse=True)
    rank = np.empty(len(kinds), np.int64)
    rank[np.lexsort((kinds, df[first]))] = np.arange(len(kinds))
    codes = rank[codes]
    sets = [codes[a:b] for a, b in zip(cuts, cuts[1:])]
    size, prefix, side = np.array(sizes, np.int64), np.array(prefixes, np.int64), np.array(sides)
    built = np.flatnonzero(side == 0)
    asking = np.flatnonzero(side == 1) if side.any() else built
    if not len(built) or not len(asking):
        return []
    tree = PrefixTree([sets[i] for i in built], size[built], prefix[built])
    mark, joined = np.zeros(len(kinds), np.int64), Forest()
    first_of: dict = {}
    for i, r in enumerate(roots):
        joined.join(i, first_of.setdefault(r, i))
    left, settled = len(first_of), len(sets)
    for turn, q in enumerate(asking.tolist()):
        if left <= 0.9 * settled:
            tree.settle(np.array([joined.root(i) for i in built.tolist()], np.int64))
            settled = left
        for j in built[tree.partners(sets[q], int(size[q]), percent, mark, joined.root(q) if settled < len(sets) else -2)].tolist():
            left -= joined.join(q, j)
        if left == 1:
            break
    least: dict[int, int] = {}
    for i in list(joined.up):
        r = joined.root(i)
        least[r] = min(ids[i], least.get(r, ids[i]))
    return [(ids[i], least[joined.root(i)]) for i in list(joined.up) if ids[i] != least[joined.root(i)]]


def _join_blocks(percent: int):
    def run(batches):
        key, held = None, []

        def joined():
            links = forest(*map(list, zip(*held)), percent) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for block, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if block != key:
                    if held:
                        yield joined()
                    key, held = block, []
                held.append(row)
        if held:
            yield joined()

    return run


_ROW = ["block", "id", "n", "elements", "prefix", "side", "root"]


def _within(placed: DataFrame, turn: int, block: int) -> DataFrame:
    """(block, id, side) that cut each group by a hash of the id into runs of about `block` sets; a
    small group is one run, in the first turn."""
    some = placed if turn == 0 else placed.where(F.col("members") > block)
    cut = F.pmod(F.xxhash64(F.lit(turn), "id"), F.ceil(F.col("members") / block))
    return some.select("id", F.struct("grp", F.lit(turn).cast("bigint").alias("x"), cut.alias("i"), F.lit(0).cast("bigint").alias("j")).alias("block"), F.lit(0).alias("side"), F.col("id").alias("root"))


def _against_main(placed: DataFrame, block: int) -> DataFrame:
    """Blocks for the sets of large groups that are outside their group's largest component: all
    cuts of that component which sizes allow."""
    main = placed.where("root = main").groupBy("grp", "cls").agg(F.ceil(F.count("*") / block).alias("cuts"))
    inside = placed.where("root = main").join(main, ["grp", "cls"])
    cut = F.pmod(F.xxhash64("id"), F.col("cuts"))
    # sizes of linking sets differ by a factor of at most 100 / percent: by one class or none
    near = placed.where("root <> main").withColumn("cls", F.explode(F.array(F.col("cls") - 1, F.col("cls"), F.col("cls") + 1))).join(main, ["grp", "cls"])
    near = near.withColumn("cut", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cuts") - 1)))
    place = lambda c: F.struct("grp", (100 + F.col("cls")).cast("bigint").alias("x"), c.alias("i"), F.lit(-1).cast("bigint").alias("j")).alias("block")
    return inside.select("id", place(cut), F.lit(0).alias("side"), "root").union(near.select("id", place(F.col("cut")), F.lit(1), "root"))


def _among_others(placed: DataFrame, block: int) -> DataFrame:
    """Blocks that pair all sets of large groups outside the largest components, as sizes allow."""
    placed = placed.where("root <> main")
    classes = placed.groupBy("grp", "cls").agg(F.ceil(F.count("*") / block).alias("cuts"))
    lower = classes.select("grp", (F.col("cls") + 1).alias("cls"), F.col("cuts").alias("below"))
    upper = classes.select("grp", (F.col("cls") - 1).alias("cls"), F.col("cuts").alias("above"))
    classes = classes.join(lower, ["grp", "cls"], "left").join(upper, ["grp", "cls"], "left")
    within = "transform(sequence(0L, cuts - 1), k -> named_struct('x', 2000 + 2L * cls, 'i', least(k, cut), 'j', greatest(k, cut), 'side', if(k < cut, 1, 0)))"
    up = "if(above is null, array(), transform(sequence(0L, above - 1), k -> named_struct('x', 2001 + 2L * cls, 'i', cut, 'j', k, 'side', 0)))"
    down = "if(below is null, array(), transform(sequence(0L, below - 1), k -> named_struct('x', 1999 + 2L * cls, 'i', k, 'j', cut, 'side', 1)))"
    rows = placed.join(classes, ["grp", "cls"]).withColumn("cut", F.pmod(F.xxhash64("id"), F.col("cuts")))
    rows = rows.select("id", "grp", "root", F.explode(F.expr(f"concat({within}, {up}, {down})")).alias("p"))
    return rows.select("id", F.struct("grp", "p.x", "p.i", "p.j").alias("block"), "p.side", "root")


def _links(places: DataFrame, sets: DataFrame, percent: int, parts: int) -> DataFrame:
    rows = places.join(sets, "id").select(*_ROW)
    links = rows.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(_join_blocks(percent), "a bigint, b bigint")
    return materialize(links, "links")


def _join_groups(sets: DataFrame, coarse: DataFrame, percent: int, parts: int, block: int) -> DataFrame:
    """(node, root): components of the sets' links.

    Two turns of runs within each group link what is alike: small groups whole, and large ones so
    far that near copies are one component each. What is outside a large group's largest component
    is then held against all of it and among itself, so a group of copies costs in proportion to
    its size, and no link is left out.
    """
    placed = sets.select("id", "n").join(coarse.withColumnsRenamed({"node": "id", "root": "grp"}), "id")
    placed = materialize(placed.join(placed.groupBy("grp").agg(F.count("*").alias("members")), "grp"), "placed")
    places = _within(placed, 0, block)
    large = placed.where(F.col("members") > block)
    any_large = bool(large.take(1))
    roots = connected(_links(places.union(_within(placed, 1, block)) if any_large else places, sets, percent, parts))
    if not any_large:
        return roots
    known = large.join(roots.withColumnsRenamed({"node": "id"}), "id", "left").withColumn("root", F.coalesce("root", "id"))
    sizes = known.groupBy("grp", "root").agg(F.count("*").alias("c"))
    main = sizes.groupBy("grp").agg(F.max(F.struct("c", "root"))["root"].alias("main"))
    known = known.withColumn("cls", F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent))))
    known = materialize(known.join(main, "grp"), "known")
    if not known.where("root <> main").take(1):
        return roots
    more = _links(_against_main(known, block).union(_among_others(known, block)), sets, percent, parts)
    return connected(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))


def _numbered(groups: DataFrame) -> tuple[DataFrame, bool]:
    """groups (rep, digest, ...) with `node`, a number of each one's own: rep, which is the smallest id
    with that text, or a number past all ids where an id stands for several texts. Also whether there
    is such an id."""
    often = groups.groupBy("rep").agg(F.count("*").alias("c")).where("c > 1")
    if not often.take(1):
        return groups.withColumn("node", F.col("rep")), False
    first = groups.join(often.select("rep"), "rep", "left_semi").groupBy("rep").agg(F.min("digest").alias("__first"), F.count("*").alias("__c"))
    past = groups.agg(F.max("rep")).first()[0] + 1
    own = F.when(F.col("__first").isNull() | (F.col("digest") == F.col("__first")), F.col("rep")).otherwise(F.lit(past) + F.monotonically_increasing_id())
    return materialize(join_groups(groups, first, "rep", "__c").withColumn("node", own).drop("__first", "__c"), "nodes"), True


def near_copies(docs: DataFrame, *, width: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", block: int = 256, detail: bool = False) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable by links). detail: also text_hash
    (xxhash64 of the text) and component, which is the same for the rows of one component alone
    (component_id is not, where an id has several texts).

    docs is to be a table (or rows derived one by one from it): its rows are counted in packets,
    which must come out alike when a task runs again on another executor.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    options = dict(width=width, percent=percent, id_col="id", text_col="text")
    signed = materialize(signatures(docs, **options), "signatures")
    able = signed.where("n_shingles > 0 and id is not null")
    groups = able.groupBy("digest").agg(F.min("id").alias("rep"), F.min_by("text_hash", "id").alias("text_hash"), F.max("live").alias("live"), F.count("*").alias("copies"))
    groups, shared = _numbered(materialize(groups.where("live or copies > 1"), "groups"))
    # equal sets are live together, for they share all; of each the text that stands for it is read again
    wanted = groups.where("live").select(F.col("rep").alias("__id"), F.col("text_hash").alias("__hash"), "node")
    wanted = wanted.hint("merge")  # it grows with the documents: one plan at every size
    live = docs.join(wanted, (F.col("id") == F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))).select(F.col("node").alias("id"), "text")
    if able.groupBy("id", "text_hash").agg(F.count("*").alias("c")).where("c > 1").take(1):
        live = live.dropDuplicates(["id"])  # repeated rows
    # packets are numbered by row, so a task that runs again must see its rows in the same order
    live = live.sortWithinPartitions("id")
    sets = materialize(ordered_sets(live, **options).where("id is not null"), "sets")
    tokens = sets.select("id", "elements", "prefix").mapInArrow(_prefix_elements, "id bigint, token bigint")
    tokens = materialize(tokens, "prefixes")
    least = tokens.groupBy("token").agg(F.min("id").alias("first"), F.count("*").alias("c")).where("c > 1")
    near = join_groups(tokens, least, "token", "c", how="inner").where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b")).distinct()
    coarse = materialize(connected(materialize(near, "coarse-edges")), "coarse")
    roots = _join_groups(sets, coarse, percent, parts, block)
    named = groups.join(roots.withColumnRenamed("root", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = materialize(named.select("digest", "copies", "rep", "component"), "classes")
    if shared:
        least = named.groupBy("component").agg(F.min("rep").alias("least"), F.count("*").alias("c"))
        named = join_groups(named, least, "component", "c").select("digest", "copies", "component", "least")
    else:
        named = named.select("digest", "copies", "component", F.col("component").alias("least"))
    out = join_groups(signed, named, "digest", "copies")
    whole = F.when(F.col("id").isNotNull(), F.coalesce("least", "id")).alias("component_id")
    # a text of no group is a component by itself, and so is each text without words
    own = F.coalesce(F.concat(F.lit("n"), "component"), F.when(F.col("n_shingles") > 0, F.concat(F.lit("d"), F.hex("digest"))), F.concat(F.lit("t"), "text_hash"))
    more = ["text_hash", own.alias("component")] if detail else []
    return out.select(F.col("id").alias(id_col), "n_shingles", whole, *more)
