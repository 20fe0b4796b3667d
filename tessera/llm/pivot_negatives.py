"""Hard negatives by a pivot table over augmented vectors.

Components are multiplied by `scale` and floored, so that inner products are whole numbers. A row y
is augmented by sqrt(M - |y|**2), where M is the largest squared norm, and an anchor x by 0: then
|x' - y'|**2 = |x|**2 + M - 2 <x, y>, and large inner products are small distances.

1. Pivots are chosen farthest-first from `sample` rows (those of the least hash of the id); the
   distances of every row to all pivots are stored with it: the pivot table.
2. Anchors meet rows in blocks, each of at most about `rows` rows and `anchors` anchors; a block's
   rows are sorted by pivot distance and taken in groups. The triangle inequality brackets the
   scores first of groups, then of rows: what cannot be in a window of scores, or among the best,
   is passed over. Survivors are checked exactly.
3. The best of every block are merged to the best of all: first an anchor's positives among the
   rows of its label, in blocks of that label; then for each positive the hard negatives, in a grid
   of all anchors' and all rows' blocks.

Rows with a null id, label or vector, or a component that is null or not finite take no part. Rows that
repeat an id, label and vector count once; where one id has several vectors, each is a row, and other
rows are those of another id. Ties go by the smaller id. Shorter vectors are filled up with zeros.
Components stay within 2**52 and scores within 2**63, where they would be larger. An empty table, or
one without anchors, gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textkit import begin, join_groups, materialize

PIVOTS, GROUP = 8, 64
_LIMIT = 1 << 52
_GRID = ["label", "i", "j"]


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers as bytes, in as few each as suffice; the first byte says how many."""
    top = int(np.abs(values).max(initial=0))
    size = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
    return bytes([size]) + values.astype(f"<i{size}").tobytes()


def _matrix(packed: list[bytes]) -> np.ndarray:
    rows = [np.frombuffer(b, f"<i{b[0]}", offset=1) for b in packed]
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for k, row in enumerate(rows):
        out[k, : len(row)] = row
    return out


def _floored(scale: float):
    def run(batches):
        begin("pivot_negatives")
        for batch in batches:
            vectors = [np.clip(np.floor(scale * np.array(v, float)), -_LIMIT, _LIMIT).astype(np.int64) for v in batch.column(2).to_pylist()]
            norms = [sum(int(x) ** 2 for x in v) if np.abs(v).max(initial=0) >= 1 << 26 else int(v @ v) for v in vectors]
            columns = [batch.column(0), batch.column(1), batch.column(3), pa.array([_packed(v) for v in vectors], pa.binary()), pa.array([float(n) for n in norms], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "anchor", "v", "norm"])

    return run


def choose_pivots(vectors: np.ndarray, top: float) -> np.ndarray:
    """Some of the augmented vectors, each farthest from those chosen before."""
    augmented = np.hstack([vectors, np.sqrt(np.maximum(top - (vectors**2).sum(axis=1), 0))[:, None]])
    chosen, near = [0], np.full(len(vectors), np.inf)
    while len(chosen) < min(PIVOTS, len(vectors)):
        near = np.minimum(near, ((augmented - augmented[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(near.argmax()))
    return augmented[chosen]


def distances(vectors: np.ndarray, last: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of augmented vectors (the last component apart) to every pivot."""
    wide = max(vectors.shape[1], pivots.shape[1] - 1)
    vectors = np.pad(vectors, ((0, 0), (0, wide - vectors.shape[1])))
    out = np.empty((len(vectors), len(pivots)))
    for k, p in enumerate(pivots):
        rest = np.pad(p[:-1], (0, wide - len(p) + 1))
        out[:, k] = np.sqrt(((vectors - rest) ** 2).sum(axis=1) + (last - p[-1]) ** 2)
    return out


def pivot_table(rows: DataFrame, *, scale: float, sample: int) -> tuple[DataFrame, np.ndarray, float]:
    """rows: (id, label, vector, anchor). Returns the table (row, id, label, anchor, v, distances), the pivots and M."""
    whole = "id is not null and label is not null and vector is not null and not exists(vector, x -> x is null or isnan(x) or abs(x) = double('inf'))"
    some = rows.where(whole).select("id", "label", "vector", "anchor").mapInArrow(_floored(scale), "id bigint, label bigint, anchor boolean, v binary, norm double")
    some = materialize(some, "vectors")
    if some.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").take(1):
        some = materialize(some.dropDuplicates(["id", "label", "v"]), "vectors")
    top = float(some.agg(F.max("norm")).first()[0] or 0)
    drawn = some.orderBy(F.xxhash64("id"), "id", "v").limit(sample).select("v").collect()  # bounded by `sample`
    pivots = choose_pivots(_matrix([bytes(r.v) for r in drawn]), top) if drawn else np.zeros((1, 1))

    def run(batches):
        for batch in batches:
            vectors = _matrix(batch.column(3).to_pylist())
            far = distances(vectors, np.sqrt(np.maximum(top - (vectors**2).sum(axis=1), 0)), pivots)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([d.astype("<f8").tobytes() for d in far], pa.binary())], ["id", "label", "anchor", "v", "distances"])

    table = some.mapInArrow(run, "id bigint, label bigint, anchor boolean, v binary, distances binary")
    return materialize(table.withColumn("row", F.monotonically_increasing_id()), "pivot-table"), pivots, top


class Block:
    """The rows of a block, sorted by pivot distance and cut into groups."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, packed: list[bytes], far: np.ndarray, top: float):
        nearest = far.argmin(axis=1)
        order = np.lexsort((far[np.arange(len(far)), nearest], nearest))
        self.ids, self.labels, self.far, self.top = ids[order], labels[order], far[order], top
        self.vectors = _matrix([packed[k] for k in order.tolist()])
        self.big = float(np.abs(self.vectors).max(initial=0))
        cuts = np.arange(0, len(order), GROUP)
        self.low, self.high = np.minimum.reduceat(self.far, cuts), np.maximum.reduceat(self.far, cuts)
        self.ends = np.append(cuts, len(order))
        self.exact = 0

    def _scores(self, norm: float, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest score that distances between near and far allow."""
        slack = 1e-9 * (norm + self.top) + 1  # far beyond the rounding of the distances
        return (norm + self.top - far**2) / 2 - slack, (norm + self.top - near**2) / 2 + slack

    def bracket(self, query: np.ndarray, norm: float, lo: float, hi: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, least, largest score) of the rows whose score may be within lo and hi."""
        near = np.maximum(np.maximum(query - self.high, self.low - query), 0).max(axis=1)
        least, largest = self._scores(norm, near, (query + self.high).min(axis=1))
        groups = np.flatnonzero((largest >= lo) & (least <= hi))
        if not len(groups):
            return groups, near[:0], near[:0]
        sizes = self.ends[groups + 1] - self.ends[groups]
        at = np.repeat(self.ends[groups] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        far = self.far[at]
        least, largest = self._scores(norm, np.abs(far - query).max(axis=1), (far + query).min(axis=1))
        keep = (largest >= lo) & (least <= hi)
        return at[keep], least[keep], largest[keep]

    def scores(self, vector: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact inner products with some rows."""
        self.exact += len(at)
        wide = min(len(vector), self.vectors.shape[1])
        rows, vector = self.vectors[at, :wide], vector[:wide]
        if self.big * float(np.abs(vector).max(initial=0)) * wide < _LIMIT:
            return (rows @ vector).astype(np.int64)
        whole = [sum(int(a) * int(b) for a, b in zip(r, vector)) for r in rows.tolist()]
        return np.array([max(-(1 << 63), min((1 << 63) - 1, x)) for x in whole], np.int64)


def _kth(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> list[int]:
    return np.lexsort((ids, -scores))[:k].tolist()


def positives(block: Block, anchor: int, vector: np.ndarray, query: np.ndarray, norm: float, k: int) -> list[tuple[int, int]]:
    """(id, score) of an anchor's k best other rows in a block of its label."""
    at, least, largest = block.bracket(query, norm, -np.inf, np.inf)
    other = block.ids[at] != anchor
    at, least, largest = at[other], least[other], largest[other]
    at = at[largest >= _kth(least, k)]
    scores, ids = block.scores(vector, at), block.ids[at]
    return [(int(ids[x]), int(scores[x])) for x in _best(scores, ids, k)]


def negatives(block: Block, anchor: int, label: int, vector: np.ndarray, query: np.ndarray, norm: float, windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
    """For each window (lo, hi) of scores (id, score) of the block's k best rows of other labels in it."""
    at, least, largest = block.bracket(query, norm, min(w[0] for w in windows), max(w[1] for w in windows))
    other = (block.labels[at] != label) & (block.ids[at] != anchor)
    at, least, largest = at[other], least[other], largest[other]
    need = np.zeros(len(at), bool)
    for lo, hi in windows:
        sure = _kth(least[(least >= lo) & (largest <= hi)], k)
        need |= (largest >= max(lo, sure)) & (least <= hi)
    at = at[need]
    scores, ids = block.scores(vector, at), block.ids[at]
    out = []
    for lo, hi in windows:
        inside = np.flatnonzero((scores >= lo) & (scores <= hi))
        out.append([(int(ids[inside[x]]), int(scores[inside[x]])) for x in _best(scores[inside], ids[inside], k)])
    return out


def _blocks(batches) -> Iterator[list[tuple]]:
    """Rows of each block, without its key, from rows sorted by block."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:3] != key:
                if held:
                    yield held
                key, held = row[:3], []
            held.append(row[3:])
    if held:
        yield held


def _parts(rows: list[tuple], pivots: np.ndarray, top: float):
    """The block's rows, and its anchors with their vectors, distances and squared norms."""
    some = [r for r in rows if r[0] == 0]
    asking = [r for r in rows if r[0] == 1]
    if not some or not asking:
        return None
    block = Block(np.array([r[2] for r in some]), np.array([r[3] for r in some]), [r[4] for r in some], np.stack([np.frombuffer(r[5], "<f8") for r in some]), top)
    vectors = _matrix([r[4] for r in asking])
    queries = distances(vectors, np.zeros(len(vectors)), pivots)
    return block, list(zip(asking, vectors, queries, (vectors**2).sum(axis=1).tolist()))


def _find_positives(pivots: np.ndarray, top: float, k: int):
    def run(batches):
        for rows in _blocks(batches):
            out = []
            if parts := _parts(rows, pivots, top):
                for (_, row, anchor, *_), vector, query, norm in parts[1]:
                    out += [(row, *x) for x in positives(parts[0], anchor, vector, query, norm, k)]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(3)], ["row", "positive_id", "positive_score"])

    return run


def _find_negatives(pivots: np.ndarray, top: float, k: int, low: int, high: int):
    def run(batches):
        for rows in _blocks(batches):
            out = []
            if parts := _parts(rows, pivots, top):
                for (_, row, anchor, label, _, _, found), vector, query, norm in parts[1]:
                    # low s <= 100 t <= high s
                    windows = [(-(-low * p["positive_score"] // 100), high * p["positive_score"] // 100) for p in found]
                    for p, best in zip(found, negatives(parts[0], anchor, label, vector, query, norm, windows, k)):
                        out += [(row, anchor, p["place"], p["positive_id"], p["positive_score"], *x) for x in best]
            names = ["row", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(7)], names)

    return run


def _first(rows: DataFrame, by: list[str], score: str, tie: str, k: int, place: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), tie)
    return rows.withColumn(place, F.row_number().over(order)).where(F.col(place) <= k)


def _grid(rows: DataFrame, anchors: DataFrame, side: list[str]) -> DataFrame:
    """Rows (side 0) and anchors (side 1) by block: `cuts` of rows times `parts` of anchors for each label;
    rows are repeated for each part and anchors for each cut."""
    zero, hashed = F.lit(0).cast("bigint"), F.xxhash64("row")
    until = lambda n: F.explode(F.sequence(zero, F.col(n) - 1))
    left = rows.withColumn("j", F.pmod(hashed, "cuts")).withColumn("i", until("parts")).withColumn("side", F.lit(0))
    right = anchors.withColumn("i", F.pmod(hashed, "parts")).withColumn("j", until("cuts")).withColumn("side", F.lit(1))
    columns = ["i", "j", "side", "row", "id", "own", "v", "distances", *side]
    rows = left.select("label", *columns).unionByName(right.select("label", *columns))
    return rows.repartition(*_GRID).sortWithinPartitions(*_GRID)


def _ceil(count: str, size: int) -> Column:
    return F.ceil(F.greatest(F.col(count), F.lit(1)) / size)


def hard_negatives(
    table: DataFrame, anchor: Column, *, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: float = 256, best: int = 5, negatives: int = 3, low: int = 50, high: int = 95, sample: int = 1000, rows: int = 8192, anchors: int = 1024
) -> DataFrame:
    """For each row where `anchor` holds and each of its `best` positives (highest inner product, same
    label) the first `negatives` rows of other labels whose score is `low` to `high` hundredths of
    the positive's: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    given = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    stored, pivots, top = pivot_table(given, scale=scale, sample=sample)
    stored = stored.withColumn("own", F.col("label"))

    labels = stored.groupBy("label").agg(F.count("*").alias("c"), F.count_if("anchor").alias("asking")).where("asking > 0")
    labels = materialize(labels.select("label", "c", _ceil("c", rows).alias("cuts"), _ceil("asking", anchors).alias("parts")), "labels")
    placed = join_groups(stored, labels, "label", "c", how="inner")
    blocks = _grid(placed, placed.where("anchor"), [])
    found = blocks.mapInArrow(_find_positives(pivots, top, best), "row bigint, positive_id bigint, positive_score bigint")
    found = materialize(_first(found, ["row"], "positive_score", "positive_id", best, "place"), "positives")
    # a negative score has no window
    windows = found.where("positive_score >= 0").groupBy("row").agg(F.collect_list(F.struct("place", "positive_id", "positive_score")).alias("windows"))  # `best` at most

    asking = materialize(stored.where("anchor").join(windows, "row"), "anchors")
    cuts, parts = -(-max(stored.count(), 1) // rows), -(-max(asking.count(), 1) // anchors)
    numbers = {"label": F.lit(0).cast("bigint"), "cuts": F.lit(cuts).cast("bigint"), "parts": F.lit(parts).cast("bigint")}
    none = F.lit(None).cast(windows.schema["windows"].dataType)
    blocks = _grid(stored.withColumns({**numbers, "windows": none}), asking.withColumns(numbers), ["windows"])
    schema = "row bigint, anchor_id bigint, place bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
    found = materialize(blocks.mapInArrow(_find_negatives(pivots, top, negatives, low, high), schema), "negatives")
    found = _first(found, ["row", "place"], "negative_score", "negative_id", negatives, "rank")
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
