"""MinHash near-duplicates: many universal hash minima, banding, signature verification, components.

1. Each text becomes its set of distinct shingles, and the set a signature: for each of `HASHES`
   universal functions h(x) = (a x + b mod 2**64) >> 32 the least value over the set. Texts with equal
   words fall together by digest; one stands for them.
2. A signature is cut into bands of `ROWS` minima. Texts with an equal band share a bucket; two texts
   at the threshold share none of the 32 with a chance below 1e-7.
3. Every text of a bucket is held against the bucket's first: their signatures must agree in so many
   places that a pair at the threshold fails with a chance below 1e-9, and what passes is confirmed
   on the full sets of shingles, word by word. Confirmed links become components by alternating
   large-star and small-star.
4. Buckets that then still hold several components are compared fully, but only across components:
   signatures in blocks of about `block` texts, and the full sets of those texts alone that have a
   candidate in their block. A large bucket's main component is cut into blocks against the others,
   so a group of copies costs in proportion to its size. No pairs are listed and nothing is capped.

Null texts and texts without words have an empty set, link with nothing and are their own component.
Repeated rows are exact copies, and each is kept or not as its id is. Links are between texts: where
one id has several texts, each has the component of its own text. A null id keeps its row, with a null
component, and gives its text no part in a link. Very long texts are hashed whole, and blocks are cut by
the number of shingles too. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import Forest, connected
from .textkit import begin, join_groups, materialize, mix64, shingle_hashes, slices, texts_of, words_by_row

HASHES, ROWS = 128, 4
BANDS = HASHES // ROWS
#: Shingles of a block of texts, about.
HELD = 2_000_000

_KEY = ["h", "kind", "i", "j"]
_BLOCK = "h bigint, kind int, i bigint, j bigint, node bigint, side int, root bigint"


def coefficients(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """a and b of the universal functions."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 64, HASHES, np.uint64), rng.integers(0, 1 << 64, HASHES, np.uint64)


def minima(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The signatures (32-bit minima) of some non-empty sets of 64-bit hashes."""
    flat = np.concatenate(sets) >> np.uint64(32)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out, values = np.empty((len(sets), HASHES), np.uint32), np.empty_like(flat)
    for k in range(HASHES):
        np.multiply(flat, a[k], out=values)
        np.add(values, b[k], out=values)
        out[:, k] = np.minimum.reduceat(values, starts) >> np.uint64(32)
    return out


def least_agreement(percent: int, lost: float = 1e-9) -> int:
    """The largest number of equal minima that a pair of just `percent` similarity reaches but for a
    chance of `lost`."""
    p, total = percent / 100, 0.0
    for k in range(HASHES + 1):
        total += comb(HASHES, k) * p**k * (1 - p) ** (HASHES - k)
        if total > lost:
            return k
    return HASHES


def band_hashes(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each band, whose lowest bits are the band's number."""
    wide = np.ascontiguousarray(signatures).view("<u4").reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    out = np.zeros((len(signatures), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = mix64(out ^ (wide[:, :, k] * np.uint64(0x9E3779B97F4A7C15)))
    return (out - out % np.uint64(BANDS)) | np.arange(BANDS, dtype=np.uint64)


def _unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, HASHES)


def signatures(docs: DataFrame, *, width: int = 4) -> DataFrame:
    """docs: (id, text). Returns (id, mark, n_shingles, digest, signature); mark is xxhash64 of the text,
    digest one of its words, and a text without words has no digest and no signature."""
    a, b = coefficients()

    def run(batches):
        begin("minhash")
        for batch in slices(batches):
            texts = texts_of(batch.column(1))
            sets = [np.unique(shingle_hashes(words, width)) for _, words in words_by_row(texts)]
            digests = [hashlib.blake2b(b" ".join(t.lower().split()), digest_size=16).digest() if len(s) else None for t, s in zip(texts, sets)]
            signed: list[bytes | None] = [None] * len(sets)
            some, held = [], 0
            for k, s in enumerate(sets):
                if len(s):
                    some.append(k)
                    held += len(s)
                if some and (held > 1 << 14 or k == len(sets) - 1):
                    for i, row in zip(some, minima([sets[i] for i in some], a, b)):
                        signed[i] = row.astype("<u4").tobytes()
                    some, held = [], 0
            columns = [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(signed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "mark", "n_shingles", "digest", "signature"])

    return docs.select("id", "text", F.xxhash64("text")).mapInArrow(run, "id bigint, mark bigint, n_shingles bigint, digest binary, signature binary")


def _bands(batches):
    for batch in batches:
        if batch.num_rows:
            hashes = band_hashes(_unpacked(batch.column(1))).view(np.int64).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(hashes), batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), BANDS)))], ["h", "node"])


def _agreeing(least: int):
    """(node, first, signature, signature of first): the pairs whose signatures agree often enough."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                agree = (_unpacked(batch.column(2)) == _unpacked(batch.column(3))).sum(axis=1) >= least
                yield batch.select([0, 1]).filter(pa.array(agree))

    return run


def _stars(members: DataFrame, signed: DataFrame, least: int) -> DataFrame:
    """(node, first): texts and firsts of their buckets, where the signatures allow a link."""
    pairs = members.where("node <> first").select("node", "first").distinct()
    pairs = materialize(pairs.join(signed, "node"), "stars")
    hubs = pairs.groupBy("first").agg(F.count("*").alias("c"))
    hubs = materialize(hubs.join(signed.select(F.col("node").alias("first"), F.col("signature").alias("other")), "first"), "hubs")
    # the signatures of firsts with more than a thousandth of all pairs are broadcast: 512 bytes each
    both = join_groups(pairs, hubs, "first", "c", how="inner").select("node", "first", "signature", "other")
    return materialize(both.mapInArrow(_agreeing(least), "node bigint, first bigint"), "verified")


def _star_blocks(verified: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """Blocks of a first (side 0) with some of its texts (side 1)."""
    hubs = verified.join(sizes, "node").groupBy("first").agg(F.count("*").alias("c"), F.sum("n_shingles").alias("held"))
    hubs = materialize(hubs.withColumn("cuts", F.ceil(F.greatest(F.col("c") / block, F.col("held") / HELD))).drop("held"), "cuts")
    key = lambda cut: [F.col("first").alias("h"), F.lit(0).alias("kind"), cut.cast("bigint").alias("i"), F.lit(0).cast("bigint").alias("j")]
    cut = join_groups(verified, hubs, "first", "c", how="inner").select(*key(F.pmod(F.xxhash64("node"), F.col("cuts"))), "node", F.lit(1).alias("side"), F.col("node").alias("root"))
    own = hubs.withColumn("cut", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cuts") - 1)))
    return own.select(*key(F.col("cut")), F.col("first").alias("node"), F.lit(0).alias("side"), F.col("first").alias("root")).union(cut)


def exact_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The distinct shingles of each text as numbers that are equal where all words are equal."""
    known: dict[bytes, int] = {}
    words = [[known.setdefault(w, len(known) + 1) for w in t.lower().split()] for t in texts]
    words = [w + [0] * (width - len(w)) if w else w for w in words]  # no word has number 0
    ends = np.cumsum([len(w) for w in words])
    flat = np.array([x for w in words for x in w], np.uint64)
    bits = np.uint64(max(1, len(known).bit_length()))
    codes = flat
    for k in range(1, width):
        if int(bits) * width > 64:  # pairs are numbered anew, so that two numbers always fit
            _, codes = np.unique(codes, return_inverse=True)
            codes, shift = codes.astype(np.uint64), np.uint64(32)
        else:
            shift = bits
        codes = (codes[: len(flat) - k] << shift) | flat[k:]
    return [np.unique(codes[e - len(w) : e - width + 1]) if w else codes[:0] for w, e in zip(words, ends.tolist())]


def confirmed(nodes: list[int], sides: list[int], roots: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets (sides all 0) or between sides 0 and 1, for sets
    of different roots."""
    side = np.array(sides)
    built = np.flatnonzero(side == 0)
    asking = np.flatnonzero(side == 1) if side.any() else built
    if not len(built) or not len(asking):
        return []
    sizes = np.array([len(s) for s in sets], np.int64)
    codes = np.concatenate([sets[i] for i in built])
    owners = np.repeat(np.arange(len(built)), sizes[built])
    order = np.argsort(codes, kind="stable")
    codes, owners = codes[order], owners[order]
    forest, links = Forest(), []
    first: dict[int, int] = {}
    for k, r in enumerate(roots):
        forest.join(k, first.setdefault(r, k))
    left = len(first)
    for q in asking.tolist():
        if left == 1:
            break
        lo, hi = np.searchsorted(codes, sets[q], "left"), np.searchsorted(codes, sets[q], "right")
        counts = hi - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        common = np.bincount(owners[at], minlength=len(built))
        for i in built[100 * common >= percent * (sizes[built] + sizes[q] - common)].tolist():
            if forest.join(i, q):
                left -= 1
                links.append((nodes[i], nodes[q]))
    return links


def _by_block(batches, width: int):
    """Rows of each block, from rows sorted by block; `width` columns make up its key."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:width] != key:
                if held:
                    yield key, held
                key, held = row[:width], []
            held.append(row[width:])
    if held:
        yield key, held


def _confirm(width: int, percent: int):
    def run(batches):
        for _, rows in _by_block(batches, len(_KEY)):
            nodes, sides, roots, texts = zip(*{row[0]: row for row in rows}.values())
            links = confirmed(nodes, sides, roots, exact_sets([t.encode() for t in texts], width), percent) if len(set(roots)) > 1 else []
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _links(blocks: DataFrame, docs: DataFrame, named: DataFrame, repeated: bool, width: int, percent: int, name: str) -> DataFrame:
    """The links that the full sets of the texts in each block confirm."""
    docs = docs.dropDuplicates(["id", "text"]) if repeated else docs
    rows = blocks.join(named, "node").hint("merge")  # it grows with the documents: one plan at every size
    rows = docs.join(rows, (F.col("id") == F.col("rep")) & (F.xxhash64("text") == F.col("mark"))).select(*_KEY, "node", "side", "root", "text")
    rows = rows.repartition(*_KEY).sortWithinPartitions(*_KEY)
    return materialize(rows.mapInArrow(_confirm(width, percent), "a bigint, b bigint"), name)


def _open_buckets(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(h, node, first, root, c): the members of buckets that hold several components."""
    rooted = members.where("c > 2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("c")
    rooted = materialize(rooted, "rooted")
    several = rooted.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c"))
    several = materialize(several.where("lo <> hi").drop("lo", "hi"), "several")
    return materialize(join_groups(rooted, several, "h", "c", how="inner"), "open")


def _bucket_blocks(rows: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """Blocks that hold each pair of a bucket's texts that are in different components."""
    rows = rows.join(sizes, "node")
    parts = rows.groupBy("h", "root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("held"))
    buckets = parts.groupBy("h").agg(F.sum("n").alias("c"), F.sum("held").alias("held"), F.max_by(F.struct("root", "n", "held"), F.struct("n", "root")).alias("m"))
    cuts = lambda n, held: F.greatest(F.lit(1), F.ceil(F.greatest(n / block, held / HELD))).cast("bigint")
    buckets = buckets.select("h", "c", F.col("m.root").alias("main"), cuts(F.col("c"), F.col("held")).alias("all"), cuts(F.col("m.n"), F.col("m.held")).alias("cuts_main"), cuts(F.col("c") - F.col("m.n"), F.col("held") - F.col("m.held")).alias("cuts_rest"))
    rows = materialize(join_groups(rows.drop("c"), materialize(buckets, "buckets"), "h", "c", how="inner"), "placed")
    zero, hashed = F.lit(0).cast("bigint"), F.xxhash64("node")
    until = lambda n: F.sequence(zero, F.col(n) - 1)
    place = lambda kind, i, j, side: [F.col("h"), F.lit(kind).alias("kind"), i.cast("bigint").alias("i"), j.cast("bigint").alias("j"), F.col("node"), side.cast("int").alias("side"), F.col("root"), F.col("first")]
    small, large = rows.where("all = 1"), rows.where("all > 1")
    out = small.select(*place(1, zero, zero, zero))
    main = large.where("root = main").withColumn("cut", F.pmod(hashed, "cuts_main")).withColumn("other", F.explode(until("cuts_rest")))
    rest = large.where("root <> main").withColumn("cut", F.pmod(hashed, "cuts_rest"))
    among = rest.withColumn("other", F.explode(until("cuts_rest")))
    rest = rest.withColumn("other", F.explode(until("cuts_main")))
    out = out.union(main.select(*place(2, F.col("cut"), F.col("other"), zero)))
    out = out.union(rest.select(*place(2, F.col("other"), F.col("cut"), F.lit(1))))
    return out.union(among.select(*place(3, F.least("cut", "other"), F.greatest("cut", "other"), F.col("other") < F.col("cut"))))


def _candidates(least: int):
    """Of each block the texts that have a partner there: of another component, not the bucket's first,
    with agreeing signatures and no equal band before the bucket's, for there they meet as well."""

    def run(batches):
        for key, rows in _by_block(batches, len(_KEY)):
            nodes, sides, roots, firsts, packed = zip(*rows)
            values = np.frombuffer(b"".join(packed), "<u4").reshape(-1, HASHES)
            side, root, node = np.array(sides), np.array(roots), np.array(nodes)
            built = np.flatnonzero(side == 0)
            asking = np.flatnonzero(side == 1) if side.any() else built
            hit = np.zeros(len(nodes), bool)
            band, first = key[0] & (BANDS - 1), firsts[0]
            built = built[node[built] != first]
            for q in asking[node[asking] != first].tolist():
                some = built[root[built] != root[q]]
                equal = values[some] == values[q]
                some, equal = some[close := equal.sum(axis=1) >= least], equal[close]
                bands = equal.reshape(-1, BANDS, ROWS).all(axis=2)
                some = some[~bands[:, :band].any(axis=1)]
                hit[some] = True
                hit[q] |= bool(len(some))
            found = np.flatnonzero(hit).tolist()
            columns = [[k] * len(found) for k in key] + [[x[i] for i in found] for x in (nodes, sides, roots)]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [*_KEY, "node", "side", "root"])

    return run


def near_duplicates(docs: DataFrame, *, width: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = 256) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable by links), kept (whether the id is
    that one; a null id is kept)."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    signed = materialize(signatures(docs, width=width), "signatures")
    able = signed.where("n_shingles > 0 and id is not null")
    groups = able.groupBy("digest").agg(F.min("id").alias("rep"), F.min_by("mark", "id").alias("mark"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    groups = materialize(groups.withColumn("node", F.monotonically_increasing_id()), "texts")
    named, sizes, signature = groups.select("node", "rep", "mark"), groups.select("node", "n_shingles"), groups.select("node", "signature")
    repeated = bool(able.groupBy("id", "mark").agg(F.count("*").alias("c")).where("c > 1").take(1))

    bands = signature.mapInArrow(_bands, "h bigint, node bigint")
    shared = materialize(bands.groupBy("h").agg(F.min("node").alias("first"), F.count("*").alias("c")).where("c > 1"), "buckets")
    members = materialize(join_groups(bands, shared, "h", "c", how="inner"), "members")
    least = least_agreement(percent)
    verified = _stars(members, signature, least)
    links = _links(_star_blocks(verified, sizes, block), docs, named, repeated, width, percent, "star-links")
    roots = connected(links)
    opened = _open_buckets(members, roots)
    if opened.take(1):
        blocks = _bucket_blocks(opened, sizes, block).join(signature.hint("merge"), "node").select(*_KEY, "node", "side", "root", "first", "signature")
        blocks = blocks.repartition(*_KEY).sortWithinPartitions(*_KEY)
        blocks = materialize(blocks.mapInArrow(_candidates(least), _BLOCK), "candidates")
        if blocks.take(1):
            more = _links(blocks, docs, named, repeated, width, percent, "bucket-links")
            roots = connected(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))

    known = roots.join(named.select("node", "rep"), "node")
    smallest = known.groupBy("root").agg(F.min("rep").alias("least"), F.count("*").alias("c"))
    known = join_groups(known, materialize(smallest, "smallest"), "root", "c", how="inner").select("node", "least")
    whole = groups.select("node", "digest", "rep", "copies").join(known, "node", "left").where("copies > 1 or least is not null")
    whole = materialize(whole.select("digest", "copies", F.coalesce("least", "rep").alias("least")), "classes")
    out = join_groups(signed.select("id", "n_shingles", "digest"), whole, "digest", "copies")
    component = F.when(F.col("id").isNotNull(), F.coalesce("least", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
