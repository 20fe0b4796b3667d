"""MinHash near duplicates, hard negatives and periodic runs against plain versions."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import minhash, periodic_runs, pivot_negatives, queries

from . import brute

TEXTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def words(rng, n):
    return [rng.choice("river stone quick lazy house tree night table salt wind green paper".split()) + str(rng.randrange(300)) for _ in range(n)]


def changed(rng, text, n):
    out = list(text)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"new{rng.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def copies():
    """Groups of near copies at all distances around the threshold, chains of copies of copies, copies
    that differ in case and white space, short texts, and texts without words."""
    rng, rows = random.Random(3), []
    for _ in range(6):
        base = words(rng, 150)
        rows += [base, base] + [changed(rng, base, k) for k in (1, 2, 3, 4, 5, 6, 7, 8, 9)]
        for _ in range(4):
            base = changed(rng, base, 4)
            rows.append(base)
    texts = [" ".join(r) for r in rows] + ["one two", "ONE\ttwo ", "one", "a b c d", "a b c d e", "a b c e", None, "", " \n", " ".join(words(rng, 30_000))]
    return list(enumerate(texts, 100))


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_minhash_equals_brute_force(spark, copies):
    got = by_id(minhash.near_duplicates(spark.createDataFrame(copies, TEXTS).repartition(3)))
    roots, sizes = brute.components(copies, 4, 80)
    assert {i: (r.component_id, r.n_shingles, r.kept) for i, r in got.items()} == {i: (roots[i], sizes[i], roots[i] == i) for i in roots}
    assert len(set(roots.values())) < len(roots) - 20


def test_minhash_small_blocks_lose_no_link(spark):
    # one bucket of many texts that differ from its first: only the blocks find their links
    rng = random.Random(8)
    base = words(rng, 120)
    groups = [changed(rng, base, 9) for _ in range(12)]
    rows = [" ".join(changed(rng, g, 2)) for g in groups for _ in range(5)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    roots, _ = brute.components(rows, 4, 80)
    docs = spark.createDataFrame(rows, TEXTS)
    for block in (4, 1000):
        assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, block=block).collect()} == roots
    assert 1 < len(set(roots.values())) < len(rows)


def test_minhash_blocks_meet_all_pairs_of_components(spark):
    rows = [(5, n, 0, n % 3, 10) for n in range(40)] + [(6, n, 0, 50 + (n > 2), 10) for n in range(4)]
    opened = spark.createDataFrame([(h, n, f, r, 40 if h == 5 else 4) for h, n, f, r, _ in rows], "h bigint, node bigint, first bigint, root bigint, c bigint")
    sizes = spark.createDataFrame([(n, 10) for n in range(40)], "node bigint, n_shingles bigint")
    blocks = {}
    for r in minhash._bucket_blocks(opened, sizes, 4).collect():
        blocks.setdefault((r.h, r.kind, r.i, r.j), []).append((r.node, r.side, r.root))
    met = set()
    for (h, *_), held in blocks.items():
        among = all(s == 0 for _, s, _ in held)
        met |= {(h, a, b) for a, s, r in held for b, t, q in held if r != q and a < b and (among or s != t)}
    assert met == {(h, a, b) for h, a, _, r, _ in rows for g, b, _, q, _ in rows if h == g and a < b and r != q}
    assert max(map(len, blocks.values())) <= 24


def test_minhash_odd_rows(spark, copies):
    text, other = copies[0][1], "some other text that stands by itself here"
    rows = [(1, text), (1, text), (None, text), (2, other), (2, text + " more"), (7, other), (None, None), (3, None)]
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, TEXTS)).collect())
    assert got == [(-1, -1, True), (-1, -1, True), (1, 1, True), (1, 1, True), (2, 1, False), (2, 2, True), (3, 3, True), (7, 2, False)]
    assert minhash.near_duplicates(spark.createDataFrame([], TEXTS)).count() == 0
    clash = spark.createDataFrame([r for r in rows if r[0]], TEXTS).withColumns({c: F.lit("x") for c in ("id", "node", "digest", "h", "first", "component_id", "n_shingles")})
    assert minhash.near_duplicates(clash).columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert minhash.near_duplicates(clash).count() == 6


def test_minima_estimate_similarity():
    rng = np.random.default_rng(1)
    a, b = minhash.coefficients()
    whole = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    one, two = minhash.minima([whole[:2000], whole[400:2400]], a, b)
    assert abs((one == two).mean() - 2 / 3) < 0.13
    assert minhash.least_agreement(80) < 0.66 * minhash.HASHES
    assert [int(x) % minhash.BANDS for x in minhash.band_hashes(np.stack([one]))[0]] == list(range(minhash.BANDS))


def test_exact_sets_compare_words():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in (0, 1, 3, 4, 5, 40, 60)] + [" ".join(words(rng, 70_000))]
    for some in (texts, texts[:-1]):
        sets = minhash.exact_sets([t.encode() for t in some], 4)
        plain = [brute.shingles(t, 4) for t in some]
        assert [len(s) for s in sets] == [len(s) for s in plain]
        for x, p in zip(sets, plain):
            for y, q in zip(sets, plain):
                assert len(np.intersect1d(x, y)) == len(p & q)


def vectors(seed, n, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dim))
    return [(i, [float(x) for x in (centres[i % 4] + 0.7 * rng.normal(size=dim)).astype(np.float32)], int(i % 4)) for i in range(n)]


def plain(rows, anchors):
    whole = [(i, l, [int(np.floor(256 * float(x))) for x in v]) for i, v, l in rows if None not in (i, v, l) and all(x is not None and np.isfinite(x) for x in v)]
    return brute.hard_negatives(whole, anchors)


def mined(df, anchor, **options):
    return sorted(tuple(r) for r in pivot_negatives.hard_negatives(df, anchor, **options).collect())


def test_hard_negatives_equal_brute_force(spark):
    rows = vectors(5, 300)
    rows += [(1000 + k, rows[k][1], rows[k][2]) for k in range(40)]  # ties
    rows += [(2000, None, 1), (2001, rows[0][1], None), (2002, [None] + rows[0][1][1:], 1), (2003, [float("nan")] * 16, 1), (2004, [float("inf")] * 16, 2), (2005, [0.0] * 16, 9), (None, rows[0][1], 2)]
    df, anchor = spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 5 == 0
    expected = plain(rows, {i for i, _, _ in rows if i is not None and i % 5 == 0})
    assert len(expected) > 500
    assert mined(df, anchor) == expected
    assert mined(df, anchor, rows=50, anchors=7, sample=20) == expected  # many blocks
    assert mined(df, anchor, rows=100, anchors=1000, sample=1) == expected


def test_hard_negatives_odd_rows(spark):
    rows = vectors(6, 60)
    df = spark.createDataFrame(rows, VECTORS)
    anchor = F.col("vec_id") % 5 == 0
    expected = plain(rows, set(range(0, 60, 5)))
    assert mined(df.union(df), anchor) == expected  # repeated rows count once
    clash = df.withColumns({c: F.lit(7) for c in ("id", "row", "v", "side", "i", "j", "cuts", "anchor", "windows")})
    assert mined(clash, anchor) == expected
    assert mined(df.limit(0), anchor) == [] and mined(df, F.lit(False)) == [] and mined(df, F.lit(None).cast("boolean")) == []
    wide = [(i, [float(np.float32(1e6 * x)) for x in v] + [0.0] * (i % 3), l) for i, v, l in rows]  # other lengths, large numbers
    assert mined(spark.createDataFrame(wide, VECTORS), anchor) == plain(wide, set(range(0, 60, 5)))
    assert all(len(r) == 6 for r in mined(spark.createDataFrame([(i, [float(3e38 * np.sign(x)) for x in v], l) for i, v, l in rows], VECTORS), anchor))


def test_brackets_hold_and_prune():
    rows = np.array([[int(256 * x) for x in v] for _, v, _ in vectors(7, 800)], float)
    top = float((rows**2).sum(axis=1).max())
    pivots = pivot_negatives.choose_pivots(rows, top)
    far = pivot_negatives.distances(rows, np.sqrt(top - (rows**2).sum(axis=1)), pivots)
    block = pivot_negatives.Block(np.arange(800), np.zeros(800, int), [pivot_negatives._packed(r.astype(np.int64)) for r in rows], far, top)
    for anchor in range(0, 800, 40):
        x = rows[anchor]
        query = pivot_negatives.distances(x[None], np.zeros(1), pivots)[0]
        at, least, largest = block.bracket(query, float(x @ x), -np.inf, np.inf)
        true = block.vectors[at] @ x
        assert len(at) == 800 and (least <= true).all() and (true <= largest).all()
        lo = float(np.sort(true)[-20])
        some, _, _ = block.bracket(query, float(x @ x), lo, np.inf)
        assert set(block.ids[at[true >= lo]]) <= set(block.ids[some])
        found = pivot_negatives.positives(block, -1, x, query, float(x @ x), 5)
        assert [s for _, s in found] == sorted(true.astype(int).tolist())[::-1][:5]
    assert block.exact < 20 * 800  # not every row is checked


def test_runs_equal_brute_force():
    rng, seen = random.Random(4), 0
    for _ in range(150):
        texts = []
        for _ in range(rng.randrange(1, 5)):
            text = [rng.choice("abcdefgh"[: rng.choice([1, 2, 3, 8])]).encode() for _ in range(rng.randrange(90))]
            for _ in range(rng.randrange(4)):
                if text:
                    a, c = rng.randrange(len(text)), rng.randrange(len(text) + 1)
                    text[c:c] = text[a : rng.randrange(a, len(text)) + 1] * rng.randrange(1, 4)
            texts.append(text[:400])
        for least in (4, 12):
            expected = [brute.runs(t, least) for t in texts]
            seen += sum(map(len, expected))
            assert periodic_runs.runs_of(texts, least) == expected
    assert seen > 3000


def test_longest_previous_factors_and_blocks():
    text = b"abababcabababcxabab"
    symbols = np.array(list(text))
    order, levels = periodic_runs.doubled_ranks(symbols)
    assert [text[i:] for i in order] == sorted(text[i:] for i in range(len(text)))
    length, source = periodic_runs.longest_previous(order, levels)
    for i in range(len(text)):
        best = max((n for n in range(len(text) - i + 1) if text.find(text[i : i + n], 0, i + n - 1) >= 0), default=0) if i else 0
        assert length[i] == best
        assert not best or (source[i] < i and text[source[i] :].startswith(text[i : i + best]))
    assert periodic_runs.blocks(length, 0, len(text)) == [0, 1, 2, 6, 7, 14, 15]


@pytest.fixture(scope="module")
def periodic(spark):
    rng = random.Random(6)
    line = words(rng, 9)
    rows = [(1, None), (2, ""), (3, " \n "), (4, " ".join(line * 3)), (5, "\n".join([" ".join(line)] * 7)), (6, " ".join(words(rng, 40) + line * 2 + words(rng, 9))), (7, "a " * 30), (8, "a b " * 5 + "a"), (9, "x " * 11), (None, "b " * 12), (4, " ".join(line * 3))]
    rows += [(k, " ".join(words(rng, rng.randrange(200)))) for k in range(20, 80)] + [(90, " ".join(words(rng, 3000) * 40 + ["é", "É"] * 9))]
    return rows


def test_run_query_equals_brute_force(spark, periodic, monkeypatch):
    docs = spark.createDataFrame(periodic, TEXTS).repartition(3)
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    got = sorted((tuple(r) for r in queries.op13_periodic_runs(spark, "").collect()), key=repr)
    expected = []
    for doc_id, text in periodic:
        text = text if doc_id is None else " ".join(brute.repeated_words(doc_id, text))
        w = brute.WORD.findall(text)
        found = brute.runs(w) if doc_id != 90 else [(0, 120_000, 3000), (120_000, 18, 2)]
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        best = min(((-n, s, q) for s, n, q in found), default=None)
        best = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        expected.append((doc_id, len(found), *best, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    assert got == sorted(expected, key=repr)
    assert sum(e[1] for e in expected) > 10


def test_runs_odd_tables(spark, periodic):
    docs = spark.createDataFrame(periodic, TEXTS)
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0
    clash = docs.withColumns({c: F.lit("x") for c in ("id", "runs", "collapsed", "n_words", "words", "start")})
    some = lambda df: sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in df.collect())
    assert some(periodic_runs.periodic_runs(clash)) == some(periodic_runs.periodic_runs(docs))
    named = docs.select(F.col("doc_id").cast("string").alias("key"), F.col("text").alias("body"))
    assert periodic_runs.periodic_runs(named, id_col="key", text_col="body").schema["key"].dataType == T.StringType()
