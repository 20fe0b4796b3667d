"""The corpus pipeline against a brute-force version, and its contract."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import language_id
from tessera.llm.queries import word_bpe

from . import brute

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], DIR).cache())
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_columns(stages):
    for df in stages[:-1]:
        assert df.columns == stages[0].columns
    assert stages[-1].columns[0] == "doc_id"


def test_language_keeps_what_has_letters(stages):
    before, after = texts(stages[0]), texts(stages[1])
    assert after == {i: t for i, t in before.items() if t and language_id.has_letter(t.encode())}


def test_one_of_each_component_stays(stages):
    before, after = texts(stages[1]), texts(stages[2])
    roots, _ = brute.components(before.items())
    assert set(after) == {i for i, r in roots.items() if i == r}


def test_contaminated_documents_go(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    before, after = texts(stages[2]), texts(stages[3])
    bad = {i for i, t in before.items() for n, hit, _ in [brute.contamination(t, items)] if hit and 20 * hit >= n}
    assert set(after) == set(before) - bad


def test_secrets_are_replaced(stages):
    before, after = texts(stages[3]), texts(stages[4])
    assert set(before) == set(after)
    for i, text in before.items():
        spans = brute.base_spans(text)
        assert all(text[a:b] not in after[i] for a, _, b in spans)
        assert spans or "[SECRET]" in after[i] or after[i] == text


def test_encoding(stages):
    from tokenizers import Tokenizer

    library, before = Tokenizer.from_file(word_bpe()), texts(stages[4])
    rows = stages[5].collect()
    assert {r.doc_id for r in rows} == set(before)
    for r in rows:
        ids = np.array(library.encode(before[r.doc_id], add_special_tokens=False).ids, "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())


def test_run_equals_stages(spark, stages):
    assert corpus_pipeline.run(spark, DIR).exceptAll(stages[-1]).count() == 0


def test_edge_rows(spark):
    rows = [(None, "some words here", None, None, 3), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "some words here", None, "s", 3), (3, "some words here", None, "s", 3)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{DIR}/documents.parquet").schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
    assert sorted(r.doc_id or 0 for r in docs.collect()) in ([0, 3], [3])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        empty = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
        assert stage(spark, empty, DIR).count() == 0


def test_no_text_is_lost(spark):
    """Of every component of texts one row stays, also where ids repeat."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (7, b), (5, c), (9, c), (5, c), (5, b + " q"), (11, "one text of six words here"), (5, "one text of six words there"), (None, a), (5, "few"), (5, "few"), (5, "")]
    schema = spark.read.parquet(f"{DIR}/documents.parquet").schema
    docs = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in rows], schema)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs, DIR).collect()]
    assert len(got) == len(set(got))
    for some in ([(1, a)], [(5, b), (5, b + " q")], [(5, c)], [(11, rows[8][1])], [(5, rows[9][1])], [(5, "few")], [(5, "")], [(None, a)]):
        assert sum(x in got for x in some) == 1, some
    assert len(got) == 8


def test_languages_that_stay(spark, stages):
    """The first stage fills in what the operator predicts, which its own tests hold against brute force."""
    docs = stages[0]
    found = {r.doc_id: r.lang_pred for r in language_id.identify(docs, docs.where(~language_id.held_out())).collect()}
    given = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    for r in stages[1].select("doc_id", "lang").collect():
        assert r.lang == (given[r.doc_id] or found[r.doc_id])
