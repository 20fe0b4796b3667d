"""The corpus operators' queries: production parameters, whole tables, digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, host_quality, html_extract, language_id, minhash, oracles, periodic_runs, pivot_negatives, prefix_join, secret_scan, token_store, url_filter, warc
from .textkit import shared_dir


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), word_bpe())


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language_id.held_out())
    found = language_id.identify(docs, docs.where("not held_out"), carry=["held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, secret_scan.train(docs))
    counts = [F.size(k).cast("bigint").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secret_scan.shown("base"), 256).alias("base_sha256"), secret_scan.shown("spans").alias("spans"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.digest(decontaminate.contamination(docs, benchmark))


def op6_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_join.near_copies(table(spark, sf_dir, "documents"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "token-store")
    token_store.write_tokens(table(spark, sf_dir, "documents"), path, word_bpe(), end_id=1)
    return token_store.read_tokens(spark, path)


# The rules of the URL query.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op9_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = host_quality.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pages = shared_dir(spark, "warc"), table(spark, sf_dir, "pages")
    warc.write_archives(pages, path)
    return warc.lookup(pages, path)


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return pivot_negatives.hard_negatives(rows, F.col("vec_id") % 50 == 0)


def with_repetitions(docs: DataFrame) -> DataFrame:
    """The documents of the periodic-run query: where the crc32 of the id ends in 0, the words from some
    place on are repetitions of those that follow there."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    docs = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"), words.alias("w")).withColumn("n", F.size("w"))
    docs = docs.withColumn("g", F.expr("h div 10")).withColumn("a", F.expr("int(g % greatest(n, 1))")).withColumn("p", F.expr("int(1 + (n - a) div (3 + g % 8))"))
    tail = "slice(flatten(array_repeat(slice(w, a + 1, p), int(1 + (n - a) div p))), 1, n - a)"
    return docs.select("doc_id", F.expr(f"if(h % 10 = 0 and n > 0, array_join(concat(slice(w, 1, a), {tail}), ' '), text)").alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_repetitions(table(spark, sf_dir, "documents")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("x"), r.start.alias("start"), r.period.alias("period"))))
    found = found.withColumn("best", best).withColumn("length", -F.col("best.x"))
    shown = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), F.concat(r.period.cast("string"), F.lit("\n")))), "")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "length", "best.period",
        F.expr("1000 * length div best.period").alias("exponent_milli"), F.sha2(shown, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_html_extraction, op2_bpe, op3_language_id, op4_secret_scan, op5_decontamination, op6_prefix_join, op7_token_store, op8_url_filter, op9_host_quality, op10_warc, op11_minhash, op12_hard_negatives, op13_periodic_runs, pipeline)
}

# Merged bytes, learned languages and models, and markup are beyond SQL: tests hold those queries
# against brute force, an exact round trip or held-out accuracy.
ORACLES: dict[str, str] = {
    "op5_decontamination": oracles.OP5,
    "op6_prefix_join": oracles.OP6,
    "op8_url_filter": oracles.op8(URL_RULES, sorted(url_filter.TOPICS), sorted({*url_filter.TOPICS, *url_filter.MODIFIERS})),
    "op9_host_quality": oracles.OP9,
    "op10_warc": oracles.OP10,
    "op11_minhash": oracles.OP11,
    "op12_hard_negatives": oracles.OP12,
    "op13_periodic_runs": oracles.OP13,
}
