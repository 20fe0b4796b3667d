"""From raw documents to token ids: language, near copies, benchmark passages, secrets, encoding.

Every stage reads what its predecessor wrote and keeps the columns of `documents`, but for the
last. A null text is an empty one and is rejected with the texts that have no letter; rows with a
null id pass through; of rows that repeat an id and its text one stays. Where one id has several
texts, each is judged by itself: of every component of texts one row stays, so no text is lost whose
near copies are all gone. An empty table gives an empty result. Further columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, language_id, prefix_join, secret_scan
from tessera.llm.queries import table, word_bpe
from tessera.llm.textkit import materialize, shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go; where no language is given, the predicted one is filled in."""
    docs = docs.select(*COLUMNS)
    labelled = docs.where(~language_id.held_out())
    found = language_id.identify(docs, labelled, carry=COLUMNS[1:])
    found = found.where((F.col("lang_pred") != "und") | F.col("text").rlike(r"\p{L}"))  # no labels: no languages
    return found.withColumn("lang", F.coalesce("lang", F.nullif("lang_pred", F.lit("und")))).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies one row with its smallest id stays."""
    docs = docs.select(*COLUMNS).withColumn("__hash", F.xxhash64("text"))
    found = materialize(prefix_join.near_copies(docs, detail=True), "components")
    gone = found.where("doc_id <> component_id").select("doc_id", "text_hash")
    often = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    repeated = bool(often.take(1))
    if repeated:  # of several texts of one id in one component the one with the least hash stays
        heads = found.where("doc_id = component_id").join(often, "doc_id", "left_semi")
        least = heads.groupBy("doc_id", "component").agg(F.min("text_hash").alias("least"))
        gone = gone.union(heads.join(least, ["doc_id", "component"]).where("text_hash <> least").select("doc_id", "text_hash"))
    gone = gone.distinct().withColumnRenamed("text_hash", "__hash").hint("merge")  # it grows with the documents
    kept = docs.join(gone, ["doc_id", "__hash"], "left_anti")
    if not repeated:
        return kept.select(*COLUMNS)
    once = kept.join(often, "doc_id", "left_semi").dropDuplicates(["doc_id", "__hash"])
    return kept.join(often, "doc_id", "left_anti").select(*COLUMNS).union(once.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more of the words are benchmark passages go."""
    found = decontaminate.contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), carry=COLUMNS[2:])
    return decontaminate.judged(found).where("not contaminated").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay."""
    docs = docs.select(*COLUMNS)
    found = secret_scan.scan(docs, secret_scan.train(docs))
    clean = secret_scan.redacted(found)
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return bpe.encode_decode(docs, word_bpe())


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("encoding", encoding),
]

# No SQL learns languages or merges bytes: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
