"""Quality rules by host: rule failures per domain, shrunk towards an empirical beta prior.

Rule figures are computed per text and written once. Failures are summed by host (partial sums
before the shuffle, so a hot host is no more than one row per task), a beta prior is fitted to the
hosts' rates by moments, and a host whose shrunk rate passes `max_rate` fails all its documents.
Host verdicts come back by a join on slim rows: hosts with more than a thousandth of all rows are
broadcast, the others shuffled.

A null text has no words and fails; a null host is a host of its own; repeated rows count as often
as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import begin, join_groups, materialize, shingle_hashes, slices, texts_of, type_name, words_by_row

_OUTSIDE_WORDS = bytes([9, 10, 11, 12, 13, 32, *range(0x80, 0xC0)])  # white space; bytes that continue a character
_SYMBOLS = b"#*$%&|<>"


def repeated_words(words: np.ndarray, width: int = 5) -> int:
    """Words inside windows of `width` words that occur twice or more in the text."""
    if len(words) <= width:
        return 0
    _, back, counts = np.unique(shingle_hashes(words, width), return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[back] > 1)
    if not len(starts):
        return 0
    gaps = np.minimum(np.diff(starts), width)
    return int(gaps.sum()) + width


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def figures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per row: id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        begin("host_quality")
        for batch in slices(batches):
            texts = texts_of(batch.column(2))
            rows = np.zeros((len(texts), 5), np.int64)
            for i, words in words_by_row(texts, fold=False):
                text = texts[i] or b""
                symbols = len(text) - len(text.translate(None, _SYMBOLS))
                rows[i] = len(words), len(text.translate(None, _OUTSIDE_WORDS)), symbols, duplicate_lines(text), repeated_words(words)
            failed = (rows[:, 0] < 10) | (100 * rows[:, 4] > 20 * rows[:, 0])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, rows.T), pa.array(failed)], ["id", "host", *names, "base_failed"])

    columns = [F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(text_col).alias("text")]
    schema = f"id {type_name(docs, id_col)}, host {type_name(docs, host_col)}, " + ", ".join(f"{n} bigint" for n in names) + ", base_failed boolean"
    return docs.select(*columns).mapInArrow(run, schema)


def host_rates(rows: DataFrame) -> DataFrame:
    """(host, n, failed, rate): rate shrunk by a beta prior that is fitted to all hosts."""
    hosts = rows.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("bigint")).alias("failed"))
    hosts = materialize(hosts, "hosts")
    p = F.col("failed") / F.col("n")
    fit = hosts.agg(F.sum("n"), F.sum("failed"), F.count("*"), F.avg(p), F.var_pop(p), F.avg(1 / F.col("n"))).first()
    n, failed, count, centre, spread, inverse = (float(x or 0) for x in fit)
    mean = min(max(failed / n if n else 0.5, 1e-6), 1 - 1e-6)
    between = max(spread - mean * (1 - mean) * inverse, 1e-9)  # the hosts' own variance, without what few rows add
    weight = min(max(mean * (1 - mean) / between - 1, 2.0), 1e6)
    return hosts.withColumn("rate", (F.col("failed") + weight * mean) / (F.col("n") + weight))


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = 0.5) -> DataFrame:
    """Figures of every row with host_rate and kept: neither the rules nor the host's rate fail it."""
    rows = materialize(figures(docs, id_col=id_col, text_col=text_col, host_col=host_col), "figures")
    rates = host_rates(rows).select("host", "n", F.col("rate").alias("host_rate"))
    out = join_groups(rows, rates, "host", "n").drop("n")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= max_rate)).withColumnRenamed("id", id_col).withColumnRenamed("host", host_col)
