"""Sources: libsvm, CSV, rating triples, token corpora and arrays, as DataFrames.

Sparse rows are (row_id, label, indices array<int>, values array<double>), indices ascending and
from 0; the long form is (row_id, fid, value).
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructType

from .storage import materialize


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are not empty, comments or indented, numbered from 0 in file order."""
    kept = spark.read.text(path).where("value <> '' and not startswith(value, '#') and not startswith(value, ' ')")
    return numbered(kept)


def numbered(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Add consecutive numbers in partition order: sizes of partitions first, then offsets, so that
    no row moves. For scans and what follows them row by row, whose partitions are the same in
    every run; a sort draws its ranges anew."""
    tagged = df.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    sizes = {r["__p"]: r["count"] for r in tagged.groupBy("__p").count().collect()}  # one row per partition
    offsets, at = {}, 0
    for p in sorted(sizes):
        offsets[p] = at
        at += sizes[p]
    if not offsets:
        return df.withColumn(name, F.lit(None).cast("bigint"))
    start = F.element_at(F.from_json(F.lit("{" + ",".join(f'"{p}":{o}' for p, o in offsets.items()) + "}"), "map<string,bigint>"), F.col("__p").cast("string"))
    return tagged.withColumn(name, start + F.col("__i").bitwiseAND(F.lit((1 << 33) - 1))).drop("__p", "__i")


def shard(df: DataFrame, rank: int, total: int, by: Column | str = "row_id") -> DataFrame:
    """The rows that a worker of `total` gets when rows are dealt in turn."""
    return df.where(F.pmod(F.col(by) if isinstance(by, str) else by, F.lit(total)) == rank)


def _label(text: Column, neg_y: bool) -> Column:
    label = text.cast("double")
    return F.when(label == 1, label).otherwise(F.lit(-1.0)) if neg_y else label


def read_libsvm(spark: SparkSession, path: str, *, neg_y: bool = False, one_based: bool = True, rank: int = 0, total: int = 1) -> DataFrame:
    """`label idx:val ...` lines to sparse rows; a field that is no pair fails the query."""
    parts = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
    pairs = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.split(x, ":"))
    rows = shard(_lines(spark, path), rank, total).withColumn("pairs", pairs).withColumn("label", _label(F.element_at(parts, 1), neg_y))
    bad = F.exists("pairs", lambda p: (F.size(p) != 2) | F.get(p, 1).try_cast("double").isNull())
    index = lambda p: F.when(bad, F.raise_error(F.concat(F.lit("cannot parse: "), F.col("value"))).cast("int")).otherwise(F.get(p, 0).cast("int") - int(one_based))
    return rows.select("row_id", "label", F.transform("pairs", index).alias("indices"), F.transform("pairs", lambda p: F.get(p, 1).cast("double")).alias("values"))


def read_csv(spark: SparkSession, path: str, *, neg_y: bool = False, rank: int = 0, total: int = 1) -> DataFrame:
    """`label,f1,f2,...` lines without a header to dense rows; an empty field is NaN."""
    parts = F.split("value", ",", -1)
    rows = shard(_lines(spark, path), rank, total)
    features = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.when(F.trim(x) == "", F.lit(float("nan"))).otherwise(x.cast("double")))
    return rows.select("row_id", _label(F.element_at(parts, 1), neg_y).alias("label"), features.alias("features"))


def read_coo(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace `u v r` lines to (u, v, r)."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(parts[0].cast("int").alias("u"), parts[1].cast("int").alias("v"), parts[2].cast("double").alias("r"))


def read_corpus(spark: SparkSession, path: str, *, skip: int = 1, rank: int = 0, total: int = 1) -> DataFrame:
    """`docId wordId wordId ...` lines to (doc_id, pos, word_id); `skip` leading fields are no words."""
    parts = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
    rows = shard(_lines(spark, path), rank, total).select(F.col("row_id").alias("doc_id"), F.posexplode(F.slice(parts, skip + 1, F.greatest(F.size(parts) - skip, F.lit(0)))).alias("pos", "word"))
    return rows.select("doc_id", "pos", F.col("word").cast("int").alias("word_id"))


def read_dataset(spark: SparkSession, path: str, data_format: str = "libsvm", **options) -> DataFrame:
    readers = {"libsvm": read_libsvm, "csv": read_csv}
    if data_format not in readers:
        raise ValueError(f"no such format: {data_format}")
    return readers[data_format](spark, path, **options)


def from_csr(spark: SparkSession, indices: Sequence[int], indptr: Sequence[int], values: Sequence[float], labels: Sequence[float] | None = None) -> DataFrame:
    """Compressed sparse rows in memory to sparse rows."""
    if labels is not None and len(labels) != len(indptr) - 1:
        raise ValueError("as many labels as rows are needed")
    rows = [(i, float(labels[i]) if labels is not None else None, [int(x) for x in indices[a:b]], [float(x) for x in values[a:b]]) for i, (a, b) in enumerate(zip(indptr, indptr[1:]))]
    return spark.createDataFrame(rows, "row_id bigint, label double, indices array<int>, values array<double>")


def from_coo(spark: SparkSession, rows: Sequence[int], cols: Sequence[int], values: Sequence[float]) -> DataFrame:
    return spark.createDataFrame([(int(u), int(v), float(r)) for u, v, r in zip(rows, cols, values)], "u int, v int, r double")


def from_dense(df: DataFrame, features: str = "features") -> DataFrame:
    """Dense rows to sparse rows; NaN counts as missing."""
    kept = [c for c in df.columns if c != features]

    def run(batches):
        for batch in batches:
            dense = batch.column(len(kept))
            sizes = np.nan_to_num(dense.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            values = dense.flatten().to_numpy(zero_copy_only=False)  # null as NaN
            place, some = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes), ~np.isnan(values)
            row = np.repeat(np.arange(len(sizes)), sizes)[some]
            ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(sizes))))), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, x, mask=dense.is_null()) for x in (pa.array(place[some], pa.int32()), pa.array(values[some], pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *lists], [*kept, "indices", "values"])

    schema = df.select(*kept).schema.add("indices", ArrayType(IntegerType())).add("values", ArrayType(DoubleType()))
    return df.select(*kept, F.col(features).cast("array<double>")).mapInArrow(run, schema)


def to_long(rows: DataFrame, keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """Sparse rows to the long form."""
    return rows.select(*keep, F.explode(F.arrays_zip("indices", "values")).alias("e")).select(*keep, F.col("e.indices").alias("fid"), F.col("e.values").alias("value"))


def to_sparse_rows(long: DataFrame, key: str = "row_id") -> DataFrame:
    """The long form to sparse rows, indices ascending."""
    pairs = F.array_sort(F.collect_list(F.struct("fid", "value")))
    return long.groupBy(key).agg(pairs.alias("p")).select(key, F.col("p.fid").alias("indices"), F.col("p.value").alias("values"))


#: Rows of a range, about: what a task sorts at once.
RANGE_ROWS = 1 << 20
#: Tokens of a block of documents, about; a document is in one block.
BLOCK_TOKENS = 1 << 20
#: Of those that are numbered, which are sent to tasks whole.
NUMBERED_TOKENS = 1 << 18


def ranges(df: DataFrame, key: str, rows: int, folders: bool = False) -> tuple[DataFrame, list[int]]:
    """df in sorted ranges of a key, written once, with each row's range `__p` and place in it `__i`; and where
    each range starts, and the last one ends. rows: how many there are, so that a range has a bounded
    number; folders: whether each range has a folder of its own, so that a filter on `__p` reads no other."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE_ROWS))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = df.repartitionByRange(parts, F.col(key)).sortWithinPartitions(key).withColumn("__p", F.spark_partition_id()).withColumn("__i", place)
    dealt = materialize(dealt, "ranges", ["__p"] if folders else None)
    sizes = {r["__p"]: r["count"] for r in dealt.groupBy("__p").count().collect()}  # one row per range
    starts = [0]
    for p in range(max(sizes, default=-1) + 1):
        starts.append(starts[-1] + sizes.get(p, 0))
    return dealt, starts


def ranked(df: DataFrame, key: str, name: str = "row_id", rows: int | None = None) -> DataFrame:
    """Add consecutive numbers from 0 in the order of a key without repeats: sorted ranges of the key
    are written once, and a range's numbers begin at the sum of the sizes before it."""
    dealt, starts = ranges(df, key, df.count() if rows is None else rows)
    return dealt.withColumn(name, start_of(starts) + F.col("__i")).drop("__p", "__i")


def start_of(starts: list[int]) -> Column:
    """Where a row's range starts."""
    return F.get(F.from_json(F.lit(str(starts)), "array<bigint>"), F.col("__p"))


def _sums(value: str):
    """Add `__p`, a row's partition, and `__sum`, the sum of a value over the rows before it there."""

    def work(batches):
        at = 0
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(value)).fill_null(0).to_numpy(zero_copy_only=False)
            sums = at + np.cumsum(values)
            columns = [*batch.columns, pa.array(np.full(len(sums), TaskContext.get().partitionId(), np.int32)), pa.array(sums - values)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "__p", "__sum"])
            at = sums[-1] if len(sums) else at

    return work


def running(df: DataFrame, key: str | list[str], value: str, name: str) -> DataFrame:
    """Add the sum of `value`, a bigint, over all smaller keys, of which none repeats: sorted ranges of the key are
    summed up where they are, and begin at the sums of those before."""
    schema = StructType.fromJson(df.schema.jsonValue()).add("__p", IntegerType()).add("__sum", LongType())
    keys = [F.col(k) for k in ([key] if isinstance(key, str) else key)]
    dealt = materialize(df.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_sums(value), schema), "ranges")
    sums = {r["__p"]: r["s"] for r in dealt.groupBy("__p").agg(F.sum(value).alias("s")).collect()}  # one row per range
    starts, at = [], 0
    for p in sorted(sums):
        starts.append((p, at))
        at += sums[p]
    start = F.broadcast(df.sparkSession.createDataFrame(starts, "__p int, __s bigint"))
    return dealt.join(start, "__p").withColumn(name, F.col("__sum") + F.col("__s")).drop("__p", "__s", "__sum")


def corpus_index(tokens: DataFrame) -> DataFrame:
    """(word_id, n, first): counts per word and where its run starts in word-major order."""
    counts = tokens.groupBy("word_id").agg(F.count("*").alias("n"))
    return running(counts, "word_id", "n", "first")


def _placed(runs: DataFrame) -> DataFrame:
    """Runs with `key`, `first` and the places in order to a row for each token."""
    placed = running(runs.withColumn("n", F.size("p").cast("bigint")), "key", "n", "start")
    out = placed.select("doc_id", "word_id", "first", "start", F.posexplode("p").alias("i", "pos"))
    return out.select("doc_id", "pos", "word_id", (F.col("first") + F.col("pos")).alias("doc_at"), (F.col("start") + F.col("i")).alias("word_at"))


def letter_runs(text: pa.Array) -> pa.ListArray:
    """The runs of a-z of each text (null: none)."""
    text = text.fill_null("")
    ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int32)
    data = np.frombuffer(text.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.empty(0, np.uint8)
    ends = ends - ends[0]
    letter = data - np.uint8(97) < 26
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    heads = ends[:-1][ends[:-1] < len(data)]
    begins[heads] = letter[heads]
    chars, starts = data[letter], np.flatnonzero(begins)
    places = np.append(np.flatnonzero(begins[letter]), len(chars)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(chars))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, ends), pa.int32()), words)


def _block(table: pa.Table, ids: np.ndarray, number: int) -> dict:
    """Documents of ascending ids side by side: each word once (`words`, `n` times), and tokens by their number in it."""
    words = table["words"].chunk(0)
    sizes = words.value_lengths().fill_null(0).to_numpy()
    heads = np.flatnonzero(np.diff(ids, prepend=-1))
    coded = words.flatten().dictionary_encode()
    word, pos = coded.indices.to_numpy(), None
    if len(heads) < len(ids):  # rows that share an id: token by token
        pos = (np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        order = np.lexsort((pos, np.repeat(ids, sizes)))
        word, pos = word[order], pos[order]
    return {"block": number, "total": len(word), "doc_id": table["doc_id"].chunk(0).take(pa.array(heads)), "size": np.add.reduceat(sizes, heads).astype(np.int32), "pos": pos, "word": word, "words": coded.dictionary, "n": np.bincount(word, minlength=len(coded.dictionary))}


def _blocks(tokens: int, schema: pa.Schema):
    """Sorted documents (doc_id, words) to blocks of some number of tokens; no id is in two of them."""

    def work(batches):
        number, rest = TaskContext.get().partitionId() << 33, None
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                table = rest
            else:
                words = batch.column(1) if pa.types.is_list(batch.schema.types[1]) else letter_runs(batch.column(1))
                table = pa.table([batch.column(0), words], ["doc_id", "words"])
                table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
            if table is None or not len(table):
                continue
            ids = np.cumsum(np.diff(table["doc_id"].chunk(0).dictionary_encode("encode").indices.to_numpy(), prepend=-1) != 0) - 1
            sizes = table["words"].chunk(0).value_lengths().fill_null(0).to_numpy()
            heads = np.flatnonzero(np.diff(ids, prepend=-1))
            before = (np.cumsum(sizes) - sizes)[heads]
            cuts = [*heads[np.diff(before // tokens, prepend=-1) > 0], len(table)]
            for a, b in zip(cuts, cuts[1:]):
                if b == len(table) and batch is not None:
                    rest = table.slice(a)
                    break
                row = _block(table.slice(a, b - a), ids[a:b] - ids[a], number)
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) if not pa.types.is_list(f.type) else one_list(row[f.name], f.type) for f in schema], schema=schema)

    return work


def one_list(values, kind: pa.DataType) -> pa.Array:
    """An array as the only row of a column of lists."""
    if values is None:
        return pa.nulls(1, kind)
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind.value_type))


def word_blocks(docs: DataFrame, words: Column | str = "words", tokens: int = 0) -> DataFrame:
    """Documents (doc_id, and an array of words or a text, whose words are its runs of a-z) in ascending ids, as blocks of some tokens (BLOCK_TOKENS), written
    once: `block` ascends with the ids (null is the last one), `doc_id` and `size` have an entry for each
    document, `word` one for each token (its word's place in `words`), `words` and `n` one for each word of
    the block. `pos` is null where every document's places are 0, 1, 2 and so on."""
    order = F.col("doc_id").asc_nulls_last()
    dealt = docs.repartitionByRange(order).sortWithinPartitions(order).select("doc_id", (F.col(words) if isinstance(words, str) else words).alias("words"))
    kinds = dict(dealt.dtypes)
    of = kinds["words"] if kinds["words"] != "string" else "array<string>"
    schema = StructType.fromDDL(f"block bigint, total bigint, doc_id array<{kinds['doc_id']}>, size array<int>, pos array<int>, word array<int>, words {of}, n array<bigint>")
    return materialize(dealt.mapInArrow(_blocks(tokens or BLOCK_TOKENS, to_arrow_schema(schema)), schema), "blocks", large=True)


def _numbered_block(schema: pa.Schema):
    def work(block: pa.Table, ids: pa.Table) -> pa.Table:
        row = {c: block[c].chunk(0) for c in block.column_names}
        size, word = (row[c].flatten().to_numpy() for c in ("size", "word"))
        number = np.zeros(len(ids), np.int64)
        number[ids["i"].to_numpy()] = ids["word_id"].to_numpy()
        ends = np.concatenate(([0], np.cumsum(size)))
        pos = np.arange(len(word)) - np.repeat(ends[:-1], size) if row["pos"].null_count else row["pos"].flatten().to_numpy()
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (pos, number[word])]
        return pa.table([row["doc_id"].flatten(), *lists], schema=schema)

    return work


def numbered_documents(docs: DataFrame, words: Column | str = "words") -> tuple[DataFrame, DataFrame]:
    """(word, word_id), numbers from 0 in the words' order, and documents (doc_id, pos, word_id) with arrays: only each
    block's distinct words are joined to their numbers."""
    blocks = word_blocks(docs, words, NUMBERED_TOKENS)
    met = blocks.select(F.col("block").alias("part"), F.posexplode("words").alias("i", "word"))
    found = materialize(met.select("word").distinct(), "words").withColumn("one", F.lit(1).cast("bigint"))
    numbers = materialize(running(found, "word", "one", "word_id").select("word", F.col("word_id").cast("int").alias("word_id")), "words")
    ids = met.join(numbers, "word").select("part", "i", "word_id")
    schema = StructType.fromDDL(f"doc_id {dict(blocks.dtypes)['doc_id'][6:-1]}, pos array<int>, word_id array<int>")
    placed = blocks.select("block", "doc_id", "size", "pos", "word")
    return numbers, placed.groupBy("block").cogroup(ids.groupBy("part")).applyInArrow(_numbered_block(to_arrow_schema(schema)), schema)


def _placed_block(schema: pa.Schema):
    def work(block: pa.Table, starts: pa.Table) -> pa.Table:
        row = {c: block[c].chunk(0) for c in block.column_names}
        size, word = (row[c].flatten().to_numpy() for c in ("size", "word"))
        start = np.zeros(len(starts), np.int64)
        start[starts["i"].to_numpy()] = starts["start"].to_numpy()
        order = np.argsort(word, kind="stable")
        n = np.bincount(word, minlength=len(start))
        at = np.empty(len(word), np.int64)
        at[order] = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(len(word))
        tokens = {"doc_id": row["doc_id"].flatten().take(pa.array(np.repeat(np.arange(len(size)), size))), "pos": np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)}
        if row["pos"].null_count == 0:
            tokens["pos"] = row["pos"].flatten().to_numpy()
        tokens |= {"doc_at": row["first"][0].as_py() + np.arange(len(word)), "word_at": at}
        if "words" in row:
            tokens["word_id"] = row["words"].flatten().take(pa.array(word))
        return pa.table([pa.array(tokens[f.name]).cast(f.type) for f in schema], schema=schema)

    return work


def word_major_documents(docs: DataFrame, words: Column | str = "words", with_words: bool = True) -> DataFrame:
    """word_major of documents (doc_id, words): a block's words are counted where it is read, and only these
    counts are sorted, by word and block; with_words: whether tokens carry their word."""
    blocks = word_blocks(docs, words)
    counts = blocks.select("block", F.posexplode(F.arrays_zip("words", "n")).alias("i", "w"))
    starts = running(counts.select("w.words", "block", "i", "w.n"), ["words", "block"], "n", "start").select("block", "i", "start")
    first = running(blocks.select("block", "total"), "block", "total", "first").select("block", "first")
    kinds = dict(blocks.dtypes)
    placed = blocks.select("block", "doc_id", "size", "pos", "word", *(["words"] if with_words else [])).join(first, "block")
    schema = StructType.fromDDL(f"doc_id {kinds['doc_id'][6:-1]}, pos int, {'word_id ' + kinds['words'][6:-1] + ', ' if with_words else ''}doc_at bigint, word_at bigint")
    return placed.groupBy("block").cogroup(starts.groupBy("block")).applyInArrow(_placed_block(to_arrow_schema(schema)), schema)


def word_major(tokens: DataFrame, seed: int | None = None) -> DataFrame:
    """(doc_id, pos, word_id, doc_at, word_at): where each token stands in document-major and in word-major
    order, both from 0; pos counts a document's tokens from 0. A word's tokens follow by document and
    place or, with a seed, in an order drawn by it. Only counts per word and document are sorted
    as a whole, by ranges."""
    runs = tokens.groupBy("word_id", "doc_id").agg(F.collect_list("pos").alias("p"))  # of one document
    drawn = lambda *c: F.lit(0).cast("bigint") if seed is None else F.xxhash64(F.lit(seed), *c)
    places = F.transform("p", lambda x: F.struct(drawn("doc_id", x).alias("h"), x.alias("pos")))
    runs = runs.withColumn("p", F.transform(F.array_sort(places), lambda x: x["pos"]))
    sizes = running(tokens.groupBy("doc_id").agg(F.count("*").alias("size")), "doc_id", "size", "first").select("doc_id", "first")
    return _placed(runs.join(sizes, "doc_id").withColumn("key", F.struct("word_id", drawn("doc_id").alias("h"), "doc_id")))
