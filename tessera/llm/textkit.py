"""Kernels shared by the corpus operators: shared folders, Arrow columns, word and shingle hashing.

Word hashing is vectorised: a batch of texts is one byte array, every word gets a 64-bit
polynomial hash from prefix sums, and w-word shingles are mixed from the word hashes, so that no
Python code runs per word.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RADIX = np.uint64(0x9E3779B97F4A7C55)  # odd, so it has an inverse modulo 2**64
_RADIX_INV = np.uint64(pow(int(_RADIX), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir; where that is unset, a temporary root is set, but only
    in a session of one process: executors of a cluster share no local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read back (survives lost executors)."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int | None = None, how: str = "left") -> DataFrame:
    """rows joined with groups, which has one row per value of `key` and in `size` its number of rows.

    A value with more than a thousandth of all rows could fill a task: there are a thousand of those
    at most, so they are broadcast. The others go through a shuffle, in which no value has more.
    Null is a value like others. total: the sum of `size`, where it is known; how: left or inner.
    """
    if total is None:
        total = groups.agg(F.sum(size)).first()[0] or 0
    named = groups.withColumnRenamed(key, "__key").withColumn("__hot", F.col(size) > total / 1000)
    match = rows[key].eqNullSafe(F.col("__key"))
    if total <= 1000:
        return rows.join(named, match, how).drop("__key", "__hot")
    some = F.broadcast(named.where("__hot"))  # a thousand rows at most
    rest = rows.join(some.select("__key"), match, "left_anti").join(named.where("not __hot"), match, how)
    return rows.join(some, match).union(rest).drop("__key", "__hot")


_MEMOS: dict[str, Callable[[], None]] = {}


def memo(owner: str, clear: Callable[[], None]) -> None:
    """Tell how to drop an operator's memo."""
    _MEMOS[owner] = clear


def begin(owner: str) -> None:
    """A task of an operator begins: a worker that served other operators drops their memos."""
    for other, clear in _MEMOS.items():
        if other != owner:
            clear()


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches cut to a few rows, so that a worker holds few texts as Python objects at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def texts_of(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, null as None."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def type_name(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        up, down = np.full(size, _RADIX), np.full(size, _RADIX_INV)
        up[0] = down[0] = 1
        _POWERS["up"], _POWERS["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS["up"], _POWERS["down"]


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(data: bytes, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the runs of bytes other than ASCII white space; with `fold` A-Z
    count as a-z."""
    raw = np.frombuffer(data.lower() if fold else data, np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate(([True], _IS_SPACE[raw], [True])).view(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * down[starts]
    return mix64(hashes + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts, ends


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all runs of `width` words; of the whole sequence where it is shorter."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    k = min(width, n)
    total = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        salt = np.uint64((0xA24BAED4963EE407 * (2 * i + 3)) & 0xFFFFFFFFFFFFFFFF)
        total += mix64(words[i : n - k + 1 + i] ^ salt)
    return mix64(total + np.uint64(k))


def batches_of(texts: list[bytes | None], limit: int = 1 << 20):
    """Runs of rows of about `limit` bytes; a longer text is a run of its own."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text or b"")
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def words_by_row(texts: list[bytes | None], fold: bool = True):
    """Yields (row, word hashes) for every row, hashing some megabytes at a time."""
    for lo, hi in batches_of(texts):
        part = [t or b"" for t in texts[lo:hi]]
        hashes, starts, _ = word_hashes(b"\n".join(part), fold)
        offsets = np.cumsum([0] + [len(t) + 1 for t in part])
        cuts = np.searchsorted(starts, offsets)
        for i in range(hi - lo):
            yield lo + i, hashes[cuts[i] : cuts[i + 1]]
