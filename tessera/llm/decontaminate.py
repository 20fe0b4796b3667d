"""Benchmark decontamination by Wu-Manber search over words.

Test strings are the windows of `width` consecutive words of each benchmark item (the whole item
where it is shorter). Blocks are pairs of words: the shift table says how far the window may move
when it ends in a block (a block of no pattern moves it by all but one word), a shift of zero
selects by the hash of the last `_SUFFIX` words the few test strings that can end here, and
comparing all their words confirms an occurrence. Patterns of one length share a searcher.

The benchmark is cut into blocks of about `block_bytes` of item text. Tasks build the searchers of a
block once and write them to the shared folder; searching tasks load them from there, one block
after the other for some megabytes of documents at a time. So neither the driver nor a broadcast
holds test strings, and a task holds those of a few blocks.

A null text or item has no words; an item without words is never found. Repeated items are found
each under its own id. Words in a window of an item without an id are hit; such items count as one
and are not listed. Repeated documents and ids give repeated rows; an empty benchmark or table gives
rows without hits or no rows. Only the named columns are read, whatever others are called.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import begin, memo, shared_dir, slices, texts_of, type_name

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+").findall  # of lower-cased UTF-8
_SUFFIX = 4  # words by which a bucket of test strings is chosen
_HELD_BYTES = 8 << 20  # documents that are held against one block after the other
_HELD_BLOCKS = 4


def words_of(text: bytes | None) -> list[bytes]:
    return _WORD(text.lower()) if text else []


class WuManber:
    """Searcher for windows of one length of the given items (id, words)."""

    def __init__(self, length: int, items: Iterable[tuple[str | None, list[bytes]]]):
        self.length = n = length
        self.block = b = min(2, n)
        self.default = n - b + 1
        self.suffix = min(_SUFFIX, n)
        self.shift: dict = {}
        # by their last words: (words of an item, start of the window, ids of the items that hold it)
        self.buckets: dict = defaultdict(list)
        for item, words in items:
            for end in range(b, len(words) + 1):
                key = self._key(words, end)
                step = max(n - end, 0)
                if step < self.shift.get(key, self.default):
                    self.shift[key] = step
                if end >= n:
                    self._add(words, end - n, item)
        self.buckets = dict(self.buckets)

    def _key(self, words, end: int):
        return words[end - 1] if self.block == 1 else (words[end - 2], words[end - 1])

    def _add(self, words: list[bytes], at: int, item: str | None) -> None:
        end = at + self.length
        bucket = self.buckets[tuple(words[end - self.suffix : end])]
        for known, start, items in bucket:
            if known[start : start + self.length] == words[at:end]:
                items.add(item)
                return
        bucket.append((words, at, {item}))

    def spans(self, words: list[bytes]):
        """(start, end, items) of every occurrence."""
        n, shift, default, pair, suffix = self.length, self.shift.get, self.default, self.block == 2, self.suffix
        at, last = n, len(words)
        while at <= last:
            key = (words[at - 2], words[at - 1]) if pair else words[at - 1]
            step = shift(key, default)
            if step:
                at += step
                continue
            for known, start, items in self.buckets.get(tuple(words[at - suffix : at]), ()):
                if known[start : start + n] == words[at - n : at]:
                    yield at - n, at, items
            at += 1


def searchers(items: Iterable[tuple], width: int) -> list[WuManber]:
    """One searcher for each length of test strings; items: (id, text)."""
    by_length: dict[int, list] = defaultdict(list)
    same: dict[bytes, bytes] = {}
    for item, text in items:
        words = [same.setdefault(w, w) for w in words_of(text.encode() if isinstance(text, str) else text)]
        if words:
            by_length[min(width, len(words))].append((item, words))
    return [WuManber(n, some) for n, some in sorted(by_length.items())]


def hits(words: list[bytes], found: list[WuManber]) -> tuple[list[tuple[int, int]], set]:
    """Spans of hit words and the items that occur."""
    spans, items = [], set()
    for searcher in found:
        for a, b, ids in searcher.spans(words):
            spans.append((a, b))
            items.update(ids)
    return spans, items


def disjoint(spans: list[tuple[int, int]]) -> list[int]:
    """Spans united, as flat, disjoint ends."""
    flat: list[int] = []
    for a, b in sorted(spans):
        if flat and a <= flat[-1]:
            flat[-1] = max(flat[-1], b)
        else:
            flat += [a, b]
    return flat


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path)


def prepare(benchmark: DataFrame, *, width: int = 13, item_col: str = "item_id", text_col: str = "text", block_bytes: int = 1 << 21) -> list[str]:
    """Write the searchers of every block of the benchmark; returns their files, one a block."""
    spark = benchmark.sparkSession
    path = shared_dir(spark, "searchers")
    size = F.octet_length(F.col(text_col))
    total = benchmark.agg(F.sum(size)).first()[0] or 0
    blocks = -(-total // block_bytes)
    if not blocks:
        return []
    part = benchmark.where(F.col(text_col).isNotNull()).select(F.pmod(F.xxhash64(item_col, text_col), F.lit(blocks)).alias("block"), F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))

    def write(batches):
        begin("decontaminate")
        fs, folder = _open(path)
        block, held = None, []

        def file():
            name = f"block-{block:06d}-{uuid.uuid4().hex}"  # an attempt that fails leaves a file that no list names
            fs.create_dir(folder, recursive=True)
            with fs.open_output_stream(f"{folder}/{name}") as out:
                out.write(pickle.dumps(searchers(held, width), protocol=5))
            return pa.RecordBatch.from_arrays([pa.array([name])], ["file"])

        for batch in slices(batches):
            for k, item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2))):
                if k != block and held:
                    yield file()
                    held.clear()
                block = k
                held.append((item, text))
        if held:
            yield file()

    files = part.repartition(min(blocks, 2000), "block").sortWithinPartitions("block").mapInArrow(write, "file string")
    return [f"{path}/{r.file}" for r in files.collect()]  # one name a block


@lru_cache(_HELD_BLOCKS)
def _load(path: str) -> list[WuManber]:
    fs, name = _open(path)
    with fs.open_input_stream(name) as f:
        return pickle.loads(f.read())


memo("decontaminate", _load.cache_clear)


def _gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in runs of about `limit` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def contamination(docs: DataFrame, benchmark: DataFrame, *, width: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 1 << 21, carry: list[str] | None = None) -> DataFrame:
    """Per document: id, n_words, spans (flat word positions, end exclusive, disjoint), items (ids as
    strings, sorted, null for those without). `carry` names further columns to keep."""
    files = prepare(benchmark, width=width, item_col=item_col, text_col=item_text_col, block_bytes=block_bytes)
    read = list(dict.fromkeys([id_col, text_col, *(carry or [])]))
    schema = ", ".join(f"`{c}` {type_name(docs, c)}" for c in read) + ", n_words bigint, spans array<bigint>, items array<string>"
    at = read.index(text_col)

    def run(batches):
        begin("decontaminate")
        # one slice at a time where all blocks stay in memory
        for held in _gathered(slices(batches), _HELD_BYTES if len(files) > _HELD_BLOCKS else 0):
            texts = [words_of(t) for batch in held for t in texts_of(batch.column(at))]
            spans: list[list] = [[] for _ in texts]
            items: list[set] = [set() for _ in texts]
            for file in files:
                found = _load(file)
                for k, words in enumerate(texts):
                    some, ids = hits(words, found)
                    if some:
                        spans[k] += some
                        items[k] |= ids
            lo = 0
            for batch in held:
                hi = lo + batch.num_rows
                named = [sorted(x - {None}) + [None] * (None in x) for x in items[lo:hi]]
                more = [pa.array([len(t) for t in texts[lo:hi]], pa.int64()), pa.array([disjoint(x) for x in spans[lo:hi]], pa.list_(pa.int64())), pa.array(named, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*read, "n_words", "spans", "items"])
                lo = hi

    return docs.select(*read).mapInArrow(run, schema)


def judged(found: DataFrame) -> DataFrame:
    """Add n_hit and the verdict: contaminated where a twentieth or more of the words are hit."""
    n_hit = "if(size(spans) = 0, 0L, aggregate(sequence(0, size(spans) div 2 - 1), 0L, (s, i) -> s + spans[2 * i + 1] - spans[2 * i]))"
    return found.withColumn("n_hit", F.expr(n_hit)).withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, a digest of the items and the verdict."""
    items = F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    return judged(found).select(id_col, "n_words", "n_hit", *items, "contaminated")
