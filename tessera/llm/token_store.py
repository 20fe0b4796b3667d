"""Token-id output: raw id payloads with a minimal perfect hash index.

`write_tokens` range-partitions documents by id and text hash, encodes each with the tokenizers
library's BPE model, appends the end id and writes per partition
  <shard>.bin  ids of its documents, little-endian, of 16 bits where the vocabulary allows it and
               32 otherwise, in ascending id order;
  <shard>.idx  a minimal perfect hash over the document keys with, per slot, a 32-bit fingerprint,
               the first id's offset and the number of ids, and the keys in file order;
and a manifest table with one row per shard, which names only files of committed attempts. Lookups
are constant time: hash, slot, fingerprint, one range read. There is a shard for about `shard_bytes` of
text, and at least one per shuffle partition.

Files go to the shared folder through Arrow file systems, never to a local disk. A null text is an
empty document (just the end id). Null ids sort first. A repeated id is kept as a further
occurrence of its key; occurrences are in the order of a hash of their text, so they are numbered
alike in every run, and may lie in several shards. An empty table gives an empty manifest. Only the
named columns are read, whatever others are called.
"""

from __future__ import annotations

import json
import uuid
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import ChunkEncoder, byte_letters
from .textkit import begin, memo, mix64, slices, texts_of, type_name

_GAMMA = 2.0  # bits per key on each level
_MAGIC = b"TSRIDX01"


class MinimalPerfectHash:
    """Levels of bit arrays: a key's slot is the rank of the first level's bit that it has alone."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        ranks = np.cumsum([0] + [int(np.count_nonzero(x)) for x in levels])
        self.ranks = [np.cumsum(x) - 1 + base for x, base in zip(levels, ranks)]

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        salt = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
        return (mix64(keys ^ salt) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalPerfectHash:
        """keys: distinct 64-bit hashes."""
        if len(np.unique(keys)) != len(keys):
            raise ValueError("keys are not distinct")
        levels, rest = [], keys
        while len(rest):
            size = int(_GAMMA * len(rest)) + 1
            at = cls._at(rest, len(levels), size)
            levels.append(np.bincount(at, minlength=size) == 1)
            rest = rest[~levels[-1][at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; for an unknown key any slot or -1, which the fingerprint sorts out."""
        out = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            at = self._at(keys[rest], level, len(bits))
            hit = bits[at]
            out[rest[hit]] = ranks[at[hit]]
            rest = rest[~hit]
        return out


def key_text(doc_id, occurrence: int) -> bytes:
    return (b"\0null" if doc_id is None else str(doc_id).encode()) + (b"" if not occurrence else b"\0%d" % occurrence)


def _hashes(keys: list[bytes], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    whole = np.array([xxhash.xxh64_intdigest(k, seed) for k in keys], np.uint64)
    prints = np.array([xxhash.xxh32_intdigest(k, 7) for k in keys], np.uint32)
    return whole, prints


class ShardIndex:
    """The contents of an .idx file."""

    def __init__(self, hashing: MinimalPerfectHash, prints: np.ndarray, offsets: np.ndarray, counts: np.ndarray, keys: list[bytes], ids: pa.Array, unit: int, seed: int = 0):
        self.hashing, self.prints, self.offsets, self.counts, self.keys, self.ids, self.unit, self.seed = hashing, prints, offsets, counts, keys, ids, unit, seed

    @classmethod
    def build(cls, ids: list, counts: np.ndarray, kind: pa.DataType, unit: int) -> ShardIndex:
        """ids ascending; counts[k] ids of the k-th document."""
        keys, before, occurrence = [], object(), 0
        for doc_id in ids:
            occurrence = occurrence + 1 if doc_id == before else 0
            before = doc_id
            keys.append(key_text(doc_id, occurrence))
        seed = 0
        while len(np.unique((found := _hashes(keys, seed))[0])) != len(keys):
            seed += 1  # two keys of one hash: another seed tells them apart
        whole, prints = found
        hashing = MinimalPerfectHash.build(whole)
        slots, offsets = hashing.slots(whole), np.cumsum(counts) - counts
        by_slot = [np.empty(len(keys), x.dtype) for x in (prints, offsets, counts)]
        for held, values in zip(by_slot, (prints, offsets, counts)):
            held[slots] = values
        return cls(hashing, *by_slot, keys, pa.array(ids, kind), unit, seed)

    def find(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and counts of keys; -1 where the shard has no such key."""
        whole, prints = _hashes(keys, self.seed)
        slots = self.hashing.slots(whole)
        known = (slots >= 0) & (self.prints[slots] == prints) if len(self.prints) else np.zeros(len(keys), bool)
        return np.where(known, self.offsets[slots], -1), np.where(known, self.counts[slots], -1)

    def read(self, data, at: int, n: int) -> np.ndarray:
        """n ids of an open payload file, from the at-th on."""
        return np.frombuffer(data.read_at(self.unit * n, self.unit * at), f"<u{self.unit}").astype("<u4")

    def dump(self) -> bytes:
        sink = pa.BufferOutputStream()
        batch = pa.RecordBatch.from_arrays([self.ids, pa.array(self.keys, pa.binary())], ["id", "key"])
        with pa.ipc.new_stream(sink, batch.schema) as writer:
            writer.write_batch(batch)
        levels = [np.packbits(x, bitorder="little").tobytes() for x in self.hashing.levels]
        blobs = [self.prints.astype("<u4").tobytes(), self.offsets.astype("<i8").tobytes(), self.counts.astype("<i8").tobytes(), sink.getvalue().to_pybytes(), *levels]
        head = json.dumps({"sizes": [len(x) for x in blobs], "bits": [len(x) for x in self.hashing.levels], "unit": self.unit, "seed": self.seed}).encode()
        return _MAGIC + len(head).to_bytes(8, "little") + head + b"".join(blobs)

    @classmethod
    def load(cls, data: bytes) -> ShardIndex:
        if data[:8] != _MAGIC:
            raise ValueError("not an index file")
        n = int.from_bytes(data[8:16], "little")
        head, at, blobs = json.loads(data[16 : 16 + n]), 16 + n, []
        for size in head["sizes"]:
            blobs.append(data[at : at + size])
            at += size
        prints, offsets, counts, table, *levels = blobs
        with pa.ipc.open_stream(table) as reader:
            rows = reader.read_all()
        bits = [np.unpackbits(np.frombuffer(x, np.uint8), count=m, bitorder="little").astype(bool) for x, m in zip(levels, head["bits"])]
        return cls(MinimalPerfectHash(bits), np.frombuffer(prints, "<u4"), np.frombuffer(offsets, "<i8"), np.frombuffer(counts, "<i8"), rows["key"].to_pylist(), rows["id"].combine_chunks(), head["unit"], head["seed"])


@lru_cache(2)
def library_encoder(path: str) -> tuple[ChunkEncoder, int]:
    """Chunk memo over the library's own BPE model (pre-tokens are what its pre-tokenizer makes),
    and the vocabulary's size."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    model, letters = tokenizer.model, dict(enumerate(byte_letters()))
    special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}

    def pieces(texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            # control characters, ASCII ones too, have stand-ins; a piece holds no space
            shown = text if text.isascii() and text.isprintable() else text.encode().decode("latin-1").translate(letters)
            out.append(array("I", [t.id for t in model.tokenize(shown)]).tobytes())
        return out

    return ChunkEncoder(special, pieces, 600_000, 500_000), tokenizer.get_vocab_size(with_added_tokens=True)


memo("token_store", library_encoder.cache_clear)


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, shard_bytes: int = 1 << 28) -> DataFrame:
    """Write the store below `path`; returns its manifest: shard, file, n_docs, n_ids, n_null (documents
    without id), first_id, last_id, n_first and n_last (documents with those ids)."""
    spark = docs.sparkSession
    kind = type_name(docs, id_col)
    if not shards:
        size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))

    def run(batches):
        begin("token_store")
        (encoder, vocabulary), shard = library_encoder(tokenizer), TaskContext.get().partitionId()
        unit = 2 if max(vocabulary, end_id + 1) <= 1 << 16 else 4
        end = end_id.to_bytes(unit, "little")
        fs, folder = _open(path)
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}"  # an attempt that fails leaves files that no manifest names
        out, ids, counts = None, [], []
        for batch in slices(batches):
            if out is None:
                fs.create_dir(folder, recursive=True)
                out = fs.open_output_stream(f"{folder}/{name}.bin")
            ids += batch.column(0).to_pylist()
            for data in encoder.encode(texts_of(batch.column(1))):
                out.write(np.frombuffer(data, "<u4").astype(f"<u{unit}").tobytes() + end)
                counts.append(len(data) // 4 + 1)
        if out is None:
            return
        out.close()
        index = ShardIndex.build(ids, np.array(counts, np.int64), batch.column(0).type, unit)
        with fs.open_output_stream(f"{folder}/{name}.idx") as out:
            out.write(index.dump())
        n_null = ids.count(None)
        first, last = (ids[n_null], ids[-1]) if n_null < len(ids) else (None, None)
        figures = [pa.array([x], pa.int64()) for x in (len(ids), sum(counts), n_null)]
        runs = [pa.array([0 if x is None else ids.count(x)], pa.int64()) for x in (first, last)]
        ends = [pa.array([x], batch.column(0).type) for x in (first, last)]
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([name]), *figures, *ends, *runs], ["shard", "file", "n_docs", "n_ids", "n_null", "first_id", "last_id", "n_first", "n_last"])

    order = [F.col(id_col).asc_nulls_first(), F.col("__hash").asc()]
    named = docs.select(id_col, text_col, F.xxhash64(text_col).alias("__hash"))
    ordered = named.repartitionByRange(shards, *order).sortWithinPartitions(*order).drop("__hash")
    manifest = ordered.mapInArrow(run, f"shard bigint, file string, n_docs bigint, n_ids bigint, n_null bigint, first_id {kind}, last_id {kind}, n_first bigint, n_last bigint")
    manifest.write.parquet(f"{path}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{path}/manifest")


def read_tokens(spark: SparkSession, path: str, *, id_col: str = "doc_id", payload: bool = False) -> DataFrame:
    """Every document of a store, found through its shard's index and read from the payload: id,
    start (ids of all documents before it), n_tokens, ids_crc32 and, on request, the raw ids."""
    manifest = spark.read.parquet(f"{path}/manifest")
    kind, base, rows = type_name(manifest, "first_id"), 0, []
    for row in sorted(manifest.select("shard", "file", "n_ids").collect()):  # one row per shard
        rows.append((row.file, base))
        base += row.n_ids
    files = spark.createDataFrame(rows, "file string, base bigint").repartition(max(1, len(rows)))

    def run(batches):
        fs, folder = _open(path)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_stream(f"{folder}/{name}.idx") as f:
                    index = ShardIndex.load(f.read())
                offsets, counts = index.find(index.keys)
                if (counts < 0).any():
                    raise ValueError(f"{name}: the index lost a key")
                with fs.open_input_file(f"{folder}/{name}.bin") as data:
                    for lo, hi in _runs(offsets, counts):
                        # keys are in file order, so what the index finds for them lies side by side
                        begun, n = int(offsets[lo]), int(counts[lo:hi].sum())
                        whole = index.read(data, begun, n).tobytes()
                        raw = [whole[4 * at : 4 * (at + m)] for at, m in zip((offsets[lo:hi] - begun).tolist(), counts[lo:hi].tolist())]
                        columns = [index.ids.slice(lo, hi - lo), pa.array(base + offsets[lo:hi]), pa.array(counts[lo:hi]), pa.array([zlib.crc32(x) for x in raw], pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns + ([pa.array(raw, pa.binary())] if payload else []), [id_col, "start", "n_tokens", "ids_crc32"] + ["ids"] * payload)

    return files.mapInArrow(run, f"`{id_col}` {kind}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * payload)


def _runs(offsets: np.ndarray, counts: np.ndarray, rows: int = 1024, ids: int = 1 << 20):
    """Cuts documents into runs that are read at once: side by side in the file, of bounded size."""
    lo, held = 0, 0
    for k in range(len(counts)):
        if k > lo and (k - lo >= rows or held + counts[k] > ids or offsets[k] != offsets[k - 1] + counts[k - 1]):
            yield lo, k
            lo, held = k, 0
        held += int(counts[k])
    if lo < len(counts):
        yield lo, len(counts)


class TokenStore:
    """Keyed access from one process: the manifest finds the shard, its hash the slot."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path
        self.shards = sorted(spark.read.parquet(f"{path}/manifest").collect())
        self.indexes: dict[str, ShardIndex] = {}

    def get(self, doc_id, occurrence: int = 0) -> np.ndarray | None:
        """Ids of a document, or None where the store has no such key."""
        fs, folder = _open(self.path)
        for row in self.shards:
            if doc_id is None:
                here = row.n_null
            elif row.first_id is None or not row.first_id <= doc_id <= row.last_id:
                continue
            else:  # occurrences of an id in the middle of a shard are all in it
                here = row.n_first if doc_id == row.first_id else row.n_last if doc_id == row.last_id else row.n_docs
            if occurrence >= here:
                occurrence -= here
                continue
            if row.file not in self.indexes:
                with fs.open_input_stream(f"{folder}/{row.file}.idx") as f:
                    self.indexes[row.file] = ShardIndex.load(f.read())
            offsets, counts = self.indexes[row.file].find([key_text(doc_id, occurrence)])
            if counts[0] >= 0:
                with fs.open_input_file(f"{folder}/{row.file}.bin") as data:
                    return self.indexes[row.file].read(data, int(offsets[0]), int(counts[0]))
            return None
        return None
