"""WARC archives with a two-level capture index.

Every page becomes a gzip member in one of the archives: a response, or a revisit of the response
with the smallest id among equal payloads of at least `min_bytes`. Pages are dealt by ranges of their
reversed-host URL key and id, so archives and index have one order. The index holds one line per
capture; runs of lines are compressed into blocks, and each index file ends with a sparse directory,
the first key of each block. The table of index files, one row each, is the top of it. A lookup
binary-searches the files, their directory, and the lines of a block, and reads the records' ranges of
the archive, which lie side by side for neighbouring keys.

`lookup` does so for a table of URLs: each index file's keys go to one task, which passes through them
in order; captures of a key that fill several files are read by several tasks.

Archives and index files go to the shared folder through Arrow file systems; tables name only
files of committed attempts. A null html is an empty payload, a null url has an empty key and is found
by a null url. Repeated rows are captures of their own; those with the smallest id of their group are
responses, and a page without id is a response if its group has no id at all. An empty table gives
empty tables. Only the named columns are read, whatever others are called.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import urllib.parse
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import begin, join_groups, materialize, slices, texts_of, type_name

_BLOCK_LINES = 1000
_SAFE = "!#$&'()*+,/:;=?@[]~-._"  # of a key, but for the sign of escapes
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_key(url: Column) -> Column:
    """Host labels reversed and comma-joined, then `)` and the rest: com,example,www)/path?query."""
    mark = F.instr(url, "://")
    rest = F.when(mark > 0, F.substring(url, mark + 3, F.length(url))).otherwise(url)
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    labels = F.concat_ws(",", F.reverse(F.split(F.translate(host, _UPPER, _LOWER), r"\.", -1)))
    return F.coalesce(F.concat(labels, F.lit(")"), F.substring(rest, F.length(host) + 1, F.length(rest))), F.lit(""))


def key_of(url: str | None) -> str:
    """The same of one URL."""
    if url is None:
        return ""
    _, mark, rest = url.partition("://")
    rest = rest if mark else url
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host = rest[:cut].translate(str.maketrans(_UPPER, _LOWER))
    return ",".join(reversed(host.split("."))) + ")" + rest[cut:]


def _written(key: str) -> str:
    return urllib.parse.quote(key, safe=_SAFE)


def _read(line: str) -> bytes:
    """The key of an index line, in the order of which lines are sorted."""
    return urllib.parse.unquote_to_bytes(line.split(" ", 1)[0])


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC/1.1 record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{urllib.parse.quote(json.dumps(page_id))}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {urllib.parse.quote(url, safe=_SAFE + "%")}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{urllib.parse.quote(json.dumps(refers_to))}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Headers, HTTP headers and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    fields["http"] = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    return fields | {"payload": payload}


def _page(urn: str):
    return json.loads(urllib.parse.unquote(urn.removeprefix("<urn:page:").removesuffix(">")))


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path)


def revisits(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 100) -> DataFrame:
    """(key, id, digest, first) of the pages that are revisits: `first` is their response's id."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    slim = pages.where(F.octet_length(payload) >= min_bytes).select(url_key(F.col(url_col)).alias("key"), F.col(id_col).alias("id"), F.sha2(payload, 256).alias("digest"))
    groups = slim.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("c")).where("c > 1")
    again = join_groups(slim, groups, "digest", "c", how="inner")
    return again.where("first is not null and (id is null or id > first)").select("key", "id", "digest", "first").distinct()


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 100, part_bytes: int = 1 << 29) -> DataFrame:
    """Write archives and index below `path`; returns the table of index files (part, file, first_key,
    last_key, n_captures)."""
    spark = pages.sparkSession
    pages = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    size = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))
    marks = materialize(revisits(pages, id_col="id", min_bytes=min_bytes), "revisits")
    # a mark and its page meet by having one key, id and digest; marks come first
    empty = F.lit(None)
    order = ["key", "id", "digest", "kind"]
    rows = pages.select(url_key(F.col("url")).alias("key"), "id", F.sha2(payload, 256).alias("digest"), F.lit(1).alias("kind"), "url", "html", empty.cast(type_name(pages, "id")).alias("first"))
    rows = marks.select("key", "id", "digest", F.lit(0).alias("kind"), empty.cast("string").alias("url"), empty.cast("string").alias("html"), "first").union(rows)

    def write(batches):
        begin("warc")
        fs, folder = _open(path)
        part, ending = TaskContext.get().partitionId(), uuid.uuid4().hex
        names = f"archive-{part:06d}-{ending}.warc.gz", f"index-{part:06d}-{ending}.cdx.gz"
        archive = index = None
        at, end, n, held, blocks, mark, ends = 0, 0, 0, [], [], None, [None, None]

        def close():
            nonlocal end
            data = _gzip("\n".join(held).encode())
            index.write(data)
            blocks.append([held[0].split(" ", 1)[0], end, len(data)])
            end += len(data)
            held.clear()

        for batch in slices(batches):
            if archive is None:
                fs.create_dir(folder, recursive=True)
                archive, index = (fs.open_output_stream(f"{folder}/{x}", compression=None) for x in names)
            keys, ids, digests, kinds, urls, _, firsts = (None if k == 5 else batch.column(k).to_pylist() for k in range(7))
            for key, page_id, digest, kind, url, html, first in zip(keys, ids, digests, kinds, urls, texts_of(batch.column(5)), firsts):
                if not kind:
                    mark = key, page_id, digest, first
                    continue
                again = mark is not None and mark[:3] == (key, page_id, digest)
                data = _gzip(record(page_id, url, html or b"", mark[3] if again else None, again))
                archive.write(data)
                held.append(f"{_written(key)} {urllib.parse.quote(json.dumps(page_id))} {names[0]} {at} {len(data)}")
                at, n = at + len(data), n + 1
                ends = [key if n == 1 else ends[0], key]
                if len(held) == _BLOCK_LINES:
                    close()
        if archive is None:
            return
        if held:
            close()
        directory = _gzip(json.dumps(blocks).encode())
        index.write(directory + len(directory).to_bytes(8, "little"))
        archive.close()
        index.close()
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int64()), (names[1], pa.string()), (ends[0], pa.string()), (ends[1], pa.string()), (n, pa.int64()))], ["part", "file", "first_key", "last_key", "n_captures"])

    dealt = rows.repartitionByRange(parts, *order[:3]).sortWithinPartitions(*order)
    files = dealt.mapInArrow(write, "part bigint, file string, first_key string, last_key string, n_captures bigint")
    files.write.parquet(f"{path}/files")
    return spark.read.schema(files.schema).parquet(f"{path}/files")


class _Files:
    """A few open files of the shared folder."""

    def __init__(self, path: str, limit: int = 64):
        self.fs, self.folder = _open(path)
        self.limit, self.held = limit, {}

    def open(self, name: str):
        if name not in self.held:
            if len(self.held) >= self.limit:
                self.held.pop(next(iter(self.held))).close()
            self.held[name] = self.fs.open_input_file(f"{self.folder}/{name}")
        return self.held[name]

    def read(self, name: str, at: int, n: int) -> bytes:
        return self.open(name).read_at(n, at)


class IndexFile:
    """One index file: its sparse directory, and blocks read as they are needed."""

    def __init__(self, files: _Files, name: str):
        self.files, self.name = files, name
        size = files.open(name).size()
        n = int.from_bytes(files.read(name, size - 8, 8), "little")
        self.blocks = json.loads(zlib.decompress(files.read(name, size - 8 - n, n), 31))
        self.first = [_read(b[0]) for b in self.blocks]
        self.held: tuple = (None, [], [])

    def _block(self, k: int) -> tuple[list[str], list[bytes]]:
        if self.held[0] != k:
            _, at, n = self.blocks[k]
            lines = zlib.decompress(self.files.read(self.name, at, n), 31).decode().split("\n")
            self.held = k, lines, [_read(x) for x in lines]
        return self.held[1:]

    def find(self, key: bytes):
        """Lines of a key, in order."""
        k = max(0, bisect.bisect_left(self.first, key) - 1)  # the key may begin within the block before
        while k < len(self.first) and self.first[k] <= key:
            lines, keys = self._block(k)
            yield from lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]
            k += 1


def _records(files: _Files, lines, limit: int = 4 << 20):
    """Parsed records of index lines; ranges that lie side by side are read at once."""
    run: list[tuple[int, int]] = []
    before, held = None, 0

    def read():
        data = files.read(before, run[0][0], held)
        for at, n in run:
            yield parse(zlib.decompress(data[at - run[0][0] : at - run[0][0] + n], 31))

    for line in lines:
        _, _, name, at, n = line.split(" ")
        at, n = int(at), int(n)
        if run and (name != before or at != run[0][0] + held or held + n > limit):
            yield from read()
            run, held = [], 0
        before = name
        run.append((at, n))
        held += n
    if run:
        yield from read()


def lookup(wanted: DataFrame, path: str, *, url_col: str = "url", id_col: str = "page_id", id_type: str = "bigint", payload: bool = False) -> DataFrame:
    """All captures of the URLs of a table, each once however often its URL is named: id, payload_bytes,
    payload_digest, record_type, refers_to and, on request, the payload (null for revisits)."""
    spark = wanted.sparkSession
    top = sorted((r.first_key.encode(), r.last_key.encode(), r.file) for r in spark.read.parquet(f"{path}/files").collect())  # one row an index file
    firsts, lasts = [r[0] for r in top], [r[1] for r in top]

    def deal(batches):
        for batch in batches:
            keys, parts = [], []
            for key in texts_of(batch.column(0)):
                for k in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key)):
                    keys.append(key.decode())
                    parts.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(parts, pa.int64())], ["key", "part"])

    def run(batches):
        begin("warc")
        files, index = _Files(path), None

        def lines():
            nonlocal index
            for batch in batches:
                for key, part in zip(texts_of(batch.column(0)), batch.column(1).to_pylist()):
                    if index is None or index.name != top[part][2]:
                        index = IndexFile(files, top[part][2])
                    yield from index.find(key)

        out: list[list] = [[] for _ in range(6)]
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())
        names = ["id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        for r in _records(files, lines()):
            again, digest = r["WARC-Type"] == "revisit", r["WARC-Payload-Digest"].removeprefix("sha256:")
            if not again and hashlib.sha256(r["payload"]).hexdigest() != digest:
                raise ValueError(f"damaged payload: {r['WARC-Record-ID']}")
            first, page_id = _page(r["WARC-Refers-To"]) if again else None, _page(r["WARC-Record-ID"])
            first, page_id = (x if x is None else str(x) for x in (first, page_id))
            size = int(r["http"]["Content-Length"]) if again else len(r["payload"])
            for column, value in zip(out, (page_id, size, digest, r["WARC-Type"], first, r["payload"] if payload and not again else None)):
                column.append(value)
            if len(out[0]) == 256:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)
                out = [[] for _ in range(6)]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)

    keys = wanted.select(url_key(F.col(url_col)).alias("key")).distinct()
    dealt = keys.mapInArrow(deal, "key string, part bigint").repartition(max(1, len(top)), "part").sortWithinPartitions("part", "key")
    rows = dealt.mapInArrow(run, "id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, payload binary")
    columns = [F.col("id").cast(id_type).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(id_type)]
    return rows.select(*columns, *["payload"] * payload)


class CaptureIndex:
    """Lookups of single URLs from one process."""

    def __init__(self, spark: SparkSession, path: str):
        self.files = _Files(path)
        self.top = sorted((r.first_key.encode(), r.last_key.encode(), r.file) for r in spark.read.parquet(f"{path}/files").collect())

    def get(self, url: str | None) -> list[dict]:
        """All captures of a URL."""
        key, out = key_of(url).encode(), []
        for k in range(bisect.bisect_left([r[1] for r in self.top], key), bisect.bisect_right([r[0] for r in self.top], key)):
            out += _records(self.files, IndexFile(self.files, self.top[k][2]).find(key))
        return out
