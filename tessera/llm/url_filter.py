"""URL filters by a sorted digest array.

Rules `host/path` and a table of blocked host labels are kept as arrays of sorted 64-bit xxhash keys
with offsets into their stored strings. Tasks build the arrays: entries are dealt by ranges of their
key, and each range is written as one sorted run of about `run_bytes` to the shared folder. Spark sends
the runs to every executor as files, where they are memory-mapped. All candidate keys of a batch of
URLs (every host suffix with every path prefix of a length that some rule has, and every label) are
probed by vectorised binary searches, and a hit counts only if the stored string is equal, so
collisions change nothing.

A null url or one without `://` has an empty host and path, which no rule fits: it is allowed.
Repeated rows and ids, and null ids, give repeated results; of equal rules block holds, and repeated
labels count once; an empty table gives an empty result. Only the named columns are read, whatever
others are called.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import begin, materialize, memo, shared_dir, slices, texts_of, type_name

# Words from which the default list of unwanted host labels is made.
TOPICS = (
    "ad ads adserver adult advert affiliate banner bet bets betting bingo bitcoin-doubler bonus casino cam cams cash-loan cialis clickbait counterfeit crack cracked darknet dating diet-pill escort fake fraud free-money gambling hack hacked hentai jackpot keygen kamagra levitra loan loans lottery lotto malware milf miracle-cure naked nude nudes payday phish phishing pharma pharmacy pill pills piracy "
    "poker ponzi popunder popup porn porno pron pyramid ransom replica roulette scam scams sex sexcam sexy slot slots spam spammer spyware steroid steroids tracker trackers tracking track tramadol trojan valium viagra virus warez webcam weightloss win xanax xxx"
).split()
MODIFIERS = (
    "24 365 a all amazing any asia auto bargain best big bonus boost bulk buy center central cheap city click club cool crazy daily deal deals dealer direct discount easy euro expert express extra farm fast farms first free fun galaxy get go gold good great group guide hit home hot house hub instant king kings lab land large lead leads legal line link links list live local lucky mail mania market mart master mega mobile my net network new news now offer offers "
    "office official on online only order original outlet page paradise park party pay place planet play plus point portal power premium prime pro promo quick rate real review reviews rich room royal safe sale sales save search secret secure server service share shop site smart source special spot star start station store super supply swap team the tip tips top total toy trade trend trust ultra universe us vip warehouse web wild win winner wonder world x xl you your zone"
).split()

_LABEL = b"\0"  # marks a label's entry, so that it never equals a rule
_SEED = 42  # of Spark's own xxhash64, by which entries are dealt


def default_blocklist(spark: SparkSession) -> DataFrame:
    """(label): every unwanted topic before and after every modifier and topic, joined or with a hyphen,
    bare or with a digit; some hundred thousand labels."""
    words = sorted({*TOPICS, *MODIFIERS})
    topics = sorted(TOPICS)
    any_word = F.split(F.lit(",".join(words)), ",")
    topic = F.split(F.lit(",".join(topics)), ",")
    a = F.element_at(topic, (F.col("id") % len(topics) + 1).cast("int"))
    b = F.element_at(any_word, (F.floor(F.col("id") / len(topics)) + 1).cast("int"))
    bare = spark.range(len(topics) * len(words)).select(F.explode(F.array(F.concat_ws("-", a, b), F.concat_ws("-", b, a), F.concat(a, b), F.concat(b, a))).alias("x"))
    digits = F.array(*[F.lit(x) for x in ["", *"1234"]])
    return bare.select(F.explode(F.transform(digits, lambda d: F.concat("x", d))).alias("label"))


def pack(entries: list[tuple[bytes, bytes]]) -> bytes:
    """File image of (text, verdict) entries: count, sorted keys, offsets, then text and verdict of each."""
    rows = sorted((xxhash.xxh64_intdigest(text, _SEED), text, verdict) for text, verdict in entries)
    body = [struct.pack("<I", len(text)) + text + verdict for _, text, verdict in rows]
    offsets = np.cumsum([0] + [len(x) for x in body])
    return np.array([len(rows)], "<u8").tobytes() + np.array([r[0] for r in rows], "<u8").tobytes() + offsets.astype("<u8").tobytes() + b"".join(body)


class DigestArray:
    """Memory-mapped lookups in packed files."""

    def __init__(self, paths: list[str]):
        self.runs = []
        for path in paths:
            raw = np.memmap(path, np.uint8, "r")
            n = int(raw[:8].view("<u8")[0])
            if n:
                self.runs.append((raw[8 : 8 + 8 * n].view("<u8"), raw[8 + 8 * n : 16 + 16 * n].view("<u8"), raw[16 + 16 * n :]))

    def find(self, texts: list[bytes]) -> list[bytes | None]:
        """Verdict of each text, None where it is not stored."""
        out: list[bytes | None] = [None] * len(texts)
        probes = np.array([xxhash.xxh64_intdigest(t, _SEED) for t in texts], np.uint64)
        order = np.argsort(probes)
        ordered = probes[order]
        for keys, offsets, body in self.runs:
            lo = np.searchsorted(ordered, keys[0], "left")  # only probes within the run's range
            hi = np.searchsorted(ordered, keys[-1], "right")
            some = ordered[lo:hi]
            at = np.searchsorted(keys, some)
            for i in np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == some).tolist():
                where, k = int(order[lo + i]), int(at[i])
                while k < len(keys) and keys[k] == some[i]:  # equal keys stand side by side
                    entry = body[int(offsets[k]) : int(offsets[k + 1])].tobytes()
                    size = struct.unpack_from("<I", entry)[0]
                    if entry[4 : 4 + size] == texts[where]:
                        out[where] = entry[4 + size :]
                    k += 1
        return out


def split_url(url: bytes | None) -> tuple[bytes, bytes]:
    """Host (A-Z lower-cased) and path of a URL; both empty without `://`."""
    if not url or b"://" not in url:
        return b"", b""
    rest = url[url.index(b"://") + 3 :]
    cut = min((i for i in (rest.find(b"/"), rest.find(b"?"), rest.find(b"#")) if i >= 0), default=len(rest))
    path = rest[cut:]
    cut_path = min((i for i in (path.find(b"?"), path.find(b"#")) if i >= 0), default=len(path))
    return rest[:cut].lower(), path[:cut_path]


_ARRAYS: dict[tuple[str, ...], DigestArray] = {}
memo("url_filter", _ARRAYS.clear)


def _array(names: tuple[str, ...]) -> DigestArray:
    if names not in _ARRAYS:
        _ARRAYS.clear()
        _ARRAYS[names] = DigestArray([SparkFiles.get(x) for x in names])
    return _ARRAYS[names]


def publish(entries: DataFrame, run_bytes: int = 8 << 20) -> tuple[str, ...]:
    """Write (text binary, verdict string) entries as sorted runs and have every executor fetch them;
    returns the files' names."""
    spark = entries.sparkSession
    path = shared_dir(spark, "digests")
    # unsigned order of the keys
    entries = materialize(entries.select("text", "verdict", F.xxhash64("text").bitwiseXOR(F.lit(-(1 << 63))).alias("key")), "entries")
    size = entries.agg(F.sum(F.octet_length("text") + 28)).first()[0] or 0
    runs = max(1, -(-size // run_bytes))

    def write(batches):
        begin("url_filter")
        held = []
        for batch in batches:
            held += zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist())
        if held:
            fs, folder = pyarrow.fs.FileSystem.from_uri(path)
            fs.create_dir(folder, recursive=True)
            name = f"digests-{uuid.uuid4().hex}.bin"  # an attempt that fails leaves a file that nothing names
            with fs.open_output_stream(f"{folder}/{name}") as out:
                out.write(pack(held))
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["file"])

    dealt = entries.repartitionByRange(runs, "key").select("text", "verdict")
    names = tuple(sorted(r.file for r in dealt.mapInArrow(write, "file string").collect()))  # one row a run
    for name in names:
        spark.sparkContext.addFile(f"{path}/{name}")
    return names


def judge(pages: DataFrame, rules: list[tuple[str, str]], *, blocklist: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", run_bytes: int = 8 << 20) -> DataFrame:
    """Per row: id, host, path, rule and verdict. rules: (allow or block, host/path); of the rules
    that fit a URL the longest decides, and of equal ones block. Where none fits, hosts with a label of
    the blocklist (label string; by default default_blocklist) are blocked, and the rest allowed."""
    spark = pages.sparkSession
    entries: dict[bytes, str] = {}
    for verdict, rule in sorted(rules):  # allow before block, which then holds
        host, _, path = rule.partition("/")
        entries[host.encode().lower() + b"/" + path.encode()] = verdict
    lengths = sorted({len(rule.partition("/")[2].encode()) + 1 for _, rule in rules}, reverse=True)
    labels = default_blocklist(spark) if blocklist is None else blocklist
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    label = F.concat(F.lit(bytearray(_LABEL)), F.translate("label", upper, lower).cast("binary"))
    table = labels.where("label is not null").select(label.alias("text"), F.lit("block").alias("verdict")).distinct()
    if entries:
        made = spark.createDataFrame([(bytearray(k), v) for k, v in entries.items()], "text binary, verdict string")
        table = table.union(made)
    names = publish(table, run_bytes)

    def candidates(host: bytes, path: bytes) -> list[bytes]:
        labels = host.split(b".") if host else []
        suffixes = [b".".join(labels[i:]) for i in range(len(labels))]
        starts = [path[:n] for n in lengths if n <= len(path)]
        return [s + p for s in suffixes for p in starts] + [_LABEL + x for x in labels]

    def run(batches):
        begin("url_filter")
        array = _array(names)
        for batch in slices(batches, 2048):
            urls = [split_url(u) for u in texts_of(batch.column(1))]
            probes = [candidates(*u) for u in urls]
            found = array.find([p for some in probes for p in some])
            at, rules_out, verdicts = 0, [], []
            for some in probes:
                hits = [(len(p), p, v) for p, v in zip(some, found[at : at + len(some)]) if v is not None]
                at += len(some)
                fitting = [h for h in hits if not h[1].startswith(_LABEL)]
                best = max(fitting, default=None)
                rules_out.append(best[1].decode() if best else None)
                verdicts.append(best[2].decode() if best else "block" if hits else "allow")
            columns = [batch.column(0), pa.array([u[0].decode() for u in urls], pa.string()), pa.array([u[1].decode() for u in urls], pa.string()), pa.array(rules_out, pa.string()), pa.array(verdicts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "host", "path", "rule", "verdict"])

    return pages.select(id_col, url_col).mapInArrow(run, f"`{id_col}` {type_name(pages, id_col)}, host string, path string, rule string, verdict string")
