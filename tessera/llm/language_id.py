"""Language identification by cross-parsing entropy.

A suffix automaton is built over labelled text of each language. A text is parsed greedily into the
longest phrases that occur in the language's text. A phrase costs the bits that name a place in that
text and the byte after it, log2(256 n) for n bytes, so phrases of languages with little text count
for less; the language with the fewest bits per symbol wins. Many segments of texts are parsed side
by side: one step moves each of them, in each language, by one symbol. Automata are packed (a state's
transitions lie between those of others), which takes some 30 bytes per byte of labelled text, so a
hundred languages fit in a worker; tasks build them, one per language.

Training text is a bounded sample: per language, `sample_chars` characters of the rows with the
smallest hash of id and text, `row_chars` at most of each row, so that neither row order nor source
matters. Everything else covers all rows and whole texts, cut into segments of `segment` bytes for the
parse: none is left out, and a cut adds one phrase in every language.

Null texts and texts without a letter are `und` with score 0. Rows are judged alone, so ties in
the data and repeated rows and ids, null ids too, give repeated results; ties of languages go to the
first in sort order. Without labelled rows every text is `und`; a row without text or language
teaches nothing; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .textkit import begin, memo, slices, texts_of, type_name

_DROP = bytes(b for b in range(128) if not chr(b).isalpha())
_BLANK = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def letters(text: bytes) -> bytes:
    """Lower-cased letters of the text with single spaces between runs, one space at either end."""
    low = text.decode("utf-8").lower().encode() if not text.isascii() else text.lower()
    return b" " + b" ".join(low.translate(_BLANK).split()) + b" "


def has_letter(text: bytes) -> bool:
    if text.translate(None, _DROP):
        if any(chr(b).isalpha() for b in set(text) if b < 128):
            return True
        return any(c.isalpha() for c in set(text.decode("utf-8")))
    return False


def suffix_automaton(symbols: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings, from state 0."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        here = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = here
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[here] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[here] = twin
        last = here
    return step


def packed(step: list[dict[int, int]]) -> np.ndarray:
    """(2, slots) array: state s with place b has its transition by byte c in slot b + c, if row 1 holds
    b there; row 0 has the next state's place. No two states share a place, and the root's is 0."""
    transitions = sum(map(len, step))
    free = bytearray(b"\1") * (2 * transitions + 1024)
    place, taken = [0] * len(step), {0}
    for c in step[0]:
        free[c] = 0
    # the states with most transitions first, each at the first place where all of them fit
    low = 0
    for s in sorted(range(1, len(step)), key=lambda s: -len(step[s])):
        out = list(step[s])
        if len(out) < 2:
            break
        at, tries = free.find(1, low), 0
        while (b := at - out[0]) < 0 or b in taken or not all(free[b + c] for c in out):
            at, tries = free.find(1, at + 1), tries + 1
        if tries > 100:
            low += (at - low) // 2  # too full
        place[s] = b
        taken.add(b)
        for c in out:
            free[b + c] = 0
    at, end = 255, 0
    for s, out in enumerate(step):
        if s and len(out) == 1:
            (c,) = out
            at = free.find(1, at + 1)
            while at - c in taken:
                at = free.find(1, at + 1)
            free[at], place[s] = 0, at - c
            taken.add(at - c)
    table = np.full((2, max(taken) + 513 + len(step)), -1, np.int32)
    end = max(taken) + 256
    for s, out in enumerate(step):
        if s and not out:
            place[s], end = end, end + 1  # nothing leads on from here
    for s, out in enumerate(step):
        for c, to in out.items():
            table[:, place[s] + c] = place[to], place[s]
    return np.ascontiguousarray(table[:, : end + 256])


class CrossParser:
    """Parses texts against the automata of all languages at once; automata: language to (packed
    automaton, bytes of its text)."""

    def __init__(self, automata: dict[str, tuple[np.ndarray, int]], segment: int = 512):
        self.languages = sorted(automata)
        self.segment = segment
        tables = [automata[x][0] for x in self.languages]
        ends = np.cumsum([0] + [t.shape[1] for t in tables])
        kind = np.int32 if ends[-1] < 1 << 31 else np.int64
        joined = [np.where(t >= 0, t + at, -1).astype(kind) for t, at in zip(tables, ends.tolist())]
        self.next, self.owner = (np.concatenate([t[k] for t in joined]) if joined else np.empty(0, kind) for k in (0, 1))
        self.starts = ends[:-1].astype(kind)
        self.bits = np.array([np.log2(256 * max(1, automata[x][1])) for x in self.languages])

    @classmethod
    def learn(cls, samples: dict[str, bytes], segment: int = 512) -> CrossParser:
        return cls({lang: learned(text) for lang, text in samples.items()}, segment)

    def phrases(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases per text and language, symbols per text); texts as letters() gives them."""
        pieces = [t[a : a + self.segment] for t in texts for a in range(0, len(t), self.segment)]
        owner = np.repeat(np.arange(len(texts)), [-(-len(t) // self.segment) for t in texts])
        total = np.zeros((len(texts), len(self.languages)), np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        order = sorted(range(len(pieces)), key=lambda k: -len(pieces[k]))
        for lo in range(0, len(order), 4096):
            some = order[lo : lo + 4096]
            np.add.at(total, owner[some], self._parse([pieces[k] for k in some]))
        return total, sizes

    def _step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        at = state + symbol
        return np.where(self.owner[at] == state, self.next[at], -1)

    def _parse(self, pieces: list[bytes]) -> np.ndarray:
        """pieces from the longest to the shortest."""
        n, k, width = len(pieces), len(self.languages), len(pieces[0])
        lengths = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width) for p in pieces), np.uint8).reshape(n, width)
        columns = np.ascontiguousarray(raw.T).astype(self.next.dtype)
        live = np.searchsorted(-lengths, -np.arange(width), side="left")  # pieces longer than the position
        root = np.repeat(self.starts[:, None], n, axis=1)
        state = root.copy()
        count = np.zeros((k, n), np.int32)
        for at in range(width):
            m = live[at]
            symbol, start = columns[at, :m], root[:, :m]
            to = self._step(state[:, :m], symbol)
            ends = to < 0
            # a phrase begins where one has ended, and after a symbol that is in no phrase
            count[:, :m] += ends | (state[:, :m] == start)
            if ends.any():
                again = self._step(start, symbol)
                to = np.where(ends, np.where(again < 0, start, again), to)
            state[:, :m] = to
        return count.T

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        rows = [i for i, t in enumerate(texts) if t and has_letter(t)] if self.languages else []
        for lo in range(0, len(rows), 2000):
            some = rows[lo : lo + 2000]
            count, sizes = self.phrases([letters(texts[i]) for i in some])
            rate = count * self.bits / np.maximum(sizes, 1)[:, None]
            best = rate.argmin(axis=1)
            ordered = np.sort(rate, axis=1)
            # how far the next language is behind, from 0 (level) to 1
            score = 1 - ordered[:, 0] / ordered[:, 1] if rate.shape[1] > 1 else np.ones(len(some))
            for i, b, s in zip(some, best.tolist(), score.tolist()):
                langs[i], scores[i] = self.languages[b], float(min(max(s, 0.0), 1.0))
        return langs, scores


def learned(text: bytes) -> tuple[np.ndarray, int]:
    """Packed automaton of a language's text, and the bytes in it."""
    clean = letters(text)
    return packed(suffix_automaton(clean)), len(clean)


def samples(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_chars: int = 40_000, row_chars: int = 2_000) -> DataFrame:
    """(lang, text): per language the first `row_chars` characters of the rows with the smallest hash
    of id and text, up to `sample_chars` in all."""
    text = F.substring(text_col, 1, row_chars)
    usable = labelled.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(lang_col).alias("lang"), text.alias("text"), F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)), F.lit(1 << 32)).alias("h"))
    # characters by the highest bit of the hash: 33 sums a language tell which bits are enough, so that
    # what is shuffled does not grow with the rows; repeated rows fall together before
    bit = F.floor(F.log2(F.col("h") + 1)).cast("int")
    limits, held = {}, {}
    for lang, k, size in sorted(map(tuple, usable.groupBy("lang", bit).agg(F.sum(F.length("text"))).collect())):
        if held.get(lang, 0) < sample_chars:
            held[lang] = held.get(lang, 0) + size
            limits[lang] = 2 ** (k + 1) - 1
    limit = F.element_at(F.from_json(F.lit(json.dumps(limits)), "map<string,bigint>"), F.col("lang"))
    few = usable.where(F.col("h") < limit).groupBy("lang", "h", "text").agg(F.count("*").alias("times"))
    run = Window.partitionBy("lang").orderBy("h", "text")
    before = F.coalesce(F.sum(F.length("text") * F.col("times")).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # so many of equal rows as there is room for
    room = F.ceil((F.lit(sample_chars) - F.col("before")) / F.length("text"))
    kept = few.withColumn("before", before).where(F.col("before") < sample_chars)
    parts = kept.select("lang", "h", F.repeat(F.concat("text", F.lit(" ")), F.least("times", room).cast("int")).alias("text"))
    return parts.groupBy("lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("h", "text"))), lambda x: x["text"]), "").alias("text"))


def train(labelled: DataFrame, **options) -> dict[str, tuple[np.ndarray, int]]:
    """Automata of all languages, built by tasks; what comes to the driver is bounded by languages and
    `sample_chars`."""

    def run(batches):
        begin("language_id")
        for batch in slices(batches, 1):
            table, size = learned(texts_of(batch.column(1))[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([table.tobytes()], pa.binary()), pa.array([size], pa.int64())], ["lang", "table", "size"])

    rows = samples(labelled, **options).mapInArrow(run, "lang string, table binary, size bigint").collect()
    return {r.lang: (np.frombuffer(r.table, np.int32).reshape(2, -1), r.size) for r in rows}


_PARSERS: dict[str, CrossParser] = {}
memo("language_id", _PARSERS.clear)


def _parser(key: str, automata: dict) -> CrossParser:
    """The worker's parser for one call of identify()."""
    if key not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[key] = CrossParser(automata)
    return _PARSERS[key]


def identify(docs: DataFrame, labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, **options) -> DataFrame:
    """Per row: id, carried columns, lang_pred, score."""
    kept = [id_col, *(carry or [])]
    read = list(dict.fromkeys([*kept, text_col]))
    # some 30 bytes per byte of labelled text, of which there are `sample_chars` characters a language
    sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, train(labelled, id_col=id_col, text_col=text_col, **options)))
    schema = ", ".join(f"`{c}` {type_name(docs, c)}" for c in kept)

    def run(batches):
        begin("language_id")
        parser = _parser(*sent.value)
        for batch in slices(batches, 1024):
            langs, scores = parser.predict(texts_of(batch.column(read.index(text_col))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*kept, "lang_pred", "score"])

    return docs.select(*read).mapInArrow(run, f"{schema}, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that training never sees; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1
