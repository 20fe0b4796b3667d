"""BPE encoding and decoding by a bounded-lookahead streaming transducer.

A merge list fixes how far to the right a decision can reach: a merge to the right takes a symbol
away from a later merge to its left, which frees the next symbol, and so on, with strictly rising
ranks. `sufficient_lookahead` follows these chains once over the merge list. A token that ends
that many symbols before the end of what was read can no longer change, so `PieceTransducer`
emits it and keeps only the rest: memory stays constant for a piece of any length. Cutting at a
token boundary is exact, because no merge crosses it. Every piece (pre-token) goes through a
transducer; many run side by side, and their merges of short rests are done together.

Texts are taken in slices that end where a piece certainly ends (at white space, or between ASCII
characters of different classes), so lists of a slice's words are all that is held beside the text.
Ids go to `TextDecoder` slice by slice, a state machine over the tokens' bytes that holds back only an
unfinished UTF-8 sequence; digests are updated as ids and text come.

Nulls are empty texts and give no ids; a text of any length is encoded whole; rows are independent,
so repeated rows and ids, null ids and ties give repeated results; an empty table gives an empty
result. Only the named columns are read, whatever others are called.
"""

from __future__ import annotations

import codecs
import gc
import hashlib
import heapq
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .textkit import begin, memo, slices, texts_of, type_name

_CHUNKS = 300_000  # entries of the memo from white-space-free chunks to ids
_PIECES = 300_000
_SIDE_BY_SIDE = 64  # bytes of a string up to which merges are done in numpy
_WINDOW = 256  # bytes that a transducer takes at a time
_SLICE = 1 << 18  # bytes of text that are split at a time
assert sys.byteorder == "little" and array("I").itemsize == 4
# Unicode White_Space, written out so that every regex engine agrees.
_WHITE = "".join(map(chr, [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_WHITE}\p{{L}}\p{{N}}]+")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


class MergeTable:
    """Vocabulary and merges of a tokenizer file, its special tokens and its sufficient lookahead."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.letters = byte_letters()
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        for rank, (a, b) in enumerate(pairs):
            self.pairs[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        self.ranks = {pair: rank for pair, (rank, _) in self.pairs.items()}
        self.made = [self.vocab[a + b] for a, b in pairs]
        self.tokens: dict[int, str] = {i: t for t, i in {**self.vocab, **self.special}.items()}
        self.first = [self.vocab[c] for c in self.letters]
        self.last = [self.vocab[c + self.suffix] for c in self.letters]
        self.width = {i: len(t.removesuffix(self.suffix) if self.suffix else t) for t, i in self.vocab.items()}
        self.lookahead = self.sufficient_lookahead()
        self._keys = self._by_key = self._slots = self._clash = None
        self._names: dict[str, np.ndarray] = {}

    def names(self, form: str) -> np.ndarray:
        """Bytes of each token: of its string, or those that it stands for."""
        if form not in self._names:
            value = {c: b for b, c in enumerate(self.letters)}
            out = np.full(max(self.tokens) + 1, b"", object)
            for i, text in self.tokens.items():
                if form == "joined" or text in self.special:
                    out[i] = text.encode()
                else:
                    ends = bool(self.suffix) and text.endswith(self.suffix)
                    out[i] = bytes(value[c] for c in (text.removesuffix(self.suffix) if ends else text)) + b" " * ends
            self._names[form] = out
        return self._names[form]

    def sufficient_lookahead(self) -> int:
        """Symbols to the right that can still change a token.

        Walking the merges from the last rank to the first, reach[x] is the longest stretch of
        symbols left of x that rules of later ranks than the current one can change once x is
        taken or freed: rule (c, x) changes c and goes on from c or from its product.
        """
        reach: dict[int, int] = {}
        for (c, x), (_, made) in sorted(self.pairs.items(), key=lambda e: -e[1][0]):
            far = self.width[c] + max(reach.get(c, 0), reach.get(made, 0))
            reach[x] = max(reach.get(x, 0), far)
        return max(reach.values(), default=0) + max(self.width.values(), default=1)

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply the merges by rank, leftmost first."""
        return self._merge_short(symbols) if len(symbols) <= 40 else self._merge_long(symbols)

    def _merge_short(self, symbols: list[int]) -> list[int]:
        rank, made, none = self.ranks.get, self.made, len(self.made)
        steps = [rank(p, none) for p in zip(symbols, symbols[1:])]
        while steps and (best := min(steps)) < none:
            i = steps.index(best)
            symbols[i] = made[best]
            del symbols[i + 1], steps[i]
            if i:
                steps[i - 1] = rank((symbols[i - 1], symbols[i]), none)
            if i < len(steps):
                steps[i] = rank((symbols[i], symbols[i + 1]), none)
        return symbols

    def _merge_long(self, symbols: list[int]) -> list[int]:
        n, known = len(symbols), self.pairs.get
        right, left, live = list(range(1, n + 1)), list(range(-1, n - 1)), list(symbols)
        heap = [(s[0], i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (s := known((symbols[i], symbols[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if live[i] != a or j >= n or live[j] != b:
                continue
            live[i], live[j], right[i] = known((a, b))[1], -1, right[j]
            if right[j] < n:
                left[right[j]] = i
            for p, q in ((left[i], i), (i, right[i])):
                if p >= 0 and q < n and (s := known((live[p], live[q]))):
                    heapq.heappush(heap, (s[0], p, live[p], live[q]))
        return [x for x in live if x >= 0]


    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of whole pieces, each from a transducer of its own."""
        return transduce(self, [p.encode() for p in pieces])

    def merge_many(self, held: list[tuple[bytes, bool]]) -> list[list[int]]:
        """Tokens of many byte strings; with True the last byte ends a word. Short ones are merged side
        by side."""
        out: list[list[int]] = [[]] * len(held)
        groups: dict[int, list[int]] = {}
        for k, (data, _) in enumerate(held):
            if len(data) <= _SIDE_BY_SIDE:
                groups.setdefault(-(-len(data) // 4) * 4, []).append(k)
            else:
                out[k] = self.merge(self.symbols(*held[k]))
        for width, group in groups.items():
            for at in range(0, len(group), 1 << 14):
                part = group[at : at + (1 << 14)]
                symbols, counts = self._merge_side_by_side([held[k] for k in part], width)
                for k, row, n in zip(part, symbols.tolist(), counts.tolist()):
                    out[k] = row[:n]
        return out

    def symbols(self, data: bytes, ends: bool) -> list[int]:
        out = [self.first[b] for b in data]
        if ends and out:
            out[-1] = self.last[data[-1]]
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of symbol pairs; len(made) where no rule joins them."""
        if self._keys is None:
            keys = np.array([a << 20 | b for a, b in self.ranks], np.int64)
            order = np.argsort(keys)
            self._keys, self._by_key = keys[order], np.array(list(self.ranks.values()), np.int32)[order]
            slots = np.full(1 << 20, -1, np.int32)
            at = self._slot(self._keys)
            slots[at] = np.arange(len(keys))
            self._slots, self._clash = slots, np.zeros(1 << 20, bool)
            self._clash[at[slots[at] != np.arange(len(keys))]] = True
        keys = (left.astype(np.int64) << 20 | right).ravel()
        slot = self._slot(keys)
        at = self._slots[slot]
        if (odd := np.flatnonzero(self._clash[slot])).size:
            at[odd] = np.minimum(np.searchsorted(self._keys, keys[odd]), len(self._keys) - 1)
        return np.where((at >= 0) & (self._keys[at] == keys), self._by_key[at], len(self.made)).reshape(left.shape)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def _merge_side_by_side(self, held: list[tuple[bytes, bool]], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Each round joins the best pair of every string."""
        n, none = len(held), len(self.made)
        counts = np.array([len(p) for p, _ in held])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p, _ in held), np.uint8).reshape(n, width)
        first, last, made = np.array(self.first, np.int32), np.array(self.last, np.int32), np.array(self.made, np.int32)
        symbols, column = first[raw], np.arange(width)
        ending = np.flatnonzero([ends for _, ends in held])
        symbols[ending, counts[ending] - 1] = last[raw[ending, counts[ending] - 1]]
        ranks = np.full((n, width), none, np.int32)
        ranks[:, : width - 1] = np.where(column[1:] < counts[:, None], self._ranks(symbols[:, :-1], symbols[:, 1:]), none)
        live = np.arange(n)
        done, done_counts = symbols.copy(), counts.copy()
        while live.size:
            at = ranks.argmin(axis=1)
            row = np.arange(len(at))
            best = ranks[row, at]
            going = best < none
            if not going.all():
                ended = ~going
                done[live[ended]], done_counts[live[ended]] = symbols[ended], counts[ended]
                live, symbols, ranks, counts, at, best = live[going], symbols[going], ranks[going], counts[going], at[going], best[going]
                row = np.arange(len(at))
            moved = column[: width - 1] > at[:, None]
            symbols[:, :-1] = np.where(moved, symbols[:, 1:], symbols[:, :-1])
            ranks[:, :-1] = np.where(moved | (column[: width - 1] == at[:, None]), ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = none
            symbols[row, at] = made[best]
            counts = counts - 1
            has = np.flatnonzero(at + 1 < counts)
            ranks[has, at[has]] = self._ranks(symbols[has, at[has]], symbols[has, at[has] + 1])
            ranks[row[at + 1 >= counts], at[at + 1 >= counts]] = none
            has = np.flatnonzero(at > 0)
            ranks[has, at[has] - 1] = self._ranks(symbols[has, at[has] - 1], symbols[has, at[has]])
        return done, done_counts


class PieceTransducer:
    """Encodes one piece fed in slices of bytes; tokens come out once no later byte can change them.

    `take` accepts a window of bytes and tells whether there is enough to emit; `rest` is what is to be
    merged, and `settle` emits of its tokens those that are stable, or at the end all.
    """

    __slots__ = ("table", "window", "held", "ended")

    def __init__(self, table: MergeTable, window: int = _WINDOW):
        self.table, self.window, self.held, self.ended = table, window, bytearray(), False

    def take(self, data: bytes, last: bool) -> bool:
        self.held += data
        self.ended = last
        return last or len(self.held) > self.table.lookahead + self.window

    def rest(self) -> tuple[bytes, bool]:
        return bytes(self.held), self.ended

    def settle(self, tokens: list[int]) -> list[int]:
        if self.ended:
            self.held.clear()
            return tokens
        done, n, widths = 0, 0, self.table.width
        limit = len(self.held) - self.table.lookahead - 1  # the last byte may yet take the end-of-word form
        for n, token in enumerate(tokens):
            if done + widths[token] > limit:
                break
            done += widths[token]
        del self.held[:done]
        return tokens[:n]

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for at in range(0, len(data), self.window):
            if self.take(data[at : at + self.window], False):
                out += self.settle(self.table.merge(self.table.symbols(*self.rest())))
        return out

    def finish(self) -> list[int]:
        self.take(b"", True)
        return self.settle(self.table.merge(self.table.symbols(*self.rest())))


def transduce(table: MergeTable, pieces: list[bytes], window: int = _WINDOW) -> list[bytes]:
    """Ids of each piece, little-endian: all transducers take a window in turn, and those that can emit
    are merged together."""
    out = [b""] * len(pieces)
    live = [(k, PieceTransducer(table, window)) for k in range(len(pieces))]
    at = 0
    while live:
        ready = [(k, t) for k, t in live if t.take(pieces[k][at : at + window], at + window >= len(pieces[k]))]
        for (k, t), tokens in zip(ready, table.merge_many([t.rest() for _, t in ready])):
            out[k] += array("I", t.settle(tokens)).tobytes()
        live = [(k, t) for k, t in live if not t.ended]
        at += window
    return out


class TextDecoder:
    """Ids to text, slice by slice.

    `joined` writes token strings with single spaces between, as the library does for files that
    name no decoder; `bytes` undoes the byte letters and turns word ends into spaces. Either way tokens
    are bytes, of which those of an unfinished character are held back.
    """

    def __init__(self, table: MergeTable, form: str = "joined"):
        self.form, self.special, self.begun = form, table.special, False
        self.names = table.names(form)
        self.marks = np.array(sorted(table.special.values()), np.int64)
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        ids = np.asarray(ids, np.int64).reshape(-1)
        if not len(ids):
            return ""
        if self.form == "joined":
            raw = b" ".join(self.names[ids].tolist())
            raw, self.begun = b" " + raw if self.begun else raw, True
            return self.utf8.decode(raw)
        out, lo = [], 0
        for k in np.flatnonzero(np.isin(ids, self.marks)).tolist():  # a mark ends what is unfinished
            out += [self.utf8.decode(b"".join(self.names[ids[lo:k]].tolist()), final=True), self.names[ids[k]].decode()]
            lo = k + 1
        return "".join(out) + self.utf8.decode(b"".join(self.names[ids[lo:]].tolist()))

    def finish(self) -> str:
        return self.utf8.decode(b"", final=True)


def lower(text: str) -> str:
    """Letter by letter, so that no rule looks at neighbours (final sigma)."""
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)


class ChunkEncoder:
    """Texts to little-endian 32-bit ids. Chunks between ASCII white space are independent, so their
    ids are memoised, in bounded memos. `encode_pieces` maps pre-tokens to their ids."""

    def __init__(self, special: dict[str, int], encode_pieces: Callable[[list[str]], list[bytes]], most_chunks: int = _CHUNKS, most_pieces: int = _PIECES):
        self.special, self.encode_pieces = special, encode_pieces
        self.most_chunks, self.most_pieces = most_chunks, most_pieces
        self.chunks: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.marks = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    def split(self, text: str) -> list[str | int]:
        """Pre-tokens of a chunk; special tokens as their ids."""
        if not text.isascii():
            if "Σ" in text or not unicodedata.is_normalized("NFC", text):
                return self._split(text)
        low = text.lower()  # which may add marks, so it is what must be letters
        if low.isalpha():
            return [low]
        if low[:-1].isalpha() and low[-1] in ".,;:!?)":
            return [low[:-1], low[-1]]
        return self._split(text)

    def _split(self, text: str) -> list[str | int]:
        out: list[str | int] = []
        for k, part in enumerate(self.marks.split(text) if self.marks and "<|" in text else (text,)):
            if k % 2:
                out.append(self.special[part])
            else:
                out += _SPLIT.findall(lower(part if part.isascii() else unicodedata.normalize("NFC", part)))
        return out

    def learn(self, chunks: set[bytes]) -> None:
        raws = list(chunks)
        parts = [self.split(raw.decode()) for raw in raws]
        new = {p for part in parts for p in part if type(p) is str and p not in self.pieces}
        if len(self.pieces) + len(new) > self.most_pieces:
            self.pieces.clear()
            new = {p for part in parts for p in part if type(p) is str}
        ordered = list(new)
        self.pieces.update(zip(ordered, self.encode_pieces(ordered)))
        known, out = self.pieces, self.chunks
        for raw, part in zip(raws, parts):
            if len(part) == 1 and type(part[0]) is str:
                out[raw] = known[part[0]]
            else:
                out[raw] = b"".join([known[p] if type(p) is str else p.to_bytes(4, "little") for p in part])

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of whole texts."""
        out: list[list[bytes]] = [[] for _ in texts]
        for k, ids in self.stream(texts):
            out[k].append(ids)
        return [b"".join(x) for x in out]

    def stream(self, texts: list[bytes | None]) -> Iterator[tuple[int, bytes]]:
        """(text, ids of its next slice), text by text; slices of several texts are looked up together."""
        held, size = [], 0
        for k, text in enumerate(texts):
            for part in slices_of(text or b""):
                held.append((k, part))
                size += len(part)
                if size >= 1 << 20:
                    yield from self._encode(held)
                    held, size = [], 0
        yield from self._encode(held)

    def _encode(self, held: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
        collecting = gc.isenabled()
        gc.disable()  # nothing here makes cycles, and passes over the memos are long
        rows = [part.split() for _, part in held]
        seen = set().union(*rows)
        new = {c for c in seen if c not in self.chunks}
        if len(self.chunks) + len(new) > self.most_chunks:
            self.chunks.clear()
            new = seen
        self.learn(new)
        ids = self.chunks.__getitem__
        out = [(k, b"".join(map(ids, row))) for (k, _), row in zip(held, rows)]
        if collecting:
            gc.enable()
        return out


# White space, or between two ASCII characters of different classes, of which neither can be part of a
# contraction or a special token, nor be changed by what stands beside them.
_SAFE_END = re.compile(rb"[\t-\r ]|[0-9](?=[0-9A-Za-z!-&(-/:;=?-@\[-`{}~])|[A-Za-z](?=[0-9!-&(-/:;=?-@\[-`{}~])|[!-&(-/:;=?-@\[-`{}~](?=[0-9A-Za-z])")


def slices_of(text: bytes, size: int = _SLICE) -> Iterator[bytes]:
    """A text in slices of about `size` bytes, or more where no place is safe to cut."""
    at = 0
    while len(text) - at > size:
        found = _SAFE_END.search(text, at + size)
        if not found:
            break
        yield text[at : found.end()]
        at = found.end()
    if at < len(text) or not at:
        yield text[at:]


@lru_cache(2)
def table_of(path: str) -> MergeTable:
    return MergeTable(path)


@lru_cache(2)
def encoder_of(path: str) -> ChunkEncoder:
    table = table_of(path)
    return ChunkEncoder(table.special, table.encode_pieces)


def _forget() -> None:
    encoder_of.cache_clear()
    table_of.cache_clear()


memo("bpe", _forget)


def encode_decode(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ids (binary, little-endian u32) and decoded text; with keep_text=False
    their SHA-256 in hex instead, so that no id or text leaves the task."""
    kind = type_name(docs, id_col)
    tail = "ids binary, decoded string" if keep_text else "ids_sha256 string, decoded_sha256 string"
    names = [id_col, "n_tokens", *(x.split()[0] for x in tail.split(", "))]
    kinds = (pa.int64(), pa.binary() if keep_text else pa.string(), pa.string())

    def run(batches):
        begin("bpe")
        encoder, table = encoder_of(tokenizer), table_of(tokenizer)
        for batch in slices(batches):
            sinks = [_Kept() if keep_text else _Hashed() for _ in range(batch.num_rows)]
            decoders = [TextDecoder(table) for _ in sinks]
            for k, ids in encoder.stream(texts_of(batch.column(1))):
                sinks[k].add(ids, decoders[k].feed(np.frombuffer(ids, "<u4")))
            for sink, decoder in zip(sinks, decoders):
                sink.add(b"", decoder.finish())
            columns = [pa.array(c, t) for c, t in zip(zip(*(x.result() for x in sinks)), kinds)] if sinks else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, {tail}")


class _Hashed:
    """Digests of ids and text as they come."""

    def __init__(self):
        self.n, self.ids, self.text = 0, hashlib.sha256(), hashlib.sha256()

    def add(self, ids: bytes, text: str) -> None:
        self.n += len(ids) // 4
        self.ids.update(ids)
        self.text.update(text.encode())

    def result(self) -> tuple:
        return self.n, self.ids.hexdigest(), self.text.hexdigest()


class _Kept:
    """Ids and text themselves."""

    def __init__(self):
        self.ids, self.text = [], []

    def add(self, ids: bytes, text: str) -> None:
        self.ids.append(ids)
        self.text.append(text)

    def result(self) -> tuple:
        ids = b"".join(self.ids)
        return len(ids) // 4, ids, "".join(self.text)
