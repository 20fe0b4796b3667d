"""Secret scans in DataFrame and SQL functions only.

Fixed rules find assigned values, access keys and long hex strings. Beside them, two character
Markov models, one of random strings and one of ordinary identifiers, score what the rules leave:
runs of letters, digits and `+/_=-` of `min_token` characters or more, after the rules' spans are cut
out. A run whose mean log-likelihood ratio per character pair reaches the model's threshold is a secret
of kind `markov`.

Both models are trained from labelled samples: keys of several alphabets made from digests, and
identifiers as programs and addresses have them (camel case, snake case, paths, numbers and more) made
from words of a fixed list and of a bounded sample of the documents. Half of either sample is held
out; the threshold is what all but `most_missed` of the held-out random strings of every kind reach, or,
where that is more, what no more than `most_false` of the ordinary ones of any kind reach.

Spans count code points of the whole text, end exclusive; spans of one kind never overlap, and
markov spans overlap no other. A null text is empty and has no spans; repeated rows, ids and null ids
give repeated results; an empty table gives an empty result (words are then those of the list alone).
Columns called like those that are added are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The rules' patterns. A kind with a shortest length drops shorter matches.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}+"  # a run of 24 or more is the run's match, as runs are leftmost and longest
KINDS = ["assign", "access", "hex", "markov"]
_TOKEN_CHARS = "A-Za-z0-9+/_=-"
# Words of ordinary identifiers, beside those of the corpus.
WORDS = (
    "access account action active add address admin agent album alias alert amount app array asset async audio auth author auto avatar back backup balance bank base batch binary block body book bool border bottom box branch browser buffer build button byte cache call camera card cart case category cell center chain change channel chart check child class clean clear click client clock close cloud code color column command comment commit common compare config confirm connect content context control convert copy core count create current custom data date day debug default delete "
    "delta device dialog directory display document domain double download draw driver edit email empty enable encode end engine entry error event example export factory field file filter final find first flag float folder font form format frame function gateway general get global graph group handle handler hash head header health height help history home host icon image import index info init input insert instance int internal item iterator job join key kind label language last layout left length level library limit line link list load local lock log login main manager map "
).split()
MARKOV = KINDS.index("markov")
_WIDE = 94  # printable ASCII without the space
_CHUNK = 4096


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _positions(lengths: str) -> str:
    """SQL: running sums (exclusive) of an array, in groups of 256, so that the cost stays near
    linear in its size."""
    groups = f"sequence(0, greatest(size({lengths}) - 1, 0) div 256)"
    bases = f"aggregate({groups}, named_struct('at', 0L, 'out', cast(array() as array<bigint>)), (s, g) -> named_struct('at', s.at + aggregate(slice({lengths}, g * 256 + 1, 256), 0L, (t, x) -> t + x), 'out', array_append(s.out, s.at)), s -> s.out)"
    inner = f"aggregate(slice({lengths}, g * 256 + 1, 256), named_struct('at', b, 'out', cast(array() as array<bigint>)), (s, x) -> named_struct('at', s.at + x, 'out', array_append(s.out, s.at)), s -> s.out)"
    return f"flatten(zip_with({groups}, {bases}, (g, b) -> {inner}))"


def _with_spans(df: DataFrame, name: str, pattern: str, kind: int, may: Column, keep: str = "true") -> DataFrame:
    """Add `name`: array<struct<start, kind, end, text>> of a pattern's matches in column `text`.

    Matches come from regexp_extract_all, the text between them from split; their lengths give the
    positions. keep: SQL over `m` (the match)."""
    empty = F.array().cast("array<string>")
    df = df.withColumn("__m", F.when(may, _all(F.col("text"), pattern)).otherwise(empty))
    df = df.withColumn("__p", F.when(F.size("__m") > 0, F.split("text", pattern, -1)).otherwise(empty))
    # between match i - 1 and match i lie the i-th piece's characters
    df = df.withColumn("__l", F.expr("zip_with(__m, slice(__p, 1, size(__m)), (m, p) -> cast(length(m) + length(p) as bigint))"))
    spans = f"zip_with({_positions('__l')}, zip_with(__m, slice(__p, 1, size(__m)), (m, p) -> named_struct('m', m, 'p', length(p))), (at, x) -> named_struct('start', at + x.p, 'kind', {kind}, 'end', at + x.p + length(x.m), 'text', x.m))"
    none = "cast(array() as array<struct<start: bigint, kind: int, end: bigint, text: string>>)"
    df = df.withColumn(name, F.expr(f"if(size(__m) = 0, {none}, filter({spans}, s -> {keep.replace('$m', 's.text')}))"))
    return df.drop("__m", "__p", "__l")


def base_spans(df: DataFrame) -> DataFrame:
    """Add assign, access and hex spans of column `text`."""
    value = "length(regexp_extract($m, '%s', 2)) >= 6" % ASSIGN.replace("\\", "\\\\").replace("'", "\\'")
    df = _with_spans(df, "assign", ASSIGN, 0, F.col("text").rlike(ASSIGN), value)
    df = _with_spans(df, "access", ACCESS, 1, F.col("text").contains("AKIA"), "length($m) >= 20")
    return _with_spans(df, "hex", HEX, 2, F.col("text").rlike(HEX))




@dataclass(frozen=True)
class Model:
    """Log ratios of all character pairs, row by row, comma-joined; the threshold of the mean; and held-out
    shares of strings at or above it, by kind."""

    ratios: str
    min_ratio: float
    report: dict = field(default_factory=dict)


def _pick(words: Column, n: int, k: int, salt: int) -> Column:
    """k-th word of a row's own choice."""
    return F.element_at(words, (F.pmod(F.xxhash64(F.lit(salt), F.lit(k), "id"), F.lit(n)) + 1).cast("int"))


def labelled(spark: SparkSession, words: list[str], rows: int = 12_000) -> DataFrame:
    """(token, random, kind, held): made strings of every kind, half of them held out."""
    pool = F.split(F.lit(",".join(words)), ",")
    w = [_pick(pool, len(words), k, 7) for k in range(8)]
    low = [F.lower(x) for x in w]
    cap = [F.initcap(F.lower(x)) for x in w]
    number = F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1000)).cast("string")
    digit = lambda k: F.when(F.pmod(F.xxhash64(F.lit(11 + k), "id"), F.lit(3)) == 0, F.pmod(F.xxhash64(F.lit(50 + k), "id"), F.lit(12)).cast("string")).otherwise("")
    date = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), (F.pmod(F.xxhash64("id"), F.lit(25000))).cast("int")), "yyyy-MM-dd")
    digits = F.abs(F.xxhash64(F.lit(5), "id")).cast("string")
    numbered = [F.concat(x, digit(k)) for k, x in enumerate(low)]
    ordinary = {
        "camel": F.concat(low[0], *cap[1:5], digit(0)),
        "pascal": F.concat(*cap[:5], digit(0)),
        "snake": F.concat_ws("_", *numbered[:5]),
        "constant": F.upper(F.concat_ws("_", *numbered[:5])),
        "kebab": F.concat_ws("-", *numbered[:5]),
        "path": F.concat(F.lit("/"), F.concat_ws("/", *numbered[:6])),
        "deep_path": F.concat_ws("/", *[F.concat(x, digit(9 - k)) for k, x in enumerate(cap[:3])], F.concat_ws("-", *low[3:6]), F.concat_ws("_", *low[6:8]), number),
        "query": F.concat(low[0], F.lit("="), low[1], number, F.lit("/"), F.concat_ws("+", *low[2:5])),
        "number": F.concat_ws("-", digits, date, number),
        "file": F.concat_ws("_", low[0], F.translate(date, "-", ""), low[1], number, F.concat(low[2], cap[3])),
        "compound": F.concat(*low[:4]),
        "ruler": F.repeat(F.element_at(F.split(F.lit("-,=,_,/,+,-+,x,=-,o,0"), ","), (F.col("id") % 10 + 1).cast("int")), (20 + F.col("id") % 40).cast("int")),
    }
    # Prefixes that issuers of keys write before them.
    prefix = F.element_at(F.split(F.lit("ghp_,sk_live_,xoxb-,pk_test_,glpat-,npm_,"), ","), (F.col("id") % 7 + 1).cast("int"))
    digest = lambda k: F.sha2(F.concat_ws(":", F.lit(k), "id"), 512)
    packed = lambda k: F.regexp_replace(F.base64(F.unhex(digest(k))), r"[\r\n=]", "")
    length = (20 + F.pmod(F.xxhash64(F.lit(21), "id"), F.lit(45))).cast("int")
    size = lambda c: F.substring(c, F.lit(1), length)
    uuid = F.regexp_replace(F.substring(digest(6), 1, 32), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")
    random = {
        "base62": size(F.translate(packed(0), "+/", "xQ")),
        "base64": size(packed(1)),
        "base64url": size(F.translate(packed(2), "+/", "-_")),
        "base36": size(F.lower(F.translate(packed(3), "+/", "x7"))),
        "base32": size(F.upper(F.translate(packed(4), "+/", "X5"))),
        "upper_hex": F.upper(size(digest(5))),
        "uuid": uuid,
        "prefixed": F.concat(prefix, size(F.translate(packed(7), "+/", "zA"))),
    }
    kinds = [F.struct(F.lit(k).alias("kind"), F.lit(is_random).alias("random"), c.alias("token")) for is_random, some in ((False, ordinary), (True, random)) for k, c in some.items()]
    made = spark.range(rows).select("id", F.explode(F.array(*kinds)).alias("x"))
    return made.where(F.pmod(F.xxhash64("id", "x.kind"), F.lit(8)) == 0).select("x.token", "x.random", "x.kind", (F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(2)) == 1).alias("held"))


def _pair_counts(tokens: DataFrame) -> DataFrame:
    """tokens (token, random boolean) to counts of character pairs."""
    pairs = F.expr("transform(sequence(1, length(token) - 1), i -> (ascii(substring(token, i, 1)) - 33) * 94 + ascii(substring(token, i + 1, 1)) - 33)")
    return tokens.where(F.length("token") >= 2).select("random", F.explode(pairs).alias("pair")).groupBy("random", "pair").count()


def _mean_ratio(token: str, model: str) -> str:
    """SQL: mean log ratio of a token's character pairs; split('') is linear in the token."""
    codes = f"transform(filter(split({token}, ''), c -> c <> ''), c -> ascii(c) - 33)"
    return f"aggregate({codes}, named_struct('sum', 0D, 'before', -1), (s, c) -> named_struct('sum', s.sum + if(s.before < 0, 0D, element_at({model}, s.before * 94 + c + 1)), 'before', c), s -> s.sum / greatest(length({token}) - 1, 1))"


def _sample_words(docs: DataFrame, id_col: str, text_col: str, sample_rows: int, sample_chars: int, sample_words: int) -> list[str]:
    n = docs.count()
    h = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)), F.lit(1 << 32))
    # about twice as many rows as are needed, so that what is sorted does not grow with the tasks
    few = docs.where(F.col(text_col).isNotNull() & (h <= int(min(1.0, 2 * sample_rows / max(1, n)) * (1 << 32))))
    sample = few.select(F.substring(text_col, 1, sample_chars).alias("text"), h.alias("h")).orderBy("h", "text").limit(sample_rows)
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = sample.select(F.explode(_all(clean, r"(?<![A-Za-z0-9+/_=-])[A-Za-z][a-z]{2,13}(?![A-Za-z0-9+/_=-])")).alias("word")).groupBy("word").count()
    return [r.word for r in words.orderBy(F.desc("count"), "word").limit(sample_words).collect()]


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 400, sample_chars: int = 4000, sample_words: int = 300, most_false: float = 0.01, most_missed: float = 0.05) -> Model:
    """Both models and the threshold. Of the corpus it reads the `sample_rows` rows with the smallest
    hash of id and text, at most `sample_chars` characters each, and of those the `sample_words`
    most frequent words."""
    spark = docs.sparkSession
    words = sorted({*WORDS, *_sample_words(docs, id_col, text_col, sample_rows, sample_chars, sample_words)})
    strings = labelled(spark, words).where("length(token) >= 12")
    plain = spark.createDataFrame([(x, False) for x in words], "token string, random boolean")
    counts = {(r.random, r.pair): r["count"] for r in _pair_counts(strings.where("not held").select("token", "random").union(plain)).where("pair between 0 and 8835").collect()}
    total = {k: [0] * _WIDE for k in (True, False)}
    for (kind, pair), c in counts.items():
        total[kind][pair // _WIDE] += c
    # add-a-bit smoothing towards the characters of tokens
    ratio = [math.log((counts.get((True, p), 0) + 0.5) / (total[True][p // _WIDE] + 32)) - math.log((counts.get((False, p), 0) + 0.5) / (total[False][p // _WIDE] + 32)) for p in range(_WIDE * _WIDE)]
    ratios = ",".join(f"{x:.2f}" for x in ratio)
    scored = strings.where("held").withColumn("m", F.split(F.lit(ratios), ",").cast("array<double>")).select("kind", "random", F.expr(_mean_ratio("token", "m")).alias("r"))
    ends = scored.groupBy("kind", "random").agg(F.percentile("r", F.array(F.lit(most_missed), F.lit(1 - most_false))).alias("p"), F.sort_array(F.collect_list("r")).alias("all")).collect()  # some made strings of some kinds
    low = max(r.p[1] for r in ends if not r.random)
    high = min(r.p[0] for r in ends if r.random)
    cut = round(max(low, high), 3)
    return Model(ratios, cut, {r.kind: sum(x >= cut for x in r["all"]) / len(r["all"]) for r in ends})


def _ends_before(spans: str) -> str:
    """SQL: for each span, sorted by start, the largest end of those before it (0 for the first); in
    groups of 256, so that the cost stays near linear."""
    groups = f"sequence(0, greatest(size({spans}) - 1, 0) div 256)"
    part = f"slice({spans}, g * 256 + 1, 256)"
    empty = "cast(array() as array<bigint>)"
    bases = f"aggregate({groups}, named_struct('at', 0L, 'out', {empty}), (s, g) -> named_struct('at', greatest(s.at, aggregate({part}, 0L, (t, x) -> greatest(t, x.end))), 'out', array_append(s.out, s.at)), s -> s.out)"
    inner = f"aggregate({part}, named_struct('at', b, 'out', {empty}), (s, x) -> named_struct('at', greatest(s.at, x.end), 'out', array_append(s.out, s.at)), s -> s.out)"
    return f"flatten(zip_with({groups}, {bases}, (g, b) -> {inner}))"


def _replaced(df: DataFrame, name: str, text: str, spans: str, mark: str) -> DataFrame:
    """Add `name`: the text with every run of spans replaced by the SQL expression `mark` over `n`, the
    characters of the span that no earlier one covers. Texts are cut into chunks first, so that a piece
    is found without going through all that is before it."""
    df = df.withColumn("__c", F.when(F.size(spans) > 0, F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("__b", F.expr(f"if(size({spans}) = 0, cast(array() as array<bigint>), {_ends_before(spans)})"))
    # characters from a to b: the chunks they lie in, joined, and of those the part
    piece = lambda a, b: f"if({b} <= {a}, '', substring(array_join(slice(__c, cast({a} div {_CHUNK} + 1 as int), cast(({b} - 1) div {_CHUNK} - {a} div {_CHUNK} + 1 as int)), ''), cast({a} % {_CHUNK} + 1 as int), cast({b} - {a} as int)))"
    parts = f"zip_with({spans}, __b, (x, b) -> concat({piece('b', 'x.start')}, if(x.end <= b, '', {mark.replace('$n', 'cast(x.end - greatest(x.start, b) as int)').replace('$first', '(x.start >= b)')})))"
    tail = f"aggregate({spans}, 0L, (t, x) -> greatest(t, x.end))"
    df = df.withColumn("__t", F.expr(tail))
    whole = f"concat(array_join({parts}, ''), {piece('__t', f'cast(length(`{text}`) as bigint)')})"
    return df.withColumn(name, F.expr(f"if(size({spans}) = 0, `{text}`, {whole})")).drop("__c", "__b", "__t")


def scan(docs: DataFrame, model: Model, *, text_col: str = "text", min_token: int = 20, min_ratio: float | None = None) -> DataFrame:
    """docs with columns assign, access, hex, markov, base, spans: arrays of (start, kind, end, text),
    the last two sorted by start, then kind. min_ratio: a threshold other than the model's."""
    kept = docs.drop("text", text_col, "assign", "access", "hex", "markov", "base", "spans")
    df = docs.select(F.coalesce(text_col, F.lit("")).alias("text"), *[docs[c] for c in kept.columns])
    df = base_spans(df).withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    # what the rules found is blanked, so that places stay
    df = _replaced(df, "__rest", "text", "base", "repeat(' ', $n)").withColumnsRenamed({"text": "__text", "__rest": "text"})
    token = f"(?<![{_TOKEN_CHARS}])[{_TOKEN_CHARS}]{{{min_token},}}+"
    df = _with_spans(df, "__tokens", token, MARKOV, F.col("text").rlike(token)).drop("text").withColumnRenamed("__text", "text")
    df = df.withColumn("__model", F.split(F.lit(model.ratios), ",").cast("array<double>"))
    cut = model.min_ratio if min_ratio is None else min_ratio
    df = df.withColumn("markov", F.expr(f"if(size(__tokens) = 0, __tokens, filter(__tokens, t -> {_mean_ratio('t.text', '__model')} >= {cut}D))"))
    df = df.withColumn("spans", F.array_sort(F.concat("base", "markov"))).drop("__tokens", "__model")
    return df.withColumnRenamed("text", text_col)


def shown(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', element_at({names}, s.kind + 1), s.start, s.end)), ',')")


def redacted(scanned: DataFrame, name: str = "text", *, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """scanned with `name`: the text with every span replaced by the mark, overlapping spans once."""
    sql = "if($first, '" + mark.replace("\\", "\\\\").replace("'", "\\'") + "', '')"
    df = _replaced(scanned, "__clean", text_col, "spans", sql)
    return df.drop(name).withColumnRenamed("__clean", name)
