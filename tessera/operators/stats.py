"""Statistics: label checks and counts, class moments, candidate splits and binning."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V
from ..sources.storage import materialize


def check_labels(df: DataFrame, num_label: int | None = None, label: str = "label") -> DataFrame:
    """The same rows; the query fails on a label outside 0..num_label-1, or, without num_label, on
    labels that are not all -1/1 or 0/1."""
    y = F.col(label)
    good = (y == F.floor(y)) & (y >= 0) & (y < num_label) if num_label else y.isin(-1, 0, 1)
    if not num_label:
        ends = df.agg(F.max((y == -1).cast("int")), F.max((y == 0).cast("int"))).first()
        if ends[0] and ends[1]:
            raise ValueError("bad label: -1 and 0 in one data set")
    return df.withColumn(label, F.when(good, y).otherwise(F.raise_error(F.concat(F.lit("bad label: "), F.coalesce(y.cast("string"), F.lit("null")))).cast("double")))


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(F.col(label).cast("int").alias("label")).agg(F.count("*").alias("n"))


def max_dim(rows: DataFrame) -> int:
    """Length of the longest row: the largest index and one."""
    return (rows.agg(F.max(F.array_max("indices"))).first()[0] or 0) + 1


def class_moments(long: DataFrame, counts: DataFrame) -> DataFrame:
    """long (label, fid, value) and counts (label, n) to (label, fid, mean, var, prior). Entries that
    are absent count as zeros."""
    sums = long.groupBy("label", "fid").agg(F.sum("value").alias("sx"), F.sum(F.col("value") * F.col("value")).alias("sxx"))
    total = counts.agg(F.sum("n").alias("total"))
    mean = F.col("sx") / F.col("n")
    prior = counts.join(F.broadcast(total))  # one row
    return sums.join(prior, "label").select("label", "fid", mean.alias("mean"), (F.col("sxx") / F.col("n") - mean * mean).alias("var"), (F.col("n") / F.col("total")).alias("prior"))


#: Values that a feature's quantile sketch keeps, about; see `rank_error`.
SKETCH = 4096


def rank_error(size: int = SKETCH) -> float:
    """The share of all values by which the rank of a sketch's quantile may be off, at 99 %."""
    return 2.296 / size**0.9723


def quantile_summary(long: DataFrame, size: int = SKETCH) -> DataFrame:
    """(fid, n, low, high, kinds, sketch) of the values that are there: tasks build a summary of bounded
    size for each feature, and summaries are merged, here and in `merge_summaries`. NaN and null are
    passed over."""
    values = long.where("value is not null and not isnan(value)")
    return values.groupBy("fid").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.hll_sketch_agg(F.xxhash64("value")).alias("kinds"), F.kll_sketch_agg_double("value", F.lit(size)).alias("sketch"))


def merge_summaries(summaries: DataFrame) -> DataFrame:
    """One summary per feature of the summaries of several scans."""
    return summaries.groupBy("fid").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.hll_union_agg("kinds").alias("kinds"), F.kll_merge_agg_double("sketch").alias("sketch"))


def summary_quantiles(summary: DataFrame, fractions: list[float]) -> DataFrame:
    """(fid, q): the sketches' values at some fractions; the ends are exact."""
    return summary.select("fid", _values(fractions).alias("q"))


def _values(fractions: list[float]) -> Column:
    inner = [min(1.0, max(0.0, f)) for f in fractions]
    found = F.kll_sketch_get_quantile_double(F.col("sketch"), F.array(*map(F.lit, inner)))
    return F.array(*[F.col("low") if f == 0 else F.col("high") if f == 1 else F.get(found, F.lit(i)) for i, f in enumerate(inner)])


def exact_quantiles(long: DataFrame, summary: DataFrame, fractions: list[float], size: int = SKETCH) -> DataFrame:
    """(fid, q): interpolated quantiles, exact. The sketch says between which values a quantile lies; the
    values below are counted, and only those between are sorted. Where the sketch was wrong, all are."""
    values = long.where("value is not null and not isnan(value)").select("fid", "value")
    some = 3 * rank_error(size)
    around = [_values([f + side * some for f in fractions]).alias(name) for side, name in ((-1, "lo"), (1, "hi"))]
    want = summary.select("fid", "n", "low", "high", F.posexplode(F.arrays_zip(F.array(*map(F.lit, fractions)).alias("f"), *around)).alias("k", "x"))
    want = want.select("fid", "k", "low", "high", "x.lo", "x.hi", (F.col("x.f") * (F.col("n") - 1)).alias("at"))
    want = materialize(want, "brackets")  # a row for each feature and fraction
    out = _between(values, want, len(fractions))
    wrong = out.where("wrong").select("fid", "k")
    if wrong.take(1):
        again = want.join(wrong, ["fid", "k"]).withColumn("lo", F.col("low")).withColumn("hi", F.col("high"))
        out = out.where("not wrong").unionByName(_between(values, again, len(fractions)))
    return out.groupBy("fid").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "q"))), lambda x: x["q"]).alias("q"))  # one entry a fraction


def above(ends: str, value: Column, most: int, equal: bool = False) -> Column:
    """How many of an array's ends (`most` at most) are below a value, or equal to it; a few are compared in compiled code."""
    under = lambda end: ((end <= value) if equal else (end < value)).cast("int")
    if most > 16:
        return F.aggregate(ends, F.lit(0), lambda n, end: n + under(end))
    return sum((F.coalesce(under(F.get(ends, F.lit(i))), F.lit(0)) for i in range(most)), F.lit(0))


def _between(values: DataFrame, want: DataFrame, most: int) -> DataFrame:
    """(fid, k, q, wrong): the wanted order statistics (`most` a feature at most), among the values between lo and hi.
    One pass counts the values: inside of brackets each by itself, outside by the brackets that they lie between."""
    brackets = want.groupBy("fid").agg(F.sort_array(F.collect_list(F.struct("hi", "lo", "k", "at"))).alias("b")).withColumns({"los": F.col("b.lo"), "his": F.col("b.hi")})
    brackets = by_feature(brackets)
    # both ends ascend, so a value is in a bracket if it is in the first that ends at it or above
    placed = values.join(brackets.select("fid", "los", "his"), "fid").withColumn("place", above("his", F.col("value"), most))
    held = F.when(F.get("los", F.col("place")) <= F.col("value"), F.col("value"))
    counts = materialize(placed.groupBy("fid", "place", held.alias("held")).agg(F.count("*").alias("c"), F.min("value").alias("value")), "between")
    # where each lies: -1 below a bracket, 0 inside, nothing above
    met = counts.join(brackets.select("fid", "b"), "fid").select("fid", "value", "c", F.explode(F.filter("b", lambda x: F.col("value") <= x["hi"])).alias("x"))
    inside = met.select("fid", "x.k", "x.at", F.when(F.col("value") >= F.col("x.lo"), F.col("value")).alias("value"), "c").groupBy("fid", "k", "at", "value").agg(F.sum("c").alias("c"))
    return _ordered(inside)


def _ordered(counts: DataFrame) -> DataFrame:
    """(fid, k, q, wrong): of counted values (fid, k, at, value, c) the interpolated one of rank `at`; null is below all."""
    run = Window.partitionBy("fid", "k").orderBy(F.col("value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    counted = counts.withColumn("until", F.sum("c").over(run))
    first = lambda rank: F.min(F.when(F.col("until") > rank, F.struct("until", "value")))
    found = counted.groupBy("fid", "k", "at").agg(first(F.floor("at")).alias("a"), first(F.ceil("at")).alias("b"))
    a, b, low = F.col("a.value"), F.col("b.value"), F.floor("at")
    q = F.when(a == b, a).otherwise((low + 1 - F.col("at")) * a + (F.col("at") - low) * b)
    return found.select("fid", "k", q.alias("q"), (a.isNull() | b.isNull()).alias("wrong"))


#: Features, among the first values, up to which each has a sketch.
MANY_FEATURES = 256


def candidate_splits(long: DataFrame, num_split: int = 10, exact: bool = True, size: int = SKETCH) -> DataFrame:
    """(fid, edges, default_bin): all distinct values of a feature if no more than num_split, else
    its i/num_split quantiles; edges around a lone or outer zero give zero a bin of its own.

    All come from one quantile summary per feature. exact=False takes the sketch's own quantiles, off
    by `rank_error`; else one more scan finds the exact ones.
    """
    fractions = [i / num_split for i in range(num_split)]
    if exact and len(long.select("fid").limit(1 << 16).distinct().take(MANY_FEATURES + 1)) > MANY_FEATURES:
        return _with_default(_counted_splits(long, num_split, fractions, size))
    summary = materialize(quantile_summary(long, size), "summary")
    # the summary tells which features may have few values, and only those are listed; or many, with quantiles
    kinds = F.hll_sketch_estimate("kinds")
    many, few = summary.where(kinds > num_split / 2), summary.where(kinds <= 2 * num_split + 8).select("fid")
    quantiles = exact_quantiles(long, many, fractions, size) if exact else summary_quantiles(many, fractions)
    distinct = long.where("value is not null and not isnan(value)").join(few, "fid", "left_semi").groupBy("fid", "value").agg(F.lit(1)).select("fid", "value")
    ranked = distinct.withColumn("k", F.row_number().over(Window.partitionBy("fid").orderBy("value"))).where(F.col("k") <= num_split + 1)
    listed = ranked.groupBy("fid").agg(F.sort_array(F.collect_list("value")).alias("few"))
    edges = quantiles.join(listed, "fid", "full")
    raw = F.when(F.size("few") <= num_split, F.col("few")).otherwise(V.unique("q"))
    return _with_default(edges.select("fid", raw.alias("raw")))


def _with_default(raw: DataFrame) -> DataFrame:
    return raw.select("fid", zero_aware("raw").alias("edges")).withColumn("default_bin", V.bin_index(F.lit(0.0), F.col("edges")))


def _counted_splits(long: DataFrame, num_split: int, fractions: list[float], size: int) -> DataFrame:
    """(fid, raw) as candidate_splits has it, for tables of many features: values are counted once, and only features
    with more than `size` distinct ones have a sketch."""
    values = long.where("value is not null and not isnan(value)").select("fid", "value")
    counted = materialize(values.groupBy("fid", "value").agg(F.count("*").alias("c")), "counted")
    kinds = materialize(counted.groupBy("fid").agg(F.count("*").alias("kinds"), F.sum("c").alias("n")), "kinds")
    few, some = kinds.where(F.col("kinds") <= num_split), kinds.where((F.col("kinds") > num_split) & (F.col("kinds") <= size))
    listed = counted.join(few.select("fid"), "fid", "left_semi").groupBy("fid").agg(F.sort_array(F.collect_list("value")).alias("raw"))  # num_split at most
    ranks = some.select("fid", "n", F.posexplode(F.array(*map(F.lit, fractions))).alias("k", "f")).select("fid", "k", (F.col("f") * (F.col("n") - 1)).alias("at"))
    found = _ordered(counted.join(ranks, "fid")).groupBy("fid").agg(V.unique(F.collect_list("q")).alias("raw"))  # one entry a fraction
    out = listed.unionByName(found)
    many = kinds.where(F.col("kinds") > size).select("fid")
    if many.take(1):
        rest = values.join(many, "fid", "left_semi")
        out = out.unionByName(exact_quantiles(rest, materialize(quantile_summary(rest, size), "summary"), fractions, size).select("fid", V.unique("q").alias("raw")))
    return out


def zero_aware(edges: str) -> Column:
    """Edges widened by half where zero would share its bin: a lone edge, or an outer one of zero."""
    e = F.col(edges)
    first, last = F.get(e, 0), F.element_at(e, -1)
    lone = F.when(first > 0, F.array(first - 0.5, first)).when(first < 0, F.array(first, first + 0.5)).otherwise(F.array(first - 0.5, first, first + 0.5))
    wide = F.concat(F.when(first == 0, F.array(F.lit(-0.5))).otherwise(F.array().cast("array<double>")), e, F.when(last == 0, F.array(F.lit(0.5))).otherwise(F.array().cast("array<double>")))
    return F.when(F.size(e) == 1, lone).otherwise(wide)


def by_feature(table: DataFrame) -> DataFrame:
    """A table of one small row per feature, for joins with values: sent to all tasks up to FEW_FEATURES
    features, whatever sizes are estimated, since a shuffle by feature has no more groups than features
    and a broadcast of the values has no bound; beyond, a merge join."""
    few = len(table.select("fid").take(FEW_FEATURES + 1)) <= FEW_FEATURES
    return F.broadcast(table) if few else table.hint("merge")


def bin_values(long: DataFrame, splits: DataFrame) -> DataFrame:
    """long with `bin`: missing values go to the feature's default bin. The splits are one small row
    per feature."""
    v = F.col("value")
    return long.join(by_feature(splits), "fid").withColumn("bin", F.when(v.isNull() | F.isnan(v), F.col("default_bin")).otherwise(V.bin_index(v, F.col("edges")))).drop("edges", "default_bin")


#: Features up to which edges go into a plan as constants.
FEW_FEATURES = 4096


def bin_rows(rows: DataFrame, splits: DataFrame, keep: list[str]) -> DataFrame:
    """Sparse rows (indices, values, and what is to be kept) with `fids` and `bins`: the entries whose bin
    is not the default one of their feature, which stands for absent entries, null and NaN. Up to
    FEW_FEATURES features every row is binned by itself; beyond, entries meet their edges in a join."""
    zipped = F.arrays_zip(F.col("indices").alias("fid"), F.col("values").alias("value"))
    known = (splits.agg(F.max("fid")).first()[0] or 0) < FEW_FEATURES
    if known:
        table = {r.fid: (np.array(r.edges, float), r.default_bin) for r in splits.collect()}  # FEW_FEATURES at most

        def run(batches):
            for batch in batches:
                row, fid, value = V.entries(batch.column(len(keep)), batch.column(len(keep) + 1))
                order = np.argsort(fid, kind="stable")
                kinds, starts = np.unique(fid[order], return_index=True)
                bins = np.full(len(fid), -1)
                for f, own in zip(kinds.tolist(), np.split(order, starts[1:])):
                    if f in table:
                        edges, usual = table[f]
                        found = np.maximum(np.searchsorted(edges, value[own], side="right") - 1, 0)
                        bins[own] = np.where((found == usual) | np.isnan(value[own]), -1, found)
                some = bins >= 0
                ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row[some], minlength=batch.num_rows)))), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x[some], pa.int32())) for x in (fid, bins)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *lists], [*keep, "fids", "bins"])

        kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
        return rows.select(*keep, "indices", "values").mapInArrow(run, f"{kept}, fids array<int>, bins array<int>")
    numbered = materialize(rows.withColumn("__n", F.monotonically_increasing_id()), "numbered")
    long = numbered.select("__n", F.explode(zipped).alias("e")).select("__n", "e.fid", "e.value").where("value is not null and not isnan(value)")
    long = long.join(splits, "fid").withColumn("bin", V.bin_index(F.col("value"), F.col("edges"))).where("bin <> default_bin")
    entries = long.groupBy("__n").agg(F.sort_array(F.collect_list(F.struct("fid", "bin"))).alias("__e"))  # one row's entries
    empty = F.array().cast("array<int>")
    return numbered.join(entries, "__n", "left").select(*keep, F.coalesce("__e.fid", empty).alias("fids"), F.coalesce("__e.bin", empty).alias("bins"))


def drawn(df: DataFrame, ratio: float, seed: int, key: str = "row_id") -> Column:
    """Whether a row is among ceil(ratio * n) that are drawn without replacement, the same ones for any
    partitioning: those with the smallest hashes of their key. Counts per 16-bit hash prefix find the
    prefix in which the last row lies, and only that prefix's rows are sorted."""
    h = F.xxhash64(F.lit(seed), key)
    prefix = F.shiftrightunsigned(h, 48)
    counts = sorted((r["b"], r["count"]) for r in df.groupBy(prefix.alias("b")).count().collect())  # 65,536 rows at most
    keep = math.ceil(ratio * sum(c for _, c in counts))
    for bucket, c in counts:
        if keep <= c:
            break
        keep -= c
    else:
        return F.lit(True)
    last = df.where(prefix == bucket).select(h.alias("h"), key).orderBy("h", key).limit(keep).agg(F.max(F.struct("h", key)).alias("m")).first().m
    inside = (prefix == bucket) & (F.struct(h.alias("h"), F.col(key)) <= F.struct(F.lit(last[0]).alias("h"), F.lit(last[1]).alias(key)))
    return (prefix < bucket) | inside


def sample_rows(df: DataFrame, ratio: float, seed: int, key: str = "row_id") -> DataFrame:
    """The rows that are `drawn`."""
    return df.where(drawn(df, ratio, seed, key))


def permuted(df: DataFrame, key: str, seed: int, name: str = "place") -> DataFrame:
    """df (keys without repeats) with `name`: places 0 to n - 1 in an order drawn by the seed, the same
    for any partitioning."""
    from ..sources.readers import ranked

    return ranked(df.withColumn("__order", F.struct(F.xxhash64(F.lit(seed), key).alias("h"), F.col(key).alias("k"))), "__order", name).drop("__order")


def fold(key: Column, k: int, seed: int = 0) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(k)).cast("int")


def k_fold(df: DataFrame, k: int, key: str, seed: int = 0):
    """(train, validation) pairs."""
    tagged = df.withColumn("__fold", fold(F.col(key), k, seed))
    for i in range(k):
        yield tagged.where(F.col("__fold") != i).drop("__fold"), tagged.where(F.col("__fold") == i).drop("__fold")
