"""Preparation of rows: thresholds, scaling, labels and arm encodings."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.sources.files import stored


#: Distinct values of a feature that one task counts; the counts of more are dealt by range.
DISTINCT_AT_ONCE = 200_000
#: The accuracy of the sketch that brackets quantiles: each is off by a share of 1 / ACCURACY of the rows at most.
ACCURACY = 10_000


def quantile_thresholds(df: DataFrame, features: list[str], max_bins: int = 100, exact: bool = True) -> list[list[float]]:
    """Distinct linear quantiles of each feature at k / max_bins for k < max_bins: the least value is among them, the
    largest is not.

    The exact form counts distinct values: within one aggregation while they are few, beyond by ranges of those values that
    are near a quantile by a sketch (of all, should the sketch have erred), with the same result.  Approximate quantiles are an
    explicit choice."""
    at = [k / max_bins for k in range(max_bins)]
    if exact:
        guess = df.agg(*[F.approx_count_distinct(c).alias(f"n{i}") for i, c in enumerate(features)]).first()
        if max((guess[i] or 0 for i in range(len(features))), default=0) > DISTINCT_AT_ONCE:
            return _ranged_quantiles(_near_counts(df, features, at), features, at) or _ranged_quantiles(_counts(df, features), features, at)
    places = F.array(*map(F.lit, at))
    of = (lambda c: F.percentile(c, places)) if exact else (lambda c: F.percentile_approx(c, places, 10_000))
    row = df.agg(*[F.array_sort(F.array_distinct(of(F.col(c).cast("double")))).alias(f"q{i}") for i, c in enumerate(features)]).first()
    if row is None or any(row[i] is None for i in range(len(features))):
        raise ValueError("thresholds need at least one row")
    return [list(row[i]) for i in range(len(features))]


def _counts(df: DataFrame, features: list[str]) -> DataFrame:
    """(f, v, count, loose): how often each feature has each value."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("v")) for i, c in enumerate(features)]))
    return df.select(each.alias("e")).select("e.f", "e.v").where("v is not null").groupBy("f", "v").count().withColumn("loose", F.lit(False))


def _near_counts(df: DataFrame, features: list[str], at: list[float]) -> DataFrame:
    """The same, but values between brackets about the quantiles are counted together, as the largest of them (loose)."""
    edges = sorted({min(max(p + d, 0.0), 1.0) for p in at for d in (-2 / ACCURACY, 2 / ACCURACY)})
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), F.array(*map(F.lit, edges)), F.lit(ACCURACY)).alias(f"q{i}") for i, c in enumerate(features)]).first()
    brackets = []
    for i in range(len(features)):
        value = dict(zip(edges, row[i] or [], strict=bool(row[i])))
        own: list[list[float]] = []
        for p in at if value else []:
            low = value[p - 2 / ACCURACY] if p - 2 / ACCURACY > 0 else -math.inf
            high = value[p + 2 / ACCURACY] if p + 2 / ACCURACY < 1 else math.inf
            if own and not low > own[-1][1]:
                own[-1][1] = max(own[-1][1], high)
            else:
                own.append([low, high])
        brackets.append(np.array(own).reshape(-1, 2))
    if any(np.isnan(own).any() or (np.diff(own.ravel()) < 0).any() for own in brackets):  # the sketch has no order for NaN
        return _counts(df, features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, slot, v, n = [], [], [], []
            for i, own in enumerate(brackets):
                values = np.sort(pc.drop_null(batch.column(i)).to_numpy(zero_copy_only=False))
                if not len(values):
                    continue
                begun, ended = np.searchsorted(own[:, 0], values, "right"), np.searchsorted(own[:, 1], values, "left")
                new = np.append(True, ((begun[1:] + ended[1:]) != (begun[:-1] + ended[:-1])) | (begun[1:] > ended[1:]) & (values[1:] != values[:-1]))
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(values)) - 1
                f.append(np.full(len(first), i))
                slot.append((begun + ended)[first])
                v.append(values[last])
                n.append(last - first + 1)
            if f:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in ((f, pa.int32()), (slot, pa.int32()), (v, pa.float64()), (n, pa.int64()))], names=["f", "slot", "v", "n"])

    counted = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(features)]).mapInArrow(run, "f int, slot int, v double, n long")
    loose = F.col("slot") % 2 == 0
    return counted.groupBy("f", "slot", F.when(~loose, F.col("v")).alias("own")).agg(F.max("v").alias("v"), F.sum("n").alias("count")).select("f", "v", "count", loose.alias("loose"))


def _ranged_quantiles(counts: DataFrame, features: list[str], at: list[float]) -> list[list[float]] | None:
    """Counted values are dealt by range and saved; sums of the counts before each range give every value its ranks.  None, if
    a quantile is among values that are counted together."""
    dealt = stored(counts.repartitionByRange("f", "v").sortWithinPartitions("f", "v").withColumn("p", F.spark_partition_id()), "counts")
    whole = dealt.groupBy("f", "p").agg(F.sum("count").alias("n"))
    before = Window.partitionBy("f").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    starts = whole.select(F.col("f").alias("g"), F.col("p").alias("q"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    total = {r["f"]: r["n"] for r in whole.groupBy("f").agg(F.sum("n").alias("n")).collect()}
    if len(total) < len(features):
        raise ValueError("thresholds need at least one row")
    inside = Window.partitionBy("f", "p").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.join(starts, (F.col("f") == F.col("g")) & (F.col("p") == F.col("q"))).withColumn("first", F.col("start") + F.coalesce(F.sum("count").over(inside), F.lit(0)))
    ranks = [sorted({r for p in at for r in (math.floor((total[i] - 1) * p), math.ceil((total[i] - 1) * p))}) for i in range(len(features))]
    wanted = F.element_at(F.array(*[F.array(*[F.lit(r).cast("long") for r in own]) for own in ranks]), F.col("f") + 1)
    hit = ranked.withColumn("hits", F.filter(wanted, lambda r: (r >= F.col("first")) & (r < F.col("first") + F.col("count")))).where(F.size("hits") > 0)
    found = hit.select("f", "v", "hits", "loose").collect()
    if any(r["loose"] for r in found):
        return None
    value = {(r["f"], k): r["v"] for r in found for k in r["hits"]}
    out = []
    for i in range(len(features)):
        found = set()
        for p in at:
            place = (total[i] - 1) * p
            low, high = value[(i, math.floor(place))], value[(i, math.ceil(place))]
            found.add(low + (place - math.floor(place)) * (high - low))
        out.append(sorted(found))
    return out


def unique_values(df: DataFrame, feature: str) -> DataFrame:
    """(feature, threshold): all distinct values, a row each."""
    return df.select(F.lit(feature).alias("feature"), F.col(feature).cast("double").alias("threshold")).where("threshold is not null").distinct()


def unique_thresholds(df: DataFrame, feature: str) -> DataFrame:
    """(feature, thresholds): all distinct values in order, as one array; `unique_values` for those that one row can't
    hold."""
    return unique_values(df, feature).groupBy("feature").agg(F.array_sort(F.collect_list("threshold")).alias("thresholds"))


def minmax(y: Column, low: Column, high: Column) -> Column:
    """To [-0.5, 0.5]; values stay as they are when all are equal."""
    return F.when(high == low, y).otherwise((y - low) / (high - low) - 0.5)


def unminmax(z: Column, low: Column, high: Column) -> Column:
    return F.when(high == low, z).otherwise((high - low) * (z + 0.5) + low)


@dataclass
class Preprocessor:
    """Thresholds of the features and the range of the target; `update` keeps both for later rows."""

    features: list[str]
    target: str
    max_bins: int = 100
    low: float = field(default=float("nan"))
    high: float = field(default=float("nan"))
    thresholds: list[list[float]] = field(default_factory=list)

    def fit(self, df: DataFrame) -> Preprocessor:
        row = df.agg(F.min(F.col(self.target).cast("double")).alias("a"), F.max(F.col(self.target).cast("double")).alias("b")).first()
        if row["a"] is None:
            raise ValueError("no rows to fit")
        self.low, self.high = row["a"], row["b"]
        self.thresholds = quantile_thresholds(df, self.features, self.max_bins)
        return self

    def transform(self, df: DataFrame, out: str = "y", target: bool = True) -> DataFrame:
        x = F.array(*[F.col(c).cast("double") for c in self.features])
        made = df.withColumn("x", x)
        return made.withColumn(out, minmax(F.col(self.target).cast("double"), F.lit(self.low), F.lit(self.high))) if target else made

    def backtransform(self, z: Column) -> Column:
        return unminmax(z, F.lit(self.low), F.lit(self.high))

    def scale(self) -> tuple[float, float]:
        """(factor, offset) of the way back."""
        return (1.0, 0.0) if self.high == self.low else (self.high - self.low, (self.high - self.low) / 2 + self.low)


#: Labels that a vocabulary may have, and that are sent to all tasks.
MOST_LABELS = 100_000


def vocabulary(df: DataFrame, label: str) -> DataFrame:
    """(label, idx): the distinct labels numbered from 0 in their order; more than MOST_LABELS are an error."""
    rows = [r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().limit(MOST_LABELS + 1).orderBy(label).collect()]
    if not rows:
        raise ValueError("no labels")
    if len(rows) > MOST_LABELS:
        raise ValueError("too many labels")
    kind = df.schema[label].dataType.simpleString()
    return df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(rows)], f"label {kind}, idx int")


def _known(words: DataFrame) -> DataFrame:
    """The vocabulary, sent to all tasks if it is as small as those that `vocabulary` makes."""
    known = words.select(F.col("label").alias("__label"), F.col("idx").alias("__idx"))
    return F.broadcast(known) if known.limit(MOST_LABELS + 1).count() <= MOST_LABELS else known


def encode_labels(df: DataFrame, label: str, words: DataFrame, out: str = "idx") -> DataFrame:
    """Adds the index of each label; a label that the vocabulary lacks raises an error."""
    joined = df.join(_known(words), F.col(label) == F.col("__label"), "left")
    return joined.withColumn(out, F.when(F.col("__idx").isNull(), F.raise_error(F.concat(F.lit("unknown label "), F.coalesce(F.col(label).cast("string"), F.lit("null")))).cast("int")).otherwise(F.col("__idx"))).drop("__label", "__idx")


def decode_labels(df: DataFrame, idx: str, words: DataFrame, out: str = "label") -> DataFrame:
    return df.join(_known(words), F.col(idx) == F.col("__idx"), "left").withColumn(out, F.col("__label")).drop("__label", "__idx")


ENCODINGS = ("one-hot", "multi", "separate")


def encode_arm(x: Column, arm: Column, arms: int, features: int, encoding: str) -> Column:
    """Features of a row and arm: one-hot appends the arm's indicator, multi puts the features into the arm's block,
    separate leaves them (one model for each arm)."""
    each = F.sequence(F.lit(0), F.lit(arms - 1))
    if encoding == "one-hot":
        return F.concat(x, F.transform(each, lambda a: (a == arm).cast("double")))
    if encoding == "multi":
        zero = F.array_repeat(F.lit(0.0), features)
        return F.flatten(F.transform(each, lambda a: F.when(a == arm, x).otherwise(zero)))
    if encoding == "separate":
        return x
    raise ValueError(f"unknown encoding {encoding!r}")


def encode_all_arms(df: DataFrame, x: str, arms: int, features: int, encoding: str) -> DataFrame:
    """A row for each arm with its encoding; `separate` needs one row only."""
    if encoding == "separate":
        return df.withColumn("encoded", F.col(x))
    spread = df.withColumn("arm", F.explode(F.sequence(F.lit(0), F.lit(arms - 1))))
    return spread.withColumn("encoded", encode_arm(F.col(x), F.col("arm"), arms, features, encoding))
