"""Population statistics, percentile calibration and hygiene of the training rows."""

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblens.functions import fixed
from weblens.operators.quantiles import long_of, quantiles
from weblens.operators.sessions import in_order

#: Buckets of scores, counted to find a rank.
BUCKETS = 4096


def feature_stats(long: DataFrame) -> DataFrame:
    """(feature, p50, p99) of rows (feature, value), by linear interpolation."""
    got = quantiles(long, [0.5, 0.99])
    return long.sparkSession.createDataFrame([(f, *q) for f, q in sorted(got.items())], "feature string, p50 double, p99 double")


def clip_bounds(long: DataFrame, q: float = fixed.CLIP_Q) -> DataFrame:
    """(feature, bound): an upper bound of each feature that is not a flag."""
    flags = {r.feature for r in long.groupBy("feature").agg(F.bool_and(F.col("value").isin(0.0, 1.0)).alias("flag")).where("flag").collect()}  # a row a feature
    got = quantiles(long, [q])
    return long.sparkSession.createDataFrame([(f, b) for f, (b,) in sorted(got.items()) if f not in flags], "feature string, bound double")


def clipped(vectors: DataFrame, features: tuple[str, ...], q: float = fixed.CLIP_Q) -> DataFrame:
    """Vectors with each feature cut at its bound; flags stay, so that a rare label is not lost."""
    bounds = {r.feature: r.bound for r in clip_bounds(long_of(vectors, list(features)), q).collect()}  # a row a feature
    return vectors.withColumns({c: F.least(F.col(c), F.lit(bounds[c])) for c in features if c in bounds})


def zscores(rows: DataFrame, features: list[str]) -> DataFrame:
    """Features in deviations of the population from its mean."""
    m = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"d_{c}") for c in features]).first()
    return rows.withColumns({c: (F.col(c) - F.lit(m[f"m_{c}"])) / (F.lit(m[f"d_{c}"]) + 1e-9) for c in features}) if m[f"m_{features[0]}"] is not None else rows


def without_most_anomalous(rows: DataFrame, score: str, share: float = fixed.DROP_SHARE, least: int = fixed.DROP_FROM) -> DataFrame:
    """Rows without the top ``share`` by score (one at least) if there are more than ``least``; ties go by the row's hash.

    The bucket of the n-th score is found by counts of BUCKETS buckets, twice; only what lies in the last small bucket with
    it is ordered, by one task. Rows of one score are told apart by their hash, so equal scores don't fill a bucket.
    """
    n = rows.count()
    if n <= least:
        return rows
    k = max(1, int(share * n))
    ranked = rows.withColumn("_tie", F.xxhash64(*rows.columns))
    span = ranked.agg(F.min(score).alias("low"), F.max(score).alias("high")).first()
    width = (span.high - span.low) / BUCKETS
    # Places fall with the score: by value first, by hash where all scores are one.
    place = F.floor((F.lit(span.high) - F.col(score)) / width) if width > 0 else F.lit(0)
    level, left, held = [], k, ranked.withColumn("_b0", place).withColumn("_b1", F.shiftrightunsigned("_tie", 52) if width <= 0 else F.lit(0))
    for b in ("_b0", "_b1"):
        at = None
        for r in sorted(reduce(lambda d, x: d.where(F.col(x[0]) == x[1]), level, held).groupBy(b).count().collect()):  # a row a bucket
            at = r[b]
            if r["count"] >= left:
                break
            left -= r["count"]
        level.append((b, at))
    inside = reduce(lambda d, x: d.where(F.col(x[0]) == x[1]), level, held)
    last = inside.orderBy(F.desc(score), "_tie").limit(left).agg(F.min(F.struct(F.col(score), -F.col("_tie").cast("decimal(20)"))).alias("m")).select("m.*").first()
    before = (F.col("_b0") < level[0][1]) | ((F.col("_b0") == level[0][1]) & (F.col("_b1") < level[1][1]))
    same = (F.col("_b0") == level[0][1]) & (F.col("_b1") == level[1][1])
    gone = before | (same & ((F.col(score) > last[0]) | ((F.col(score) == last[0]) & (F.col("_tie") <= -int(last[1])))))
    return held.where(~gone).drop("_tie", "_b0", "_b1")


def grid(rows: DataFrame, score: str) -> DataFrame:
    """One row: ``grid``, the scores at 1001 even shares of the population; null without scores."""
    got = quantiles(long_of(rows, [score]), [i / (fixed.GRID - 1) for i in range(fixed.GRID)])
    return rows.sparkSession.createDataFrame([(got.get(score),)], "grid array<double>")


def percentile_of(raw: Column, grid_: Column) -> Column:
    """The share of a grid that a raw score reaches, at most 1; no score reaches nothing.

    A grid ascends, so the number of its scores that are not above ``raw`` is found by bisection, not by reading all of them.
    """
    halves = [1 << b for b in reversed(range(fixed.GRID.bit_length()))]
    reached = lambda at, step: F.when((at + step <= F.size(grid_)) & (F.get(grid_, at + step - 1) <= raw), at + step).otherwise(at)
    return F.least(F.lit(1.0), F.aggregate(F.array(*map(F.lit, halves)), F.lit(0), reached) / float(fixed.GRID - 1))


def calibrated(rows: DataFrame, score: str, grid_: DataFrame, out: str) -> DataFrame:
    """Rows with the percentile of a score. The grid is one row of fixed width, and goes into the plan as one literal."""
    got = grid_.first()
    values = F.from_json(F.lit(json.dumps(got.grid if got and got.grid else [])), "array<double>")
    return rows.withColumn(out, percentile_of(F.col(score), values))


def calibration_rows(rows: DataFrame, least: int = fixed.LEAST_WINDOWS) -> DataFrame:
    """Windows of browsers only, or all if there are too few of them."""
    browsers = rows.where("bot_declared_bot < 0.5")
    return browsers if browsers.limit(least).count() >= least else rows


def reference_sample(rows: DataFrame, order: list[str], cap: int = fixed.REFERENCE_CAP) -> DataFrame:
    """Every step-th row in order, ``cap`` at most; rows that tie are any of them."""
    step = max(1, rows.count() // cap)
    placed = in_order(rows, order, "_place")
    return placed.where(((F.col("_place") - 1) % step == 0) & (F.col("_place") <= step * cap)).drop("_place")


def ranked(rows: DataFrame, by: list[str], order: list, out: str = "place") -> DataFrame:
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
