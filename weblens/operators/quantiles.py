"""Exact quantiles of any number of values: distinct values are counted, sorted into ranges, and ranks are looked up in them.

Values are counted where they lie and shuffled once, one row a distinct value, so no task holds all of a feature and a value
that everybody has is one row. The ranges' sums (a row for each task and feature in it) are chained on the driver; each task
then hands on only the values at the wanted ranks.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def at_ranks(long: DataFrame, wanted) -> dict[str, tuple[int, dict[int, float]]]:
    """For each feature of rows (feature, value) its number of values, and the values at the ranks ``wanted(number)``, from 0.

    Nulls don't count; NaN is above all. The driver gets as many values as ranks are wanted.
    """
    counts = long.where("value is not null").groupBy("feature", F.col("value").cast("double").alias("value")).agg(F.count("*").alias("n"))
    order = ["feature", "value"]
    dealt = counts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).persist()
    try:
        sums = sorted((r["feature"], r["_p"], r["n"]) for r in dealt.groupBy("feature", "_p").agg(F.sum("n").alias("n")).collect())
        total: dict[str, int] = {}
        before = {}
        for feature, p, n in sums:
            before[feature, p] = total.get(feature, 0)
            total[feature] = before[feature, p] + n
        ranks = {f: np.unique(np.asarray(wanted(n), dtype=np.int64)) for f, n in total.items()}
        shared = long.sparkSession.sparkContext.broadcast((before, ranks))

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            starts, want = shared.value
            upto: dict[str, int] = {}
            for b in batches:
                feature, value, n = b.column("feature").to_pylist(), b.column("value").to_numpy(), b.column("n").to_numpy()
                p = b.column("_p")[0].as_py() if b.num_rows else None
                cuts = [0, *(i for i in range(1, len(feature)) if feature[i] != feature[i - 1]), len(feature)] if feature else [0]
                out: list[tuple] = []
                for a, e in zip(cuts, cuts[1:], strict=False):
                    f = feature[a]
                    first = upto.get(f, starts[f, p])
                    ends = first + np.cumsum(n[a:e])
                    upto[f] = int(ends[-1])
                    mine = want[f][(want[f] >= first) & (want[f] < ends[-1])]
                    out += zip([f] * len(mine), mine.tolist(), value[a:e][np.searchsorted(ends, mine, side="right")].tolist(), strict=True)
                names, at, values = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(at, pa.int64()), pa.array(values, pa.float64())], names=["feature", "rank", "value"])

        found: dict[str, tuple[int, dict[int, float]]] = {f: (n, {}) for f, n in total.items()}
        for r in dealt.mapInArrow(pick, "feature string, rank long, value double").collect():  # a row a wanted rank
            found[r.feature][1][r["rank"]] = r.value
        return found
    finally:
        dealt.unpersist()


def quantiles(long: DataFrame, shares: list[float]) -> dict[str, list[float]]:
    """For each feature of rows (feature, value) its values at even-spaced places of its order, between neighbours by a line."""

    def both(n: int) -> list[int]:
        return [r for s in shares for r in (math.floor(s * (n - 1)), math.ceil(s * (n - 1)))]

    def between(n: int, values: dict[int, float], share: float) -> float:
        at = share * (n - 1)
        low, high = math.floor(at), math.ceil(at)
        same = low == high or values[low] == values[high]
        return values[low] if same else (high - at) * values[low] + (at - low) * values[high]

    return {f: [between(n, values, s) for s in shares] for f, (n, values) in at_ranks(long, both).items()}


def steps(long: DataFrame, shares: list[float]) -> dict[str, list[float]]:
    """For each feature the first values that at least such shares of its rows do not exceed."""

    def rank(n: int, share: float) -> int:
        return max(0, math.ceil(share * n - 1e-12) - 1)

    return {f: [values[rank(n, s)] for s in shares] for f, (n, values) in at_ranks(long, lambda n: [rank(n, s) for s in shares]).items()}


def long_of(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (feature, value) of columns."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns]))
    return rows.select(each.alias("r")).select("r.*")
