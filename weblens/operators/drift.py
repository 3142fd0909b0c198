"""Drift of features by the population stability index."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.functions import fixed
from weblens.functions.expressions import drift_band
from weblens.operators.quantiles import quantiles


def edges(reference: DataFrame, bins: int = fixed.PSI_BINS) -> DataFrame:
    """(feature, edges, ref_n): distinct inner and outer edges of even shares of rows (feature, value)."""
    got = at_even_shares(reference, bins)
    numbers = reference.groupBy("feature").agg(F.count("*").alias("ref_n"))
    named = reference.sparkSession.createDataFrame(sorted(got.items()), "feature string, edges array<double>")
    return numbers.join(named, "feature", "left").select("feature", F.array_distinct(F.coalesce("edges", F.array().cast("array<double>"))).alias("edges"), "ref_n")


def at_even_shares(reference: DataFrame, bins: int) -> dict[str, list[float]]:
    return quantiles(reference, [i / bins for i in range(bins + 1)])


def stability(reference: DataFrame, current: DataFrame, bins: int = fixed.PSI_BINS) -> DataFrame:
    """(feature, psi) of rows (feature, value): 0 with fewer than two bins or ten rows on a side.

    Bins are closed on the left, the outer ones are open to infinity. The edges have a row a feature.
    """
    e = edges(reference, bins)
    both = reference.select("feature", "value", F.lit(0).alias("side")).union(current.select("feature", "value", F.lit(1).alias("side")))
    rows = both.join(F.broadcast(e), "feature")
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    binned = rows.withColumn("bin", F.size(F.filter(inner, lambda x: x <= F.col("value"))))
    counts = binned.groupBy("feature", "bin", F.size("edges").alias("n_edges")).agg(F.count_if(F.col("side") == 0).alias("r"), F.count_if(F.col("side") == 1).alias("c"))
    totals = counts.groupBy("feature").agg(F.sum("r").alias("rn"), F.sum("c").alias("cn"))
    parts = counts.join(F.broadcast(totals), "feature")
    r, c = F.greatest(F.col("r") / F.col("rn"), F.lit(fixed.PSI_EPS)), F.greatest(F.col("c") / F.col("cn"), F.lit(fixed.PSI_EPS))
    out = parts.where("rn > 0 and cn > 0").groupBy("feature").agg(F.sum((c - r) * F.log(c / r)).alias("psi"), F.max("n_edges").alias("e"), F.max("rn").alias("rn"), F.max("cn").alias("cn"), F.count("*").alias("bins"))
    # An empty bin on both sides adds nothing.
    return out.select("feature", F.when((F.col("e") < 3) | (F.col("rn") < 10) | (F.col("cn") < 10), 0.0).otherwise(F.col("psi")).alias("psi"))


def drift_report(psi: DataFrame) -> DataFrame:
    """One row: max_psi, its band, the drifted features by psi, and whether two or more call for training anew."""
    row = F.array_sort(F.collect_list(F.when(F.col("psi") > fixed.PSI_HIGH, F.struct((-F.col("psi")).alias("n"), "feature"))))
    out = psi.agg(F.coalesce(F.max("psi"), F.lit(0.0)).alias("max_psi"), F.transform(row, lambda x: x["feature"]).alias("drifted"))
    return out.withColumn("band", drift_band(F.col("max_psi"))).withColumn("retrain", F.size("drifted") >= 2)
