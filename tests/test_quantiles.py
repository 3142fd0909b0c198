"""Quantiles and samples of tables that lie in many partitions, against numbering by hand."""

import numpy as np
from pyspark.sql import functions as F

from weblens.operators import scoring
from weblens.operators.quantiles import quantiles, steps


def test_a_million_distinct_values_over_many_partitions(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        n = 1_000_000
        value = (F.col("id") * 7919 % n).cast("double")
        rows = spark.range(n).select(F.explode(F.array(F.struct(F.lit("a").alias("feature"), (value / 8).alias("value")), F.struct(F.lit("b").alias("feature"), F.pow(value / n, F.lit(9.0)).alias("value")))).alias("r")).select("r.*")
        shares = [i / 1000 for i in range(1001)]
        got = quantiles(rows, shares)
        x = np.arange(n, dtype=float)
        assert np.allclose(got["a"], np.quantile(x / 8, shares), rtol=1e-12) and np.allclose(got["b"], np.quantile((x / n) ** 9, shares, method="linear"), rtol=1e-9, atol=1e-300)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_ties_nulls_and_small_tables(spark):
    rows = spark.createDataFrame([("a", 1.0)] * 5 + [("a", 2.0), ("a", None), ("b", 3.0), ("c", None)], "feature string, value double")
    assert quantiles(rows, [0.0, 0.5, 0.9, 1.0]) == {"a": [1.0, 1.0, 1.5, 2.0], "b": [3.0] * 4}
    assert steps(rows, [0.05, 0.5, 5 / 6, 0.9]) == {"a": [1.0, 1.0, 1.0, 2.0], "b": [3.0] * 4}
    assert quantiles(rows.where("false"), [0.5]) == {} and scoring.grid(rows.where("false"), "value").first().grid is None


def test_reference_sample_of_wide_rows(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        n = 400_000
        wide = spark.range(n).select((F.col("id") * 7919 % n).alias("o"), *[F.sha2(F.concat(F.col("id").cast("string"), F.lit(c)), 512).alias(c) for c in "wxyz"])
        for rows in (wide, wide.select("o")):
            got = sorted(r.o for r in scoring.reference_sample(rows, ["o"], 200).collect())
            assert got == list(range(0, n, n // 200))
        assert scoring.reference_sample(wide.limit(150), ["o"], 200).count() == 150
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_heads_of_servers_without_ordering_all_items(spark):
    from weblens.operators.profile import most_frequent

    rows = [("a", f"/p{i:04d}", 1 + (i % 50 == 0) + (i == 7)) for i in range(900)] + [("b", f"/q{i}", i + 1) for i in range(30)] + [("c", "/one", 1)]
    counts = spark.createDataFrame(rows, "server string, url_path string, df long").repartition(6)
    for cap in (1, 5, 20, 400, 1000):
        want = sorted(r for s in "abc" for r in sorted((r for r in rows if r[0] == s), key=lambda r: (-r[2], r[1]))[:cap])
        assert sorted(map(tuple, most_frequent(counts, "df", "url_path", cap).collect())) == want
    assert most_frequent(counts.where("false"), "df", "url_path", 3).collect() == []
