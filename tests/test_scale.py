"""What training and window features read, and how often."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from weblens.functions import fixed
from weblens.operators import features as W
from weblens.operators import models
from weblens.operators import profile as P
from weblens.operators.features import first_of_keys
from weblens.plans import detection
from weblens.plans.scalar_queries import requests

SF = "/root/testdata/sf0.001"


def scans(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_profile_takes_one_pass(spark):
    r = requests(spark, SF)
    assert scans(W.window_features(r, P.learn(r), 86400)) <= 5
    # The tables are still those of the requests themselves.
    p = P.learn(r)
    want = r.where("url_path <> ''").groupBy("server", "url_path").agg(F.count("*").alias("df"))
    assert sorted(map(tuple, p.paths.collect())) == sorted(map(tuple, want.collect()))
    ok = r.where("status_code between 200 and 299").select("server", P.extension(F.col("url_path")).alias("ext")).where("ext is not null").groupBy("server", "ext").count()
    assert sorted(map(tuple, p.exts.collect())) == sorted(map(tuple, ok.collect()))


def test_keys_begin_where_any_column_changes():
    a, b = pa.array(["x", "x", "x", None, None, "y"]), pa.array([1, 1, None, None, None, None], pa.int64())
    assert first_of_keys([a, b]) == [0, 2, 3, 5]
    assert first_of_keys([a.slice(3), b.slice(3)]) == [0, 2]
    assert first_of_keys([pa.array(["x"])]) == [0] and first_of_keys([pa.array([], pa.string())]) == []


def test_chain_depth_over_many_windows_and_batches(spark):
    """Windows end inside batches and go on over them; depths are those of a plain walk."""
    rng = np.random.default_rng(3)
    rows = [("s", f"10.0.0.{int(rng.integers(3))}", "h", int(rng.integers(4)), f"/p{int(rng.integers(6))}", None if rng.random() < 0.2 else f"/p{int(rng.integers(6))}", i, i) for i in range(400)]
    df = spark.createDataFrame(rows, "server string, source_ip string, ua_hash string, bucket long, url_path string, referrer string, us long, event_id long")
    want: dict = {}
    for *key, path, ref, _, _ in rows:
        known = want.setdefault(tuple(key), {"": 0})
        depth = known.get(ref, 0) + 1
        known[path] = max(depth, known.get(path, 0))
        known[""] = max(known[""], depth)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {tuple(r)[:4]: r.bot_referrer_chain_depth for r in W.chain_depth(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k: float(v[""]) for k, v in want.items()}


def test_forest_walks_like_a_row_at_a_time(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(300, 3)), [[np.nan, 0.0, np.inf]], np.zeros((4, 3))])
    trees = [np.array(models.grow(x[rng.choice(300, 64, replace=False)], rng), dtype=float) for _ in range(5)] + [np.array([(-1, 0.0, 0, 0, 1.5)])]
    want = []
    for row in x:
        total = 0.0
        for nodes in trees:
            at = 0
            while nodes[at, 0] >= 0:
                at = int(nodes[at, 2] if row[int(nodes[at, 0])] < nodes[at, 1] else nodes[at, 3])
            total += nodes[at, 4]
        want.append(2.0 ** (-(total / 6) / models.mean_path(64)))
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    got = sorted(map(tuple, models.IsolationForest(["a", "b", "c"], trees, 64).score(rows, "s").select("id", "s").collect()))
    assert [s for _, s in got] == want
    assert max(models.walked(t)[4] for t in trees) <= 6 and models.walked(trees[-1])[4] == 0


def test_hygiene_scores_each_row_once(spark, monkeypatch):
    scored, plain = spark.sparkContext.accumulator(0), models.IsolationForest.score

    def counting(self, rows, out="iforest"):
        got = plain(self, rows, out)
        return got.withColumn(out, F.udf(lambda v: (scored.add(1), v)[1], "double")(F.col(out))) if out == "_anomaly" else got

    monkeypatch.setattr(models.IsolationForest, "score", counting)
    bundle = detection.train(requests(spark, SF), "web_recon", "v", 86400)
    assert scored.value == bundle.metadata["usable_vectors"] > 100
    assert bundle.metadata["windows_dropped"] >= 1


def test_two_bundles_score_the_windows_of_one_scan(spark, tmp_path):
    class Raw:
        def __init__(self, column):
            self.column = column

        def score(self, rows, out):
            return rows.withColumn(out, F.col(self.column).cast("double"))

    def bundle(column):
        grid = spark.createDataFrame([([i / 1000 for i in range(1001)],)], "grid array<double>")
        return detection.Bundle("web_recon", "v", None, [], spark.createDataFrame([("web_ratio_404", 0.0, 1.0)], "feature string, p50 double, p99 double"), {"iforest": Raw(column)}, {"iforest": grid}, None)

    # Over both gates, over one, over the other, over none; not whole; without a start.
    values = [(1.0, 1.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.5, 0.5, 0.0), (1.0, 1.0, None), (1.0, 1.0, 0.0)]
    rows = spark.createDataFrame([("s", "i", "h", 60 * i if i < 5 else None, *v) for i, v in enumerate(values)], "server string, source_ip string, ua_hash string, window_start long, one double, two double, ua_len double")
    rows.withColumns({c: F.lit(0.0) for c in fixed.RECON_FEATURES if c != "ua_len"}).write.parquet(str(tmp_path / "w"))
    got = detection.compared(spark.read.parquet(str(tmp_path / "w")), bundle("one"), bundle("two"))
    assert scans(got) == 1
    assert tuple(got.first()) == (4, 2, 2, 1)
