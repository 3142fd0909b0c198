"""Gates, folds and models, training and backtest with both canaries, registry and live service."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weblens import plugins
from weblens.operators import detect, drift, models, neighbours, scoring
from weblens.plans import detection, registry
from weblens.sources import canaries, ndjson

ENT = {"server": "s", "source_ip": "i", "ua_hash": "h"}


def rows(spark, values, schema):
    got = spark.createDataFrame(values, schema)
    return got.withColumns({k: F.lit(v) for k, v in ENT.items() if k not in got.columns})


def test_streak_of_adjacent_windows(spark):
    w = rows(spark, [(300 * i, 0.999 if i != 4 else 0.5, False, 9) for i in range(12) if i != 8], "window_start long, pct double, declared_bot boolean, event_count long")
    got = [r.streak for r in detect.streaks(w, "pct").orderBy("window_start").collect()]
    assert got == [1, 2, 3, 4, 0, 1, 2, 3, 1, 2, 3]


def test_fold_slides_and_budget(spark):
    w = rows(spark, [(t, 0.99) for t in (0, 1800, 3600, 5401)], "window_end long, pct double")
    got = detect.folded(w, "pct").orderBy("window_end").collect()
    assert [(r.fold_id, r.fold_place) for r in got] == [(1, 1), (1, 2), (1, 3), (2, 1)]
    assert [r.in_budget for r in detect.budgeted(w, 2).orderBy("window_end").collect()] == [True, True, False, False]


def test_delivery_order(spark):
    w = rows(spark, [(0, 0.99, "suppress"), (10000, 0.99, None), (10100, 0.99, "downweight"), (20000, 0.99, None)], "window_end long, pct double, action string")
    got = detect.delivery(w, "pct", 1).orderBy("window_end").collect()
    assert [r.disposition for r in got] == ["suppressed", "delivered", "folded", "digested"]


def test_annotations_of_the_same_window_count(spark):
    w = rows(spark, [(300,), (600,), (900,)], "window_end long")
    a = rows(spark, [(600, 0.2)], "window_end long, human_likeness double")
    assert [r.human_likeness for r in detect.as_of(w, a, ["human_likeness"]).orderBy("window_end").collect()] == [None, 0.2, 0.2]


def test_suppression_reasons(spark):
    cases = [(0.9, False, True, True, "suppress"), (0.9, False, True, False, "downweight"), (0.4, False, False, False, "downweight"), (0.9, True, False, False, "downweight"), (0.9, False, False, False, None), (None, None, None, None, None)]
    w = spark.createDataFrame([(*c[:4], i) for i, c in enumerate(cases)], "human_likeness double, is_known boolean, is_verified boolean, robots_txt boolean, i int")
    got = detect.suppression(w).orderBy("i").collect()
    assert [r.action for r in got] == [c[4] for c in cases] and "keeps to robots.txt" in got[0].action_reason and got[4].action_reason is None


def test_calibration_edges(spark):
    pop = spark.createDataFrame([(float(i),) for i in range(101)], "s double")
    got = scoring.calibrated(spark.createDataFrame([(-1.0,), (0.0,), (50.0,), (100.0,), (1e9,)], "s double"), "s", scoring.grid(pop, "s"), "p").collect()
    assert [r.p for r in got] == [0.0, 0.001, 0.501, 1.0, 1.0]


def test_hygiene_and_sample(spark):
    pop = spark.createDataFrame([(float(i % 50), i) for i in range(1000)], "s double, i int")
    kept = scoring.without_most_anomalous(pop, "s", share=0.01)
    assert kept.count() == 990 and kept.where("s = 49").count() == 10
    got = scoring.reference_sample(pop, ["i"], 100)
    assert sorted(r.i for r in got.collect()) == list(range(0, 1000, 10))


def test_psi(spark):
    ref = spark.createDataFrame([("f", float(i)) for i in range(1000)], "feature string, value double")
    far = ref.withColumn("value", F.col("value") + 600)
    assert drift.stability(ref, ref).first().psi < 0.001 and drift.stability(ref, far).first().psi > 0.25
    report = drift.drift_report(drift.stability(ref, far)).first()
    assert report.band == "significant" and report.drifted == ["f"] and report.retrain is False


def test_forest_ranks_the_outlier_first_and_repeats(spark):
    data = spark.createDataFrame([(math.sin(i), math.cos(i * 1.7)) for i in range(400)] + [(9.0, -9.0)], "x double, y double")
    forest = models.IsolationForest.fit(data, ["x", "y"], trees=40)
    got = forest.score(data).orderBy(F.desc("iforest")).first()
    assert (got.x, got.y) == (9.0, -9.0) and 0.6 < got.iforest <= 1
    again = models.IsolationForest.fit(data.repartition(3), ["x", "y"], trees=40)
    assert all((a == b).all() for a, b in zip(forest.trees, again.trees, strict=True))


def test_bot_models_and_their_ladder(spark):
    data = spark.createDataFrame([(float(i % 2) + (i % 7) / 10, float(i % 5), float(i % 2)) for i in range(300)], "a double, b double, bot_declared_bot double")
    trees = models.BotTrees.fit(data, ["a", "b"])
    assert trees.isotonic is not None
    got = trees.score(data).agg(F.avg(F.when(F.col("bot_declared_bot") == 1, F.col("gbm_bot"))), F.avg(F.when(F.col("bot_declared_bot") == 0, F.col("gbm_bot")))).first()
    assert got[0] > 0.9 and got[1] < 0.1
    assert models.BotTrees.fit(data.where("bot_declared_bot = 0"), ["a", "b"]).score(data).first().gbm_bot == 0.0
    likeness = models.BotMixture.fit(data, ["a", "b"], most=3).score(data)
    assert likeness.where("gmm < -0.001 or gmm > 1.001").count() == 0
    absent = type("Absent", (), {"available": staticmethod(lambda: False)})
    assert plugins.available({"gbm": models.BotTrees, "clusters": models.CrawlerClusters, "absent": absent}) == {"gbm": models.BotTrees, "clusters": models.CrawlerClusters}


def test_mixture_finds_its_parts_and_repeats(spark):
    rng = np.random.default_rng(1)
    near, far = rng.normal(0, 1, (400, 2)), rng.normal(0, 0.5, (200, 2)) + [40, 10]
    rows = [(*map(float, x), float(bot)) for part, bot in ((near, 0), (far, 1)) for x in part]
    data = spark.createDataFrame(rows, "a double, b double, bot_declared_bot double")
    got = models.BotMixture.fit(data, ["a", "b"])
    again = models.BotMixture.fit(data.repartition(5), ["a", "b"])
    assert len(got.shares) == 2 and np.allclose(sorted(got.shares), [0, 1], atol=1e-9)
    order = np.argsort(got.parts[1][:, 0])
    means = got.parts[1][order] * got.shape[1] + got.shape[0]
    assert np.allclose(means, [near.mean(axis=0), far.mean(axis=0)], atol=1e-6)
    assert np.allclose(got.parts[2][order] * got.shape[1] ** 2, [near.var(axis=0), far.var(axis=0)] + 1e-4 * got.shape[1] ** 2, rtol=1e-6)
    assert all(np.allclose(a, b) for a, b in zip(got.parts, again.parts, strict=True))
    scored = got.score(data).groupBy("bot_declared_bot").agg(F.min("gmm").alias("low"), F.max("gmm").alias("high"))
    assert {r[0]: (round(r.low, 6), round(r.high, 6)) for r in scored.collect()} == {0.0: (0.0, 0.0), 1.0: (1.0, 1.0)}
    one = models.BotMixture.fit(data.where("bot_declared_bot = 0").limit(9), ["a", "b"])
    assert one.shares == [0.0] and len(one.parts[0]) == 1


def traffic(spark, humans=40, pages=60, start=1_700_000_000):
    """Browsing clients: a page, its assets, pauses; and declared bots that crawl like clocks."""
    i = F.col("id")
    odd = F.xxhash64("id", F.lit(3)) % 60 == 0
    client, n = (i % humans).cast("int"), F.floor(i / humans).cast("long")
    people = spark.range(humans * pages).select(
        (F.lit(start) + n * 37 + (F.xxhash64("id") % 15)).cast("long").alias("epoch"), F.concat(F.lit("10.0.0."), client).alias("source_ip"), F.lit("Mozilla/5.0 (X11) Firefox/120.0").alias("user_agent"),
        F.when(odd, F.concat(F.lit("/missing"), n, F.lit(".bak"))).when(n % 3 == 0, F.concat(F.lit("/page"), (F.xxhash64("id", F.lit(1)) % 5 + 5), F.lit(".html"))).otherwise(F.concat(F.lit("/static/app"), (n % 4), F.lit(".js"))).alias("url_path"),
        F.when(odd, 404).when(n % 11 == 0, 304).otherwise(200).alias("status_code"), F.when(n % 3 == 0, F.lit(None)).otherwise(F.lit("/page1.html")).cast("string").alias("referrer"), (F.xxhash64("id", F.lit(2)) % 500 + 900).alias("body_bytes"),
    )
    bots = spark.range(3 * 220).select(
        "id",
        (F.lit(start) + F.floor(F.col("id") / 3) * 10).cast("long").alias("epoch"), F.concat(F.lit("10.9.0."), F.col("id") % 3).alias("source_ip"), F.lit("curl/8.5.0").alias("user_agent"),
        F.concat(F.lit("/page"), F.col("id") % 5, F.lit(".html")).alias("url_path"), F.lit(200).alias("status_code"), F.lit(None).cast("string").alias("referrer"), F.lit(512).cast("long").alias("body_bytes"),
    )
    # Some browsers load like clocks for two windows.
    odd_ones = bots.where("id < 180").withColumn("user_agent", F.lit("Mozilla/5.0 (X11) Firefox/120.0")).withColumn("source_ip", F.replace("source_ip", F.lit("10.9."), F.lit("10.8.")))
    both = people.unionByName(bots.drop("id")).unionByName(odd_ones.drop("id")).withColumn("event_id", F.monotonically_increasing_id())
    return both.select(
        "event_id", F.timestamp_seconds("epoch").alias("ts"), (F.col("epoch") * 1000000).alias("us"), "epoch", F.lit("srv0").alias("server"), "source_ip", "user_agent", "url_path", "status_code", F.lit("GET").alias("http_method"), "referrer",
        "body_bytes", F.lit("US").alias("geo_country"), F.lit("access").alias("event_type_ecs"), F.concat("source_ip", F.lit(" "), "url_path").alias("original"),
    ).persist()


@pytest.fixture(scope="module")
def bundles(spark):
    requests = traffic(spark)
    return requests, detection.train(requests, "bot_detection", "v1"), detection.train(requests, "web_recon", "v1")


def test_both_canaries_fire(spark, bundles):
    requests, bots, recon = bundles
    start = requests.agg(F.min("epoch")).first()[0] // 300 * 300
    canary = canaries.scan_canary(spark, "srv0", start).unionByName(canaries.spoof_canary(spark, "srv0", start))
    docs, log = detection.both_usecases(requests.select(*canary.columns).unionByName(canary), bots, recon)
    fired = {(r.usecase, r.source_ip) for r in log.where("fired").select("usecase", "source_ip").distinct().collect()}
    assert ("web_recon", canaries.SCAN_IP) in fired and ("bot_detection", canaries.SPOOF_IP) in fired
    assert not any(ip.startswith("10.9.") for u, ip in fired if u == "bot_detection")
    doc = json.loads(docs.where("usecase = 'web_recon'").first().value)
    assert doc["event"]["kind"] == "alert" and doc["rule"]["id"] == "UC-02" and doc["explanation"]["top_features"] and "requests" in doc["explanation"]["narrative"]


@pytest.mark.parametrize("population", [[], [0.0] * 5 + [1.0] * 3, [0.1 * i * i for i in range(40)], [1.0, 2.0, float("nan"), float("inf")]])
def test_percentiles_count_the_grid(spark, population):
    grid = scoring.grid(spark.createDataFrame([(x,) for x in population], "s double"), "s")
    rows = spark.createDataFrame([(x,) for x in [*population, None, -9.0, 9.0, 0.0, -0.0, float("inf"), float("-inf")]], "s double")
    counted = F.least(F.lit(1.0), F.size(F.filter("grid", lambda g: g <= F.col("s"))) / 1000.0)
    both = scoring.calibrated(rows, "s", grid, "p").crossJoin(F.broadcast(grid)).select("p", F.when(F.col("grid").isNull(), 0.0).otherwise(counted).alias("q"))
    assert all(r.p == r.q for r in both.collect()) and both.count() == len(population) + 7


def test_too_little_to_train(spark):
    with pytest.raises(detection.TrainingError):
        detection.train(traffic(spark, 1, 5).limit(5), "web_recon", "v1")


def test_registry_round_trip(spark, bundles, tmp_path):
    requests, bots, recon = bundles
    reg = registry.Registry(str(tmp_path))
    for b in (bots, recon):
        reg.add(b)
        assert reg.promote(b.usecase) == "v1" and reg.candidate(b.usecase) is None
        back = reg.load_current(spark, b.usecase)
        w = detection.window_features(requests, b.profile).persist()
        order = ["server", "source_ip", "ua_hash", "window_start"]
        a, c = [detection.score_windows(w, x).orderBy(*order).select("fused_pct").collect() for x in (b, back)]
        assert [r[0] for r in a] == pytest.approx([r[0] for r in c])
    with pytest.raises(ValueError):
        reg.rollback("web_recon")
    for v in ("v2", "v3", "v4", "v5", "v6"):
        (tmp_path / "web_recon" / v).mkdir()
    reg.promote("web_recon", "v6")
    assert reg.versions("web_recon") == ["v3", "v4", "v5", "v6"] and reg.rollback("web_recon") == "v5"


def test_order_of_usecases():
    assert plugins.dependency_order({"web_recon": ["bot_detection"], "bot_detection": [], "a": ["gone"]}) == ["a", "bot_detection", "web_recon"]
    with pytest.raises(ValueError):
        plugins.dependency_order({"a": ["b"], "b": ["a"]})


def test_records_of_lines(spark):
    from weblens.plans.scalar_queries import LINES, parsed

    rows_ = parsed(spark)
    assert ndjson.records(rows_).count() == 2 and {r.reason for r in ndjson.dead_letters(rows_).collect()} == {"json", "missing @timestamp", "bad @timestamp"}
    assert ndjson.ingest_stats(rows_).first().lines == len(LINES)


def test_neighbours_over_blocks(spark, monkeypatch):
    """Density by blocks of a few rows equals plain distances; every row is scored and in the reference."""
    for name, value in (("BLOCK", 7), ("STEP", 3), ("SAMPLE", 12), ("PIVOTS", 4)):
        monkeypatch.setattr(neighbours, name, value)
    points = [(i, math.sin(i) * (i % 5), float(i % 3)) for i in range(60)] + [(99, 30.0, 30.0)]
    k, near = 4, {}
    for i, *x in points:
        near[i] = sorted((math.dist(x, y), j) for j, *y in points if j != i)[:k]
    lrd = {i: 1 / (sum(max(d, near[j][-1][0]) for d, j in n) / k + 1e-10) for i, n in near.items()}
    want = {i: sum(lrd[j] for _, j in n) / k / lrd[i] for i, n in near.items()}
    got = models.lof_scores(spark.createDataFrame(points, "id long, x double, y double"), ["x", "y"], k).collect()
    assert {r.id: pytest.approx(r.lof) for r in got} == want


def test_neighbours_send_a_block_once_a_group(spark, monkeypatch):
    """Vectors without clusters in 63 blocks that all meet: what is shuffled follows the groups, not the pairs of blocks; distances are exact."""
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    monkeypatch.setattr(neighbours, "SAMPLE", 128)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for blocks that are too large to broadcast
    x = np.random.default_rng(5).normal(size=(4000, 64))
    x[1::500] = x[::500]  # copies
    names = [f"x{i}" for i in range(64)]
    rows = spark.createDataFrame([(i, *v) for i, v in enumerate(x.tolist())], ["id", *names]).persist()
    rows.count()
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark._jvm
    written = lambda: sum(s.shuffleWriteBytes() for s in jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())))
    before = written()
    got = neighbours.nearest(rows, rows, names, 5).collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert written() - before < 30 * x.nbytes  # 63 times while a block was sent for each pair
    d = neighbours.squared(x, x)
    np.fill_diagonal(d, np.inf)
    found = {}
    for r in sorted(got, key=lambda r: (r.q, r.d, r.r)):
        found.setdefault(r.q, []).append(r.r)
    assert found == dict(enumerate(np.argsort(d, axis=1, kind="stable")[:, :5].tolist()))


def test_possible_pairs_miss_none():
    rng = np.random.default_rng(6)
    for scale in (1e-30, 1e-3, 1.0, 1e6, 1e18, 1e25):
        a, c = rng.normal(size=(40, 9)) * scale, rng.normal(size=(50, 9)) * scale
        c[:10] = a[:10]
        d = neighbours.squared(a, c)
        for bound in (np.zeros(40), neighbours.kth(d, 3), np.full(40, np.inf)):
            assert set(zip(*np.nonzero(d <= bound[:, None]), strict=True)) <= set(zip(*neighbours.possible(a, c, bound), strict=True))


def test_hygiene_of_equal_scores(spark):
    pop = spark.range(500).select(F.lit(1.0).alias("s"), "id")
    assert scoring.without_most_anomalous(pop, "s", share=0.1).count() == 450


def test_records_and_ages(spark):
    from weblens.operators import detect

    row = spark.createDataFrame([("s", "i", "u", 0, 300, 7, 0.1234567, 0.5, None)], "server string, source_ip string, ua_hash string, window_start long, window_end long, event_count long, m double, fused_pct double, f double")
    got = detect.score_records(row, {"m": ("m", "fused_pct")}, 0.4, ["f"]).first()
    assert (got.fused, got.fired, got.raw, got.percentiles, got.features) == (0.5, True, {"m": 0.12346}, {"m": 0.5}, {"f": None}) and got.reasons == ["fused 0.5 at or above 0.4"]


def test_a_use_case_that_a_deployment_adds(spark, bundles):
    from weblens.plans import usecases

    @usecases.usecase
    class Floods(usecases.UseCase):
        name, rule, title, gate_pct = "floods", "UC-90", "Floods", 0.9
        features = ("web_uniq_paths_per_min", "bot_path_repeat_ratio")
        depends_on = ("web_recon",)

    requests, bots, recon = bundles
    assert usecases.in_order(["floods", "web_recon", "bot_detection"]) == ["bot_detection", "web_recon", "floods"]
    bundle = detection.train(requests, "floods", "v1")
    log = detection.judged(detection.score_windows(detection.window_features(requests, bundle.profile), bundle), bundle)
    assert log.where("fired").count() > 0 and len(bundle.metadata["feature_code_sha256"]) == 64


def test_candidate_check(spark, bundles):
    requests, _, recon = bundles
    got = detection.candidate_check(requests, recon, recon).first()
    assert got.serving_rate == got.candidate_rate and got.serving_canary and got.approve and got.reason is None


def test_catalogue(spark, tmp_path):
    (tmp_path / "web_recon" / "v1").mkdir(parents=True)
    reg = registry.Registry(str(tmp_path))
    reg.promote("web_recon", "v1")
    got = {r.usecase: (r.implemented, r.current, r.versions) for r in registry.catalogue(spark, reg, {"planned": "Planned"}).collect()}
    assert got["planned"] == (False, None, 0) and got["web_recon"] == (True, "v1", 1) and got["bot_detection"] == (True, None, 0)


def test_state_store(spark, tmp_path):
    from weblens.operators.groups import StateStore

    store = StateStore(spark, str(tmp_path / "state"))
    assert store.get().collect() == [] == store.count_unique().collect()
    rows = spark.createDataFrame([("a", 2, 10), ("a", 3, 20), ("b", 1, 20)], "key string, n long, at long")
    store.incr(rows, "0")
    store.incr(rows, "0")  # a job that runs again
    store.add_unique(rows.selectExpr("key", "cast(n as string) as member", "at"))
    store.add_unique(rows.selectExpr("key", "cast(n as string) as member", "at"))
    assert {r.key: r.n for r in store.get().collect()} == {"a": 5, "b": 1} and {r.key: r.n for r in store.count_unique().collect()} == {"a": 2, "b": 1}
    left = store.expire(15)
    assert {r.key: r.n for r in left.get().collect()} == {"a": 3, "b": 1} == {r.key: r.n + 2 * (r.key == "a") for r in left.count_unique().collect()}


def test_neighbours_of_a_reference_and_on_one_scale(spark, monkeypatch):
    """Queries outside the reference, more neighbours than there are, copies, nulls, and a scale from the reference."""
    for name, value in (("BLOCK", 9), ("STEP", 4), ("SAMPLE", 20), ("PIVOTS", 6)):
        monkeypatch.setattr(neighbours, name, value)
    r = np.random.default_rng(2)
    points = {i: (r.normal(size=3) * [1, 9, 0.1] + r.integers(4) * 6).tolist() for i in range(150)} | {200 + i: [1.0, 2.0, 3.0] for i in range(15)}
    points[300] = [None, math.nan, 1.0]
    asked = {i: x for i, x in points.items() if i % 3 == 0} | {1000 + i: (r.normal(size=3) * 20).tolist() for i in range(20)}
    frame = lambda d: spark.createDataFrame([(i, *x) for i, x in d.items()], "id long, x double, y double, z double")
    zero = lambda x: [0.0 if v is None or math.isnan(v) else v for v in x]
    for k in (3, 170):
        got = {}
        for q, i, d in neighbours.nearest(frame(asked), frame(points), ["x", "y", "z"], k).collect():
            got.setdefault(q, []).append((d, i))
        for q, x in asked.items():
            want = sorted((math.dist(zero(x), zero(y)), i) for i, y in points.items() if i != q)[:k]
            mine = sorted(got[q])
            assert [d for d, _ in mine] == pytest.approx([d for d, _ in want]) and len({i for _, i in mine}) == len(want)
            assert {i for d, i in mine if d < want[-1][0] - 1e-9} == {i for d, i in want if d < want[-1][0] - 1e-9}
    plain = {i: x for i, x in points.items() if i != 300}
    v = np.array(list(plain.values()))
    scale = dict(zip(plain, ((v - v.mean(axis=0)) / v.std(axis=0)).tolist(), strict=True))
    a = {x.id: x.lof for x in models.lof_scores(frame(plain), ["x", "y", "z"], 5, scale=True).collect()}
    b = {x.id: x.lof for x in models.lof_scores(frame(scale), ["x", "y", "z"], 5).collect()}
    assert a == {i: pytest.approx(x, rel=1e-6) for i, x in b.items()}
    assert neighbours.nearest(frame(points).where("false"), frame(points), ["x", "y", "z"], 3).collect() == []
    assert neighbours.nearest(frame(asked), frame(points).where("false"), ["x", "y", "z"], 3).collect() == []
