"""Numbers worked out by hand for scalar expressions, windows and sessions."""

import pytest
from pyspark.sql import functions as F

from weblens.functions import expressions as X
from weblens.functions import fixed
from weblens.operators import features as W
from weblens.operators import profile as P
from weblens.operators import sessions as S
from weblens.plans import feature_queries, scalar_queries
from weblens.sources import canaries

COLUMNS = "event_id long, epoch long, server string, source_ip string, user_agent string, url_path string, status_code int, http_method string, referrer string, body_bytes long, geo_country string, event_type_ecs string"
UA = "Mozilla/5.0 (X11) Firefox/120.0"


def frame(spark, rows):
    """Rows (epoch, path, status, method, referrer, bytes) of one client."""
    full = [(i, e, "srv0", "203.0.113.5", UA, p, s, m, r, b, "US", "access") for i, (e, p, s, m, r, b) in enumerate(rows)]
    got = spark.createDataFrame(full, COLUMNS)
    return got.withColumn("ts", F.timestamp_seconds("epoch")).withColumn("us", F.col("epoch") * 1000000).withColumn("original", F.col("url_path"))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("path, ext", [("/a/b.sql", "sql"), ("/.git.config", None), ("/a.b?v=1", "b"), ("/x.verylongext1", None), ("/A.JS#t", "js"), ("/", None), (None, None), ("/a.", None)])
def test_extension(spark, path, ext):
    assert one(spark, X.extension(F.lit(path).cast("string"))) == ext


@pytest.mark.parametrize("ref, path", [("https://s.example/a/b?x=1", "/a/b"), ("https://s.example", "/"), ("/p#f", "/p"), ("?q", None), ("", None), (None, None)])
def test_referrer_path(spark, ref, path):
    assert one(spark, X.referrer_path(F.lit(ref).cast("string"))) == path


@pytest.mark.parametrize(
    "ip, family, yes",
    [("203.0.113.5", "googlebot", False), ("66.249.95.255", "googlebot", True), ("66.249.96.0", "googlebot", False), ("20.43.120.27", "bingbot", True), ("20.43.121.5", "bingbot", False), ("66.249.64.1", "bingbot", False),
     ("2001:4860:4801:10::1", "googlebot", True), ("2001:4860:4802::1", "googlebot", False), ("2001:4860:4801::", "googlebot", True), ("::1", "googlebot", False), ("garbage", "googlebot", False), (None, "googlebot", False), ("66.249.64.1", None, False)],
)
def test_verified(spark, ip, family, yes):
    assert one(spark, X.in_family(F.lit(ip).cast("string"), F.lit(family).cast("string"))) is yes


@pytest.mark.parametrize("c, score", [(0.625, 62), (0.635, 64), (0.0, 0), (1.0, 100)])
def test_severity(spark, c, score):
    assert one(spark, X.severity_score(F.lit(c))) == score


def test_severity_outside(spark):
    with pytest.raises(Exception, match="outside"):
        one(spark, X.severity_score(F.lit(1.5)))


def scanner(spark):
    rows = [(600 + 10 * i, f"/old/x{i}.sql", 404, "GET", None, 10) for i in range(8)] + [(680 + 10 * i, "/index.html", 200, "GET", None, 10) for i in range(2)]
    return frame(spark, rows)


def test_scanner_window(spark):
    history = frame(spark, [(i, "/index.html", 200, "GET", None, 10) for i in range(50)])
    got = W.window_features(scanner(spark), P.learn(history)).collect()
    assert len(got) == 1
    w = got[0]
    assert (w.web_ratio_404, w.web_status_2xx_ratio, w.web_unknown_ext_ratio, w.web_uniq_paths_per_min, w.web_referrer_absent_ratio, w.timing_interarrival_cv) == (0.8, 0.2, 0.8, 1.8, 1.0, 0.0)
    assert w.web_mean_path_idf == pytest.approx(0.8) and w.event_count == 10 and w.distinct_paths == 9 and w.window_start == 600 and w.window_end == 900
    assert w.bot_path_repeat_ratio == 0.1 and w.bot_method_get_ratio == 1.0 and w.bot_bytes_per_req_p50 == 10.0 and len(w.raw_lines) == 10


def test_windows_split_by_bucket_and_empty_profile(spark):
    rows = frame(spark, [(299, "/a", 200, "GET", None, None), (300, "/a", None, None, None, None), (300, None, 500, "POST", "/a", 5)])
    got = sorted(W.window_features(rows, P.learn(rows.limit(0))).collect(), key=lambda w: w.window_start)
    assert [(w.window_start, w.event_count) for w in got] == [(0, 1), (300, 2)]
    assert got[1].web_mean_path_idf == 0.5 and got[1].web_status_5xx_ratio == 0.5 and got[1].bot_method_get_ratio == 0.0 and got[0].ua_rarity == 1.0


def test_chain_fano_and_assets(spark):
    chain = frame(spark, [(0, "/a", 200, "GET", None, 1), (1, "/b", 200, "GET", "https://s/a", 1), (2, "/c", 200, "GET", "/b", 1), (3, "/d.css", 200, "GET", "/c?x", 1)])
    w = W.window_features(chain, P.learn(chain)).first()
    assert w.bot_referrer_chain_depth == 4.0 and w.bot_asset_fetch_ratio == 0.25
    assert w.timing_fano_factor == pytest.approx((16 / 10 - 0.16) / 0.4)
    flat = frame(spark, [(30 * i, "/a", 200, "GET", "/a", 1) for i in range(10)])
    w = W.window_features(flat, P.learn(flat)).first()
    assert w.timing_fano_factor == 0.0 and w.bot_referrer_chain_depth == 10.0


def test_long_chains_and_many_paths(spark):
    n = 4 * fixed.MAX_CHAIN + 300
    same = frame(spark, [(0, "/b", 200, "GET", None, 1)] + [(i // 100 + 1, "/a", 200, "GET", "/a", 1) for i in range(n)])
    got = W.chain_depth(W.keyed(same, 86400)).collect()
    assert [r.bot_referrer_chain_depth for r in got] == [float(n)]
    # The path that fills the table is the last that counts.
    many = [(i // 100, f"/{i}", 200, "GET", None, 1) for i in range(fixed.MAX_CHAIN - 1)] + [(99, "/x", 200, "GET", "/1", 1)] + [(100 + i, "/x", 200, "GET", "/x", 1) for i in range(9)]
    assert W.chain_depth(W.keyed(frame(spark, many), 86400)).first().bot_referrer_chain_depth == 2.0


def test_memory_before_a_batch(spark):
    rows = frame(spark, [(0, "/robots.txt", 200, "GET", None, 1), (3600, "/a", 200, "GET", None, 1), (7200, "/b", 200, "GET", None, 1), (7201, "/b", 200, "GET", None, 1)])
    whole = {w.window_start: w for w in W.window_features(rows, P.learn(rows)).collect()}
    late = rows.where("epoch >= 7200")
    part = W.window_features(late, P.learn(rows), before=W.activity(rows.where("epoch < 7200"))).first()
    assert part.bot_activity_hour_entropy == pytest.approx(whole[7200].bot_activity_hour_entropy) and part.bot_robots_txt_fetched == 1.0


def test_session_boundary(spark):
    rows = frame(spark, [(0, "/a", 200, "GET", None, 1), (1800, "/b", 404, "POST", "/a", 1), (3601, "/a", 200, "GET", None, 1)])
    assert [r.session_id for r in S.sessionized(rows).orderBy("epoch").collect()] == [1, 1, 2]
    first = S.session_features(S.sessionized(rows)).orderBy("session_id").first()
    assert (first.duration_s, first.event_count, first.unique_paths, first.entry_path, first.exit_path) == (1800.0, 2.0, 2.0, "/a", "/b")
    assert first.status_4xx_notfound_ratio == 0.5 and first.method_post_ratio == 0.5 and first.referrer_present_ratio == 0.5 and first.mean_inter_arrival == 1800.0


def test_canaries(spark):
    scan, spoof = canaries.scan_canary(spark, "s", 0), canaries.spoof_canary(spark, "s", 0)
    assert scan.count() == 150 and spoof.count() == 1350
    assert scan.where("status_code = 404").count() == 135 and scan.agg(F.max("epoch")).first()[0] == 298 + (149 * 7) % 3


def test_chain_depth_of_the_query_equals_a_walk(spark):
    d = "/root/testdata/sf0.001"
    rows = W.keyed(scalar_queries.requests(spark, d), 86400).withColumn("ref", X.referrer_path(F.col("referrer"))).where("url_path <> ''").orderBy("us", "event_id")
    known, most = {}, {}
    for r in rows.select("server", "source_ip", "ua_hash", "bucket", "url_path", "ref").collect():
        key = (r.server, r.source_ip, r.ua_hash, r.bucket * 86400)
        paths = known.setdefault(key, {})
        if len(paths) < fixed.MAX_CHAIN:
            depth = paths.get(r.ref, 0) + 1
            paths[r.url_path] = max(depth, paths.get(r.url_path, 0))
            most[key] = max(depth, most.get(key, 0))
    got = {tuple(r[:4]): r[4] for r in feature_queries.win_ref_chain(spark, d).collect()}
    assert most and got == {k: float(most.get(k, 0)) for k in got} and set(most) <= set(got)
