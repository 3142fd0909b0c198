"""Queries of statistics, calibration, drift, models, training and backtests, with SQL where it can tell the same."""

from pyspark.sql import functions as F

from weblens.functions import fixed
from weblens.operators import detect as D
from weblens.operators import drift, models, neighbours, scoring
from weblens.operators import features as W
from weblens.plans import detection
from weblens.plans.scalar_queries import BOT_SQL, requests, table
from weblens.sources import web_view

QUERIES: dict = {}
SQL: dict[str, str] = {}
DAY = 86400
IDS = ["server", "source_ip", "ua_hash", "window_start"]
ENT = "server, source_ip, ua_hash"
#: Features that the SQL forms cover.
SOME = ("web_ratio_404", "web_referrer_absent_ratio", "bot_path_repeat_ratio", "bot_declared_bot")
WIN_SQL = f""", wv as (select {ENT}, epoch // {DAY} * {DAY} as window_start, count_if(status_code = 404) / count(*) as web_ratio_404, count_if(referrer is null) / count(*) as web_referrer_absent_ratio,
(count(*) - count(distinct url_path)) / count(*) as bot_path_repeat_ratio, case when {BOT_SQL.format('max(user_agent)')} then 1.0::double else 0.0::double end as bot_declared_bot from req group by all),
lf as (select {ENT}, window_start, unnest(['web_ratio_404', 'web_referrer_absent_ratio', 'bot_path_repeat_ratio', 'bot_declared_bot']) as feature, unnest([web_ratio_404, web_referrer_absent_ratio, bot_path_repeat_ratio, bot_declared_bot]) as value from wv)"""


def query(sql: str | None = None, web: bool = True):
    def add(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = f"with {web_view.SQL}{WIN_SQL}{sql}" if web else sql
        return run

    return add


def windows(spark, d):
    """The part of the windows that the SQL covers: one aggregate."""
    rows = W.keyed(requests(spark, d), DAY).groupBy(*W.KEY)
    n, paths = F.count("*"), F.count_distinct("url_path")
    from weblens.functions.expressions import declared_bot

    got = rows.agg(W.ratio(F.count_if(F.col("status_code") == 404), n).alias("web_ratio_404"), W.ratio(F.count_if(F.col("referrer").isNull()), n).alias("web_referrer_absent_ratio"), ((n - paths) / n).alias("bot_path_repeat_ratio"), declared_bot(F.max("user_agent")).cast("double").alias("bot_declared_bot"))
    return got.withColumn("window_start", F.col("bucket") * DAY).drop("bucket")


def long_rows(spark, d):
    return W.long_form(windows(spark, d), IDS, SOME)


STATS_SQL = ", st as (select feature, quantile_cont(value, 0.5) as p50, quantile_cont(value, 0.99) as p99 from lf group by 1)"


@query(f"{STATS_SQL} select feature, round(p50, 6) as p50, round(p99, 6) as p99 from st")
def feature_stats(spark, d):
    s = scoring.feature_stats(long_rows(spark, d))
    return s.select("feature", F.round("p50", 6).alias("p50"), F.round("p99", 6).alias("p99"))


@query(" select feature, round(quantile_cont(value, 0.999), 6) as bound from lf group by 1 having not bool_and(value in (0.0, 1.0))")
def clip_bounds(spark, d):
    return scoring.clip_bounds(long_rows(spark, d)).select("feature", F.round("bound", 6).alias("bound"))


@query(f"{STATS_SQL} select {ENT}, window_start, round(web_ratio_404 - (select p50 from st where feature = 'web_ratio_404'), 6) as web_ratio_404_delta from wv")
def ratio404_delta(spark, d):
    w = windows(spark, d)
    stats = scoring.feature_stats(W.long_form(w, [], ("web_ratio_404",)))
    p50 = stats.first().p50
    return w.select(*IDS, F.round(F.col("web_ratio_404") - F.lit(p50), 6).alias("web_ratio_404_delta"))


@query(" select " + f"{ENT}, window_start, " + ", ".join(f"round(({c} - avg({c}) over ()) / (stddev_pop({c}) over () + 1e-9), 6) as {c}" for c in SOME) + " from wv")
def zscore(spark, d):
    return scoring.zscores(windows(spark, d), list(SOME)).select(*IDS, *[F.round(c, 6).alias(c) for c in SOME])


@query(f"""{STATS_SQL}, dv as (select lf.*, p50, p99, least((value - p50) / (p99 - p50 + 1e-9), 999.0) as deviation from lf join st using (feature)),
rk as (select *, row_number() over (partition by {ENT}, window_start order by deviation desc, list_position(['web_ratio_404', 'web_referrer_absent_ratio', 'bot_path_repeat_ratio', 'bot_declared_bot'], feature)) as rank from dv)
select {ENT}, window_start, rank, feature, round(value, 4) as value, round(deviation, 2) as deviation from rk where rank <= 3""")
def top_features(spark, d):
    long = long_rows(spark, d)
    got = D.top_features(long, scoring.feature_stats(long), IDS, 3, SOME)
    return got.select(*IDS, F.col("rank").cast("long").alias("rank"), "feature", F.round("value", 4).alias("value"), F.round("deviation", 2).alias("deviation"))


GRID_SQL = f", gr as (select quantile_cont(web_referrer_absent_ratio, [{', '.join(str(i / 1000) for i in range(1001))}]) as grid from wv)"


@query(f"{GRID_SQL} select i as step, round(grid[i + 1], 6) as score from gr, range(1001) t(i)")
def calibration_grid(spark, d):
    g = scoring.grid(windows(spark, d), "web_referrer_absent_ratio")
    return g.select(F.posexplode("grid").alias("step", "score")).select(F.col("step").cast("long").alias("step"), F.round("score", 6).alias("score"))


@query(f"{GRID_SQL} select {ENT}, window_start, least(1.0::double, len(list_filter(grid, lambda x: x <= web_referrer_absent_ratio)) / 1000.0::double) as pct from wv, gr")
def calibrate(spark, d):
    w = windows(spark, d)
    return scoring.calibrated(w, "web_referrer_absent_ratio", scoring.grid(w, "web_referrer_absent_ratio"), "pct").select(*IDS, "pct")


@query(" , b as (select count(*) as n from wv where bot_declared_bot < 0.5) select case when n >= 20 then n else (select count(*) from wv) end as n from b")
def calibration_population(spark, d):
    return scoring.calibration_rows(windows(spark, d)).agg(F.count("*").alias("n"))


PSI_SQL = """, ref as (select feature, value from lf where window_start < 1705363200), cur as (select feature, value from lf where window_start >= 1705363200),
ed as (select feature, list_sort(list_distinct(quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) as e from ref group by 1),
bn as (select feature, len(list_filter(e[2:len(e) - 1], lambda x: x <= value)) as bin, side from (select *, 0 as side from ref union all select *, 1 as side from cur) join ed using (feature)),
ct as (select feature, bin, count_if(side = 0) as r, count_if(side = 1) as c from bn group by all), tt as (select feature, sum(r) as rn, sum(c) as cn from ct group by 1),
pr as (select feature, sum((greatest(c / cn, 1e-6) - greatest(r / rn, 1e-6)) * ln(greatest(c / cn, 1e-6) / greatest(r / rn, 1e-6))) as raw, max(rn) as rn, max(cn) as cn from ct join tt using (feature) where rn > 0 and cn > 0 group by 1),
ps as (select feature, case when len(e) < 3 or rn < 10 or cn < 10 then 0.0 else raw end as psi from pr join ed using (feature))"""


def psi_rows(spark, d):
    long = long_rows(spark, d)
    return drift.stability(long.where("window_start < 1705363200"), long.where("window_start >= 1705363200"))


@query(f"{PSI_SQL} select feature, round(psi, 6) as psi from ps")
def psi(spark, d):
    return psi_rows(spark, d).select("feature", F.round("psi", 6).alias("psi"))


@query(f"{PSI_SQL} select round(max(psi), 6) as max_psi, coalesce(string_agg(feature, ',' order by psi desc, feature) filter (where psi > 0.25), '') as drifted, case when max(psi) > 0.25 then 'significant' when max(psi) >= 0.1 then 'moderate' else 'stable' end as band, count_if(psi > 0.25) >= 2 as retrain from ps")
def drift_report(spark, d):
    r = drift.drift_report(psi_rows(spark, d))
    return r.select(F.round("max_psi", 6).alias("max_psi"), F.array_join("drifted", ",").alias("drifted"), "band", "retrain")


LOF_K = 10


@query(
    f"""with p as (select vec_id as id, embedding::double[] as e from embeddings where embedding is not null),
pd as (select a.id as q, b.id as r, list_distance(a.e, b.e) as d from p a join p b on a.id <> b.id),
nn as (select * from (select *, row_number() over (partition by q order by d, r) as n from pd) where n <= {LOF_K}), kd as (select q, max(d) as kd from nn group by 1),
ld as (select nn.q as q, 1.0 / (avg(greatest(d, kd)) + 1e-10) as lrd from nn join kd on kd.q = nn.r group by 1)
select nn.q as id, round(avg(o.lrd) / max(s.lrd), 5) as lof from nn join ld o on o.q = nn.r join ld s on s.q = nn.q group by 1""",
    web=False,
)
def lof_scores(spark, d):
    """All vectors of the table with all their components; those of one length are points of one space."""
    e = table(spark, d, "embeddings").where("embedding is not null")
    widths = sorted(r.n for r in e.select(F.size("embedding").alias("n")).distinct().collect() if r.n)  # a row a length
    out = spark.createDataFrame([], "id long, lof double")
    for width in widths:
        names = [f"x{i}" for i in range(width)]
        rows = e.where(F.size("embedding") == width).select(F.col("vec_id").alias("id"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(names)])
        out = out.union(models.lof_scores(rows, names, LOF_K))
    return out.select("id", F.round("lof", 5).alias("lof"))


CLIENT_FEATURES = ("requests", "paths", "mean_bytes", "failed")


@query(
    f""", c as (select server, source_ip, min(event_id) as id, count(*)::double as requests, count(distinct url_path)::double as paths, avg(body_bytes)::double as mean_bytes, (count_if(status_code >= 400) / count(*))::double as failed from req group by all),
s as (select {", ".join(f"avg({f}) as m_{f}, coalesce(nullif(stddev_pop({f}), 0), 1) as s_{f}" for f in CLIENT_FEATURES)} from c),
p as (select id, {", ".join(f"coalesce(round(({f} - m_{f}) / s_{f}, 9), 0) as {f}" for f in CLIENT_FEATURES)} from c, s),
pd as (select a.id as q, b.id as r, sqrt({" + ".join(f"(a.{f} - b.{f}) * (a.{f} - b.{f})" for f in CLIENT_FEATURES)}) as d from p a join p b on a.id <> b.id),
nn as (select * from (select *, row_number() over (partition by q order by d, r) as n from pd) where n <= {LOF_K}), kd as (select q, max(d) as kd from nn group by 1),
ld as (select nn.q as q, 1.0 / (avg(greatest(d, kd)) + 1e-10) as lrd from nn join kd on kd.q = nn.r group by 1)
select nn.q as id, round(avg(o.lrd) / max(s.lrd), 4) as lof from nn join ld o on o.q = nn.r join ld s on s.q = nn.q group by 1"""
)
def lof_clients(spark, d):
    """How sparse each client lies among all clients by what it asked for, features on one scale."""
    by = requests(spark, d).groupBy("server", "source_ip")
    rows = by.agg(F.min("event_id").alias("id"), F.count("*").cast("double").alias("requests"), F.countDistinct("url_path").cast("double").alias("paths"), F.avg("body_bytes").alias("mean_bytes"), (F.count_if(F.col("status_code") >= 400) / F.count("*")).alias("failed"))
    points = neighbours.scaled(rows, list(CLIENT_FEATURES)).select("id", *[F.round(f, 9).alias(f) for f in CLIENT_FEATURES])
    return models.lof_scores(points, list(CLIENT_FEATURES), LOF_K).select("id", F.round("lof", 4).alias("lof"))


# Fitted models, training and backtests: no SQL.


@query()
def iforest_scores(spark, d):
    w = windows(spark, d)
    return models.IsolationForest.fit(w, list(SOME)).score(w).select(*IDS, "iforest")


@query()
def gmm_association(spark, d):
    w = windows(spark, d)
    return models.BotMixture.fit(w, list(SOME)).score(w).select(*IDS, "gmm")


@query()
def gbm_bot(spark, d):
    w = windows(spark, d)
    return models.BotTrees.fit(w, list(SOME)).score(w).select(*IDS, "gbm_bot")


@query()
def crawler_clusters(spark, d):
    w = windows(spark, d)
    return models.CrawlerClusters.fit(w, [c for c in SOME if c != "bot_declared_bot"]).score(w).select(*IDS, "hdbscan_cluster")


@query()
def train_summary(spark, d):
    bundle = detection.train(requests(spark, d), "web_recon", "v1", DAY)
    return spark.createDataFrame([(k, str(v)) for k, v in sorted(bundle.metadata.items())], "item string, value string")


@query()
def score_windows(spark, d):
    r = requests(spark, d)
    bundle = detection.train(r, "web_recon", "v1", DAY)
    return detection.score_windows(W.window_features(r, bundle.profile, DAY), bundle).select(*IDS, "event_count", "iforest", "iforest_pct", "fused_pct")


@query()
def backtest_report(spark, d):
    log, _, _ = detection.backtest(requests(spark, d), "web_recon", window_s=3600)
    return detection.backtest_report(log)


@query()
def alert_docs(spark, d):
    _, sent, bundle = detection.backtest(requests(spark, d), "web_recon", window_s=3600)
    return D.alert_documents(sent, "web_recon", bundle.version, sorted(bundle.models))


@query()
def compare_models(spark, d):
    r = requests(spark, d)
    before, after, _ = detection.split_by_time(r)
    a, b = detection.train(before, "web_recon", "v1", DAY), detection.train(r, "web_recon", "v2", DAY)
    return detection.compared(W.window_features(after, a.profile, DAY), a, b)
