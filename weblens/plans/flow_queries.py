"""Queries of gates, streaks, annotations, suppression, folding, budgets and logs, with their SQL.

They run over daily windows with a score that follows from the events, so that both engines see the same one.
"""

from pyspark.sql import functions as F

from weblens.functions import expressions as X
from weblens.functions import fixed
from weblens.operators import detect as D
from weblens.operators import features as W
from weblens.operators import scoring
from weblens.plans import detection
from weblens.plans.scalar_queries import BOT_SQL, requests
from weblens.sources import web_view

QUERIES: dict = {}
SQL: dict[str, str] = {}
DAY = 86400
IDS = ["server", "source_ip", "ua_hash", "window_start"]
ENT = "server, source_ip, ua_hash"

SCORED_SQL = f""", sw as (select {ENT}, epoch // {DAY} * {DAY} as window_start, (epoch // {DAY} + 1) * {DAY} as window_end, count(*) as event_count, count(distinct url_path) as distinct_paths, count_if(status_code = 404)::bigint as n404,
round((900 + max(k)) / 1000.0, 4) as fused_pct, max(user_agent) as user_agent, {BOT_SQL.format('max(user_agent)')} as declared_bot, min(k) as low_k from req group by all)"""


def query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = f"with {web_view.SQL}{SCORED_SQL}{sql}"
        return run

    return add


def scored(spark, d):
    rows = W.keyed(requests(spark, d), DAY).groupBy(*W.KEY).agg(
        F.count("*").alias("event_count"), F.count_distinct("url_path").alias("distinct_paths"), F.count_if(F.col("status_code") == 404).alias("n404"),
        F.round((F.max("k") + 900) / 1000.0, 4).alias("fused_pct"), F.max("user_agent").alias("user_agent"), F.min("k").alias("low_k"),
    )
    rows = rows.withColumn("declared_bot", X.declared_bot(F.col("user_agent"))).withColumn("window_start", F.col("bucket") * DAY)
    return rows.withColumn("window_end", F.col("window_start") + DAY).drop("bucket")


@query(f" select {ENT}, window_start, fused_pct, event_count >= 5 and distinct_paths >= 3 and fused_pct >= {fixed.RECON_GATE} as fired from sw")
def fuse_gate(spark, d):
    rows = scored(spark, d).withColumn("low_pct", F.col("fused_pct") - 0.1)
    return rows.select(*IDS, D.fused(["fused_pct", "low_pct"]).alias("fused_pct"), "event_count", "distinct_paths").withColumn("fired", D.recon_gate(F.col("fused_pct"))).select(*IDS, "fused_pct", "fired")


LOW_GATE = 0.95
STREAK_SQL = f""", ov as (select *, (fused_pct >= {LOW_GATE} and not declared_bot and event_count >= 1) as over from sw),
il as (select *, window_start // {DAY} - row_number() over (partition by {ENT}, over order by window_start) as island from ov),
st as (select *, case when over then row_number() over (partition by {ENT}, over, island order by window_start) else 0 end as streak from il)"""


@query(f"{STREAK_SQL} select {ENT}, window_start, streak, streak >= 2 as sustained from st")
def streak_gate(spark, d):
    """The same islands under a gate that the sparse test events reach."""
    rows = scored(spark, d).withColumn("fused_pct", F.col("fused_pct") + (fixed.BOT_GATE - LOW_GATE)).withColumn("event_count", F.col("event_count") + 4)
    rows = rows.withColumn("fused_pct", F.round("fused_pct", 4))
    return D.streaks(rows, "fused_pct", DAY).select(*IDS, F.col("streak").cast("long").alias("streak"), (F.col("streak") >= 2).alias("sustained"))


ANN_SQL = f""", an as (select {ENT}, window_end, round(low_k / 100.0, 4) as human_likeness, declared_bot as is_known, user_agent like '%Googlebot%' as is_verified, low_k % 2 = 0 as robots_txt from sw where low_k % 3 <> 0),
known as (select sw.*, last_value(an.human_likeness ignore nulls) over o as human_likeness, last_value(an.is_known ignore nulls) over o as is_known, last_value(an.is_verified ignore nulls) over o as is_verified, last_value(an.robots_txt ignore nulls) over o as robots_txt
from sw left join an using ({ENT}, window_end) window o as (partition by {ENT} order by window_end rows unbounded preceding))"""


def annotations(spark, d):
    rows = scored(spark, d).where("low_k % 3 <> 0")
    return rows.select("server", "source_ip", "ua_hash", "window_end", F.round(F.col("low_k") / 100.0, 4).alias("human_likeness"), F.col("declared_bot").alias("is_known"), F.coalesce(F.contains("user_agent", F.lit("Googlebot")), F.lit(None).cast("boolean")).alias("is_verified"), (F.col("low_k") % 2 == 0).alias("robots_txt"))


FIELDS = ["human_likeness", "is_known", "is_verified", "robots_txt"]


@query(f"{ANN_SQL} select {ENT}, window_end, human_likeness, is_known, robots_txt from known")
def annotation_asof(spark, d):
    return D.as_of(scored(spark, d), annotations(spark, d), FIELDS).select("server", "source_ip", "ua_hash", "window_end", "human_likeness", "is_known", "robots_txt")


ACT_SQL = f"""{ANN_SQL}, act as (select *, case when coalesce(is_verified, false) and coalesce(robots_txt, false) then 'suppress' when coalesce(is_verified, false) or coalesce(is_known, false) or coalesce(human_likeness < 0.5, false) then 'downweight' end as action,
cast(round_even(fused_pct * 100 * 1.0, 0) as int) as raw_score from known),
sup as (select *, case when action = 'downweight' then greatest(raw_score - 25, 0) else raw_score end as severity_score from act)"""
BAND = "case when {0} >= 90 then 'critical' when {0} >= 70 then 'high' when {0} >= 45 then 'medium' else 'low' end"


def judged(spark, d):
    return D.severities(D.suppression(D.as_of(scored(spark, d), annotations(spark, d), FIELDS)), "fused_pct")


@query(f"{ACT_SQL} select {ENT}, window_end, action, severity_score, {BAND.format('severity_score')} as severity from sup")
def suppression(spark, d):
    return judged(spark, d).select("server", "source_ip", "ua_hash", "window_end", "action", "severity_score", "severity")


FIRE = 0.96
FOLD_SQL = f""", fi as (select * from sw where fused_pct >= {FIRE}), f0 as (select *, case when coalesce(window_end - lag(window_end) over (partition by {ENT} order by window_end) > {2 * DAY}, true) then 1 else 0 end as s from fi),
f1 as (select *, sum(s) over (partition by {ENT} order by window_end rows unbounded preceding)::bigint as fold_id from f0),
f2 as (select *, row_number() over (partition by {ENT}, fold_id order by window_end) as place, count(*) over (partition by {ENT}, fold_id) - 1 as folded, max(fused_pct) over (partition by {ENT}, fold_id) as peak from f1)"""


@query(f"{FOLD_SQL} select {ENT}, window_end, fold_id, place, folded, peak from f2")
def alert_fold(spark, d):
    rows = D.folded(scored(spark, d).where(F.col("fused_pct") >= FIRE), "fused_pct", 2 * DAY)
    return rows.select("server", "source_ip", "ua_hash", "window_end", "fold_id", F.col("fold_place").cast("long").alias("place"), "folded", "peak")


@query(f" select {ENT}, window_end, row_number() over (partition by server, window_end // {DAY} order by window_end, source_ip, ua_hash) <= 3 as in_budget from sw where fused_pct >= {FIRE}")
def alert_budget(spark, d):
    return D.budgeted(scored(spark, d).where(F.col("fused_pct") >= FIRE), 3).select("server", "source_ip", "ua_hash", "window_end", "in_budget")


DELIVERY_SQL = f"""{ACT_SQL}, fired as (select * from sup where fused_pct >= {FIRE}), rest as (select * from fired where action is distinct from 'suppress'),
r0 as (select *, case when coalesce(window_end - lag(window_end) over (partition by {ENT} order by window_end) > {fixed.FOLD_GAP_S}, true) then 1 else 0 end as s from rest),
r1 as (select *, sum(s) over (partition by {ENT} order by window_end rows unbounded preceding) as fold_id from r0),
r2 as (select *, row_number() over (partition by {ENT}, fold_id order by window_end) as place from r1),
r3 as (select *, row_number() over (partition by server, window_end // {DAY} order by window_end, source_ip, ua_hash) as turn from r2 where place = 1),
dl as (select {ENT}, window_end, event_count, fused_pct, severity_score, action, 'suppressed' as disposition from fired where action = 'suppress' union all select {ENT}, window_end, event_count, fused_pct, severity_score, action, 'folded' from r2 where place > 1
union all select {ENT}, window_end, event_count, fused_pct, severity_score, action, case when turn <= 3 then 'delivered' else 'digested' end from r3)"""


def delivered(spark, d):
    return D.delivery(judged(spark, d).where(F.col("fused_pct") >= FIRE), "fused_pct", 3)


@query(f"{DELIVERY_SQL} select {ENT}, window_end, disposition from dl")
def delivery(spark, d):
    return delivered(spark, d).select("server", "source_ip", "ua_hash", "window_end", "disposition")


LOG_SQL = f"{DELIVERY_SQL}, lg as (select 'web_recon' as usecase, sw.server as server, sw.source_ip as source_ip, sw.ua_hash as ua_hash, sw.window_start, sw.window_end, sw.event_count, sw.fused_pct, sw.fused_pct >= {FIRE} as fired, coalesce(dl.disposition, 'scored') as disposition, dl.severity_score as severity_score from sw left join dl using ({ENT}, window_end))"


def log(spark, d):
    rows = judged(spark, d).withColumn("fired", F.col("fused_pct") >= FIRE)
    return detection.dispositions(rows.drop("severity_score", "severity"), delivered(spark, d), "web_recon")


@query(f"{LOG_SQL} select usecase, {ENT}, window_end, event_count, fused_pct, fired, disposition, severity_score from lg")
def disposition_log(spark, d):
    return log(spark, d).select("usecase", "server", "source_ip", "ua_hash", "window_end", "event_count", "fused_pct", "fired", "disposition", "severity_score")


@query(f"{LOG_SQL} select usecase, window_end // {DAY} as day, count(*) as windows, count_if(fired)::bigint as fired, " + ", ".join(f"count_if(disposition = '{x}')::bigint as {x}" for x in ("delivered", "suppressed", "folded", "digested")) + ", round(100.0 * count_if(fired) / count(*), 4) as fire_rate_pct from lg group by all")
def overview(spark, d):
    return detection.overview(log(spark, d))


@query(f"{LOG_SQL} select {ENT}, window_end, fused_pct, disposition from lg order by window_end desc, {ENT} limit 25")
def records_tail(spark, d):
    return detection.tail(log(spark, d), 25).select("server", "source_ip", "ua_hash", "window_end", "fused_pct", "disposition")


@query(f"{DELIVERY_SQL} select disposition, action, count(*) as n, min(severity_score) as least, max(severity_score) as greatest from dl group by all")
def suppression_audit(spark, d):
    """What suppression changed: numbers by disposition and action, and the severities left."""
    return delivered(spark, d).groupBy("disposition", "action").agg(F.count("*").alias("n"), F.min("severity_score").alias("least"), F.max("severity_score").alias("greatest"))


@query(f"{DELIVERY_SQL} select {ENT}, window_end, fused_pct from dl where disposition = 'delivered' order by fused_pct desc, window_end, {ENT} limit 10")
def top_alerts(spark, d):
    return delivered(spark, d).where("disposition = 'delivered'").orderBy(F.desc("fused_pct"), "window_end", "server", "source_ip", "ua_hash").limit(10).select("server", "source_ip", "ua_hash", "window_end", "fused_pct")


@query(" select server, source_ip, ua_hash, window_start, 'Web reconnaissance. Within 1440 minutes ' || source_ip || ' sent ' || server || ' ' || event_count || ' requests to ' || distinct_paths || ' paths; ' || n404 || ' got a 404.' as narrative from sw")
def narrative(spark, d):
    return scored(spark, d).select(*IDS, D.narrative(F.lit("Web reconnaissance"), 1440).alias("narrative"))


@query(f', sm as (select server as usecase, window_start as "at", sum(sum(event_count)) over (partition by server order by window_start) as events, sum(count_if(fused_pct >= {FIRE})) over (partition by server order by window_start) as fires from sw group by server, window_start) select usecase, "at", round((events - lag(events) over (partition by usecase order by "at")) / nullif("at" - lag("at") over (partition by usecase order by "at"), 0), 6) as rate, (fires - lag(fires) over (partition by usecase order by "at"))::bigint as new_fires from sm')
def rate_series(spark, d):
    from pyspark.sql import Window

    o = Window.partitionBy("usecase").orderBy("at")
    each = scored(spark, d).groupBy(F.col("server").alias("usecase"), F.col("window_start").alias("at")).agg(F.sum("event_count").alias("e"), F.count_if(F.col("fused_pct") >= FIRE).alias("f"))
    samples = each.select("usecase", "at", F.sum("e").over(o).alias("events"), F.sum("f").over(o).alias("fires"))
    return detection.rates(samples).select("usecase", "at", F.round("rate", 6).alias("rate"), "new_fires")


@query(", c as (select count(*) as n from sw) select count(*) as kept, max(fused_pct) as most from (select *, row_number() over (order by fused_pct desc) as place from sw), c where n <= 100 or place > greatest(1, floor(0.001 * n))")
def hygiene_drop(spark, d):
    return scoring.without_most_anomalous(scored(spark, d), "fused_pct").agg(F.count("*").alias("kept"), F.max("fused_pct").alias("most"))


@query(f", o as (select {ENT}, window_start, row_number() over (order by window_start, {ENT}) - 1 as i, count(*) over () as n from sw) select {ENT}, window_start from o where i % greatest(1, n // 200) = 0 and i // greatest(1, n // 200) < 200")
def reference_sample(spark, d):
    order = ["window_start", "server", "source_ip", "ua_hash"]
    return scoring.reference_sample(scored(spark, d).select(*order), order, 200).select("server", "source_ip", "ua_hash", "window_start")


@query(f" select {ENT}, window_end, round(1 - fused_pct, 4) as human_likeness, declared_bot as is_known from sw")
def crawler_export(spark, d):
    rows = scored(spark, d).withColumns({"verified_crawler": F.lit(False), "bot_robots_txt_fetched": F.lit(0.0), "family_robots_txt": F.lit(False)})
    return D.crawler_export(rows, "fused_pct").select("server", "source_ip", "ua_hash", "window_end", "human_likeness", "is_known")


@query(f", fi as (select *, case when low_k % 2 = 0 then 'a' else 'b' end as usecase from sw where fused_pct >= {FIRE}) select {ENT}, window_end, (select count(distinct y.usecase) from fi y where y.server = x.server and y.source_ip = x.source_ip and y.ua_hash = x.ua_hash and y.window_end between x.window_end - {3 * DAY} and x.window_end)::int as usecases from fi x")
def corroboration(spark, d):
    rows = scored(spark, d).where(F.col("fused_pct") >= FIRE).withColumn("usecase", F.when(F.col("low_k") % 2 == 0, "a").otherwise("b"))
    return D.corroborated(rows, 3 * DAY).select("server", "source_ip", "ua_hash", "window_end", "usecases")


@query(f" select window_start, count(*) as clients, count_if(fused_pct >= {FIRE}) / count(*) as share from sw group by 1")
def fleet_share(spark, d):
    return D.fleet_share(scored(spark, d).withColumn("fired", F.col("fused_pct") >= FIRE), "fired")


@query(
    f" select {ENT}, window_start, window_end, event_count, round(fused_pct, 5) as fused, fused_pct >= {FIRE} as fired, 'low_k=' || round(low_k::double, 5)::varchar as raw, 'low_k=' || round(fused_pct, 5)::varchar as percentiles,"
    f" 'fused ' || round(fused_pct, 5)::varchar || case when fused_pct >= {FIRE} then ' at or above ' else ' below ' end || '{FIRE}' as reason from sw"
)
def score_record(spark, d):
    """The audit row, its maps as text for comparison."""
    rows = D.score_records(scored(spark, d).withColumn("low_pct", F.col("fused_pct")), {"low_k": ("low_k", "low_pct")}, FIRE, [])
    text = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return rows.select(*IDS, "window_end", "event_count", "fused", "fired", text("raw").alias("raw"), text("percentiles").alias("percentiles"), F.array_join("reasons", "; ").alias("reason"))
