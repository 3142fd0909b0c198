"""Queries of window features and sessions, with their SQL. Windows last a day: the test events are sparse."""

from pyspark.sql import functions as F

from weblens.functions import expressions as X
from weblens.functions import fixed
from weblens.operators import features as W
from weblens.operators import profile as P
from weblens.operators import sessions as S
from weblens.operators.groups import FeatureGroup, grouped_features
from weblens.plans.scalar_queries import BOT_SQL, EXT_SQL, FAMILY_SQL, IDF_SQL, NUMBER_SQL, PROFILE_SQL, SCAN_SQL, ranges_sql, requests  # noqa: F401
from weblens.sources import web_view

QUERIES: dict = {}
SQL: dict[str, str] = {}
DAY = 86400
KEY = "server, source_ip, ua_hash, bucket"
IDS = ["server", "source_ip", "ua_hash", "window_start"]
WIN_IDS = f"server, source_ip, ua_hash, bucket * {DAY} as window_start"


def query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = f"with {web_view.SQL}, kd as (select *, epoch // {DAY} as bucket from req){sql}"
        return run

    return add


def vectors(spark, d):
    r = requests(spark, d)
    return W.window_features(r, P.learn(r), DAY)


def rounded(df, *columns):
    return df.select(*IDS, *[F.round(c, 6).alias(c) for c in columns])


def simple(name: str, columns: dict[str, str], joins: str = "kd"):
    """A query of some columns of the windows and the SQL aggregates they must equal."""

    def run(spark, d):
        return rounded(vectors(spark, d), *columns)

    run.__name__ = name
    query(f" select {WIN_IDS}, {', '.join(f'round({e}, 6) as {c}' for c, e in columns.items())} from {joins} group by {KEY}")(run)


simple("win_status", {"web_ratio_404": "count_if(status_code = 404) / count(*)"} | {f"web_status_{i}xx_ratio": f"count_if(status_code between {i}00 and {i}99) / count(*)" for i in (2, 3, 4, 5)})
simple("win_uniq_paths", {"web_uniq_paths_per_min": f"least(count(distinct url_path), {fixed.MAX_PATHS}) / ({DAY} / 60.0)"})
simple("win_referrer", {"web_referrer_absent_ratio": "count_if(referrer is null) / count(*)"})
simple("win_asset", {"bot_asset_fetch_ratio": f"count_if(coalesce({EXT_SQL.format('url_path')} in {fixed.ASSET_EXTENSIONS}, false)) / count(*)"})
simple("win_repeat", {"bot_path_repeat_ratio": "(count(*) - count(distinct url_path)) / count(*)"})
simple("win_method", {"bot_method_get_ratio": "coalesce(count_if(http_method = 'GET') / nullif(count(http_method), 0), 0.0)"})
simple("win_bytes_p50", {"bot_bytes_per_req_p50": "coalesce(quantile_cont(body_bytes, 0.5), 0.0)"})
simple("win_declared", {"bot_declared_bot": f"case when {BOT_SQL.format('max(user_agent)')} then 1.0::double else 0.0::double end"})

GAP_SQL = f", g as (select *, (us - lag(us) over (partition by {KEY} order by us, event_id)) / 1e6 as gap from kd)"
CV_SQL = "case when count(gap) >= 2 and avg(gap) > 0 then stddev_pop(gap) / avg(gap) else 0.0 end"


@query(f"{GAP_SQL} select event_id, gap from g")
def gaps(spark, d):
    return W.gaps(W.keyed(requests(spark, d), DAY)).select("event_id", "gap")


@query(f"{GAP_SQL} select {WIN_IDS}, round({CV_SQL}, 6) as timing_interarrival_cv from g group by {KEY}")
def win_cv(spark, d):
    return rounded(vectors(spark, d), "timing_interarrival_cv")


@query(f"{PROFILE_SQL} select r.server as server, source_ip, ua_hash, bucket * {DAY} as window_start, round(sum({IDF_SQL.format('p.df')}) / count(*), 6) as web_mean_path_idf from kd r left join path_totals t using (server) left join paths p on p.server = r.server and p.url_path = r.url_path group by r.server, source_ip, ua_hash, bucket")
def win_idf(spark, d):
    return rounded(vectors(spark, d), "web_mean_path_idf")


TOKEN_SQL = f""", tk as (select {KEY}, t.token, count(*) as c from kd, unnest(list_filter(string_split(url_path, '/'), lambda x: x <> '')) t(token) group by all),
te as (select {KEY}, sum(c)::double as total, count(*) as kinds, sum(c * log2(c)) as weighted from tk group by all)"""


@query(f"{TOKEN_SQL} select {WIN_IDS}, round(case when total > 1 and kinds > 1 then (log2(total) - weighted / total) / log2(kinds) else 0.0 end, 6) as web_path_token_entropy from te")
def win_token_entropy(spark, d):
    return rounded(vectors(spark, d), "web_path_token_entropy")


@query(f"{PROFILE_SQL} select {WIN_IDS}, count_if({EXT_SQL.format('url_path')} is not null and not exists (select 1 from exts e where e.server = kd.server and e.ext = {EXT_SQL.format('kd.url_path')} and hits >= 3)) / count(*) as web_unknown_ext_ratio from kd group by {KEY}")
def win_unknown_ext(spark, d):
    return vectors(spark, d).select(*IDS, "web_unknown_ext_ratio")


@query(f"{PROFILE_SQL}, w as (select {KEY}, max(user_agent) as user_agent from kd group by {KEY}) select {WIN_IDS}, length(coalesce(user_agent, ''))::double as ua_len, round(case when user_agent is null then 1.0 else {IDF_SQL.format('u.freq')} end, 6) as ua_rarity from w left join ua_totals t using (server) left join uas u using (server, user_agent)")
def win_ua(spark, d):
    return vectors(spark, d).select(*IDS, "ua_len", F.round("ua_rarity", 6).alias("ua_rarity"))


@query(f", b as (select {KEY}, (epoch - bucket * {DAY}) // 30 as bin, count(*) as c from kd group by all), m as (select {KEY}, sum(c) / {DAY // 30}.0 as mean, sum(c * c) / {DAY // 30}.0 as sq from b group by all) select {WIN_IDS}, round((sq - mean * mean) / mean, 6) as timing_fano_factor from m")
def win_fano(spark, d):
    return rounded(vectors(spark, d), "timing_fano_factor")


HOURS = range(24)
SEEN = ", ".join(f"sum(h{h}) over o as s{h}" for h in HOURS)
TOTAL = " + ".join(f"s{h}" for h in HOURS)
HOUR_SQL = f""", hw as (select {KEY}, max(url_path = '/robots.txt') as robots, {", ".join(f"count_if(hour(ts) = {h}) as h{h}" for h in HOURS)} from kd group by {KEY}),
hs as (select {KEY}, max(robots) over o as ever, {SEEN} from hw window o as (partition by server, source_ip, ua_hash order by bucket)),
he as (select *, ({TOTAL})::double as total, {" + ".join(f"(s{h} > 0)::int" for h in HOURS)} as kinds, {" + ".join(f"case when s{h} > 0 then s{h} * log2(s{h}) else 0 end" for h in HOURS)} as weighted from hs)"""


@query(f"{HOUR_SQL} select {WIN_IDS}, round(case when total > 1 and kinds > 1 then (log2(total) - weighted / total) / log2(24) else 0.0 end, 6) as bot_activity_hour_entropy from he")
def win_hour_entropy(spark, d):
    return rounded(vectors(spark, d), "bot_activity_hour_entropy")


@query(f"{HOUR_SQL} select {WIN_IDS}, ever::int::double as bot_robots_txt_fetched from he")
def win_robots(spark, d):
    return vectors(spark, d).select(*IDS, "bot_robots_txt_fetched")


@query()
def win_ref_chain(spark, d):
    return vectors(spark, d).select(*IDS, "bot_referrer_chain_depth")


VERIFIED_SQL = f"exists (select 1 from rg where rg.family = {{1}} and {NUMBER_SQL.format('{0}')} between lo and hi)"
ROBOTS_SQL = f""", rg(family, lo, hi) as (values {ranges_sql()}),
fr as (select server, {FAMILY_SQL.format('user_agent')} as family, min(epoch) as since from kd where url_path = '/robots.txt' and {VERIFIED_SQL.format('source_ip', FAMILY_SQL.format('user_agent'))} group by all)"""
EVIDENCE_SQL = f"""{ROBOTS_SQL}, w as (select {KEY}, count(*) as event_count, count(distinct url_path) as distinct_paths, count_if(status_code = 404)::bigint as n404, max(user_agent) as user_agent,
(list(original order by us desc, event_id desc))[1] as last_line from kd group by {KEY})"""


@query(f"{EVIDENCE_SQL} select {WIN_IDS}, (bucket + 1) * {DAY} as window_end, event_count, distinct_paths, n404, {BOT_SQL.format('user_agent')} as declared_bot, {FAMILY_SQL.format('user_agent')} as crawler_family, {VERIFIED_SQL.format('source_ip', FAMILY_SQL.format('user_agent'))} as verified_crawler, last_line from w")
def win_evidence(spark, d):
    return vectors(spark, d).select(*IDS, "window_end", "event_count", "distinct_paths", "n404", "declared_bot", "crawler_family", "verified_crawler", F.try_element_at("raw_lines", F.lit(-1)).alias("last_line"))


@query(f"{ROBOTS_SQL}, w as (select {KEY}, max(user_agent) as user_agent from kd group by {KEY}) select {WIN_IDS}, exists (select 1 from fr where fr.server = w.server and fr.family = {FAMILY_SQL.format('w.user_agent')} and fr.since < (w.bucket + 1) * {DAY}) as family_robots_txt from w")
def family_robots(spark, d):
    return vectors(spark, d).select(*IDS, "family_robots_txt")


FLAGSHIP = ("web_ratio_404", "web_status_5xx_ratio", "web_uniq_paths_per_min", "web_referrer_absent_ratio", "bot_asset_fetch_ratio", "bot_path_repeat_ratio", "bot_method_get_ratio", "bot_bytes_per_req_p50", "bot_declared_bot", "web_path_token_entropy", "timing_fano_factor", "timing_interarrival_cv", "bot_activity_hour_entropy", "bot_robots_txt_fetched")


@query(
    f"{GAP_SQL}{TOKEN_SQL}{HOUR_SQL}, b as (select {KEY}, (epoch - bucket * {DAY}) // 30 as bin, count(*) as c from kd group by all), fm as (select {KEY}, sum(c) / {DAY // 30}.0 as mean, sum(c * c) / {DAY // 30}.0 as sq from b group by all), "
    f"a as (select {KEY}, count_if(status_code = 404) / count(*) as web_ratio_404, count_if(status_code >= 500) / count(*) as web_status_5xx_ratio, count(distinct url_path) / ({DAY} / 60.0) as web_uniq_paths_per_min, count_if(referrer is null) / count(*) as web_referrer_absent_ratio, "
    f"count_if(coalesce({EXT_SQL.format('url_path')} in {fixed.ASSET_EXTENSIONS}, false)) / count(*) as bot_asset_fetch_ratio, (count(*) - count(distinct url_path)) / count(*) as bot_path_repeat_ratio, count_if(http_method = 'GET') / count(http_method) as bot_method_get_ratio, "
    f"coalesce(quantile_cont(body_bytes, 0.5), 0.0) as bot_bytes_per_req_p50, case when {BOT_SQL.format('max(user_agent)')} then 1.0::double else 0.0::double end as bot_declared_bot, {CV_SQL} as timing_interarrival_cv from g group by {KEY}) "
    f"select {WIN_IDS}, round(web_ratio_404, 6) as web_ratio_404, round(web_status_5xx_ratio, 6) as web_status_5xx_ratio, round(web_uniq_paths_per_min, 6) as web_uniq_paths_per_min, round(web_referrer_absent_ratio, 6) as web_referrer_absent_ratio, round(bot_asset_fetch_ratio, 6) as bot_asset_fetch_ratio, "
    f"round(bot_path_repeat_ratio, 6) as bot_path_repeat_ratio, round(bot_method_get_ratio, 6) as bot_method_get_ratio, round(bot_bytes_per_req_p50, 6) as bot_bytes_per_req_p50, bot_declared_bot, round(case when te.total > 1 and te.kinds > 1 then (log2(te.total) - te.weighted / te.total) / log2(te.kinds) else 0.0 end, 6) as web_path_token_entropy, "
    f"round((sq - mean * mean) / mean, 6) as timing_fano_factor, round(timing_interarrival_cv, 6) as timing_interarrival_cv, round(case when he.total > 1 and he.kinds > 1 then (log2(he.total) - he.weighted / he.total) / log2(24) else 0.0 end, 6) as bot_activity_hour_entropy, ever::int::double as bot_robots_txt_fetched "
    f"from a join te using ({KEY}) join he using ({KEY}) join fm using ({KEY})"
)
def feature_vector(spark, d):
    return rounded(vectors(spark, d), *FLAGSHIP)


@query(f" select count(*) as n from (select {KEY} from kd group by {KEY})")
def complete_vectors(spark, d):
    return W.complete(vectors(spark, d), fixed.BOT_FEATURES).agg(F.count("*").alias("n"))


@query(" select server, cast(epoch(w) as bigint) as window_start, count(*) as n from (select server, unnest([time_bucket(interval '12 hours', ts, timestamp '1970-01-01'), time_bucket(interval '12 hours', ts, timestamp '1970-01-01') - interval '12 hours']) as w from req) group by 1, 2")
def win_sliding(spark, d):
    return W.sliding(requests(spark, d))


@query(f" select server, bucket * {DAY} as window_start, count(*) as n, count(distinct source_ip) as clients from kd group by server, bucket")
def server_windows(spark, d):
    return W.server_windows(requests(spark, d), DAY)


@query(f""" , wt as (select {KEY}, count(*) as n, count(distinct url_path) as p, count_if(status_code = 404) / count(*) as ratio from kd group by {KEY})
select {WIN_IDS}, n as event_count, ratio as web_ratio_404 from wt where n >= 5 and p >= 3 order by ratio desc, window_start, server, source_ip, ua_hash limit 10""")
def top_windows(spark, d):
    rows = vectors(spark, d).where((F.col("event_count") >= fixed.RECON_EVENTS) & (F.col("distinct_paths") >= fixed.RECON_PATHS))
    return rows.orderBy(F.desc("web_ratio_404"), "window_start", "server", "source_ip", "ua_hash").limit(10).select(*IDS, "event_count", "web_ratio_404")


# Sessions

SESSION_SQL = """, s0 as (select *, us - lag(us) over e as pause from kd window e as (partition by server, source_ip, ua_hash order by us, event_id)),
s1 as (select *, sum(case when pause is null or pause > 1800000000 then 1 else 0 end) over (partition by server, source_ip, ua_hash order by us, event_id rows unbounded preceding)::bigint as session_id,
case when pause <= 1800000000 then pause / 1e6 end as gap from s0)"""
SKEY = "server, source_ip, ua_hash, session_id"


@query(f"{SESSION_SQL} select event_id, session_id from s1")
def sessionize(spark, d):
    return S.sessionized(requests(spark, d)).select("event_id", "session_id")


@query(f"{SESSION_SQL} select event_id, gap from s1")
def session_gaps(spark, d):
    return S.sessionized(requests(spark, d)).select("event_id", "gap")


def share(cond: str, of: str) -> str:
    return f"coalesce(count_if({cond}) / nullif(count({of}), 0), 0.0)"


SESSION_COLUMNS = {
    "duration_s": "(max(us) - min(us)) / 1e6", "event_count": "count(*)::double", "unique_paths": "count(distinct url_path)::double",
    "paths_per_minute": "case when max(us) > min(us) then count(*) / ((max(us) - min(us)) / 1e6 / 60.0) else 0.0 end", "bytes_total": "coalesce(sum(body_bytes), 0)::double",
    "bytes_per_request": "coalesce(sum(body_bytes), 0) / count(*)", "mean_inter_arrival": "coalesce(avg(gap), 0.0)", "cv_inter_arrival": CV_SQL, "referrer_present_ratio": "count(referrer) / count(*)",
    "path_depth_mean": "avg(length(url_path) - length(replace(url_path, '/', '')))", "repeat_path_ratio": "1.0 - count(distinct url_path) / count(*)",
    "status_2xx_ratio": share("status_code between 200 and 299", "status_code"), "status_3xx_ratio": share("status_code between 300 and 399", "status_code"), "status_4xx_auth_ratio": share("status_code in (401, 403)", "status_code"),
    "status_4xx_notfound_ratio": share("status_code = 404", "status_code"), "status_4xx_other_ratio": share("status_code between 400 and 499 and status_code not in (401, 403, 404)", "status_code"), "status_5xx_ratio": share("status_code >= 500", "status_code"),
    "method_get_ratio": share("http_method = 'GET'", "http_method"), "method_post_ratio": share("http_method = 'POST'", "http_method"), "method_head_ratio": share("http_method = 'HEAD'", "http_method"), "method_other_ratio": share("http_method not in ('GET', 'POST', 'HEAD')", "http_method"),
}


@query(f"{SESSION_SQL} select {SKEY}, {', '.join(f'round({e}, 6) as {c}' for c, e in SESSION_COLUMNS.items())} from s1 group by {SKEY}")
def session_features(spark, d):
    return S.session_features(S.sessionized(requests(spark, d))).select("server", "source_ip", "ua_hash", "session_id", *[F.round(c, 6).alias(c) for c in SESSION_COLUMNS])


@query(f"{SESSION_SQL} select {SKEY}, (list(url_path order by us, event_id))[1] as entry_path, (list(url_path order by us desc, event_id desc))[1] as exit_path from s1 group by {SKEY}")
def session_entry_exit(spark, d):
    return S.session_features(S.sessionized(requests(spark, d))).select("server", "source_ip", "ua_hash", "session_id", "entry_path", "exit_path")


REPORT = ", ".join(f"median({c}) as {c}_p50, quantile_disc({c}, 0.95) as {c}_p95, max({c}) as {c}_max" for c in ("event_count", "duration_s", "unique_paths"))


@query(f"{SESSION_SQL}, sf as (select {SKEY}, {', '.join(f'{e} as {c}' for c, e in SESSION_COLUMNS.items())} from s1 group by {SKEY}) select count(*) as sessions, {REPORT}, round(quantile_disc(cv_inter_arrival, 0.05), 6) as cv_p05, count_if(event_count = 1) / count(*) as single_event_share from sf")
def session_report(spark, d):
    return S.session_report(S.session_features(S.sessionized(requests(spark, d)))).withColumn("cv_p05", F.round("cv_p05", 6))


@query(f" select {WIN_IDS}, count(*) as n, row_number() over (order by bucket, server, source_ip, ua_hash) as place from kd group by {KEY}")
def windows_by_start(spark, d):
    """Windows in the order of their start: sorted by ranges, numbered by the sizes of those before."""
    rows = W.keyed(requests(spark, d), DAY).groupBy(*W.KEY).agg(F.count("*").alias("n")).select(*IDS[:3], (F.col("bucket") * DAY).alias("window_start"), "n")
    return S.in_order(rows, ["window_start", "server", "source_ip", "ua_hash"])


class Errors(FeatureGroup):
    name = "errors"

    def aggregates(self):
        failed = F.col("status_code") >= 400
        return {"failed": F.count_if(failed), "last_failed": F.max(F.when(failed, F.col("epoch")))}


@query(f" select {WIN_IDS}, count_if(status_code >= 400)::bigint as failed, max(case when status_code >= 400 then epoch end) as last_failed from kd group by {KEY}")
def feature_group(spark, d):
    """A group of features that a deployment adds."""
    return grouped_features(requests(spark, d), [Errors()], DAY)


@query(" select event_id, greatest(0, 1735689600 - epoch) as age_s from req")
def record_age(spark, d):
    return requests(spark, d).select("event_id", X.age_s(F.col("ts"), F.timestamp_seconds(F.lit(1735689600))).alias("age_s"))
