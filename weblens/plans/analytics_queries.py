"""Queries of change and behaviour over the request view, with their SQL."""

from pyspark.sql import functions as F

from weblens.operators import behaviour, change, seasons
from weblens.plans.scalar_queries import requests
from weblens.sources import web_view

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: The second from which rows are the current side.
SPLIT = 1705363200


def query(sql: str):
    def add(run):
        QUERIES[run.__name__] = run
        SQL[run.__name__] = f"with {web_view.SQL}{sql}"
        return run

    return add


def side():
    return (F.col("epoch") >= SPLIT).cast("int").alias("side")


@query(f""", c as (select server as feature, body_bytes as value, count_if(epoch < {SPLIT}) as a, count_if(epoch >= {SPLIT}) as b from req where body_bytes is not null group by all),
r as (select feature, sum(a) over w / nullif(sum(a) over f, 0) as fa, sum(b) over w / nullif(sum(b) over f, 0) as fb, sum(a) over f as na, sum(b) over f as nb from c window w as (partition by feature order by value), f as (partition by feature))
select feature, round(max(abs(fa - fb)), 9) as ks, max(na)::bigint as n_reference, max(nb)::bigint as n_current from r group by 1""")
def ks_sizes(spark, d):
    rows = requests(spark, d).select(F.col("server").alias("feature"), F.col("body_bytes").alias("value"), side())
    return change.kolmogorov_smirnov(rows).withColumn("ks", F.round("ks", 9))


@query(f""", c as (select server as feature, url_path, count_if(epoch < {SPLIT}) as a, count_if(epoch >= {SPLIT}) as b from req group by all),
p as (select feature, a / nullif(sum(a) over (partition by feature), 0) as p, b / nullif(sum(b) over (partition by feature), 0) as q from c)
select feature, round(sum(case when p > 0 then 0.5 * p * log2(p / ((p + q) / 2)) else 0 end + case when q > 0 then 0.5 * q * log2(q / ((p + q) / 2)) else 0 end), 9) as js from p group by 1""")
def js_paths(spark, d):
    rows = requests(spark, d).select(F.col("server").alias("feature"), F.col("url_path").alias("item"), side())
    return change.jensen_shannon(rows).withColumn("js", F.round("js", 9))


@query(""", s as (select server, avg(body_bytes) as m, stddev_pop(body_bytes) + 1e-9 as s from req group by 1),
o as (select server, event_id, body_bytes::double as x, (body_bytes - m) / s - 0.5 as z, row_number() over (partition by server order by us, event_id) as i from req join s using (server)),
l as (select server, list(x order by i) as xs, list(z order by i) as zs, list(event_id order by i) as ids from o group by 1),
w(server, i, e, c) as (select server, 1, xs[1], greatest(0.0, zs[1]) from l union all select w.server, w.i + 1, 0.3 * xs[w.i + 1] + 0.7 * w.e, greatest(0.0, w.c + zs[w.i + 1]) from w join l on l.server = w.server where w.i < len(xs))
select l.server as series, ids[i] as event_id, round(e, 6) as ewma, round(c, 6) as cusum from w join l using (server)""")
def smoothed_sizes(spark, d):
    rows = requests(spark, d)
    stats = rows.groupBy("server").agg(F.avg("body_bytes").alias("m"), (F.stddev_pop("body_bytes") + 1e-9).alias("s"))
    z = (F.col("body_bytes") - F.col("m")) / F.col("s") - 0.5
    series = rows.join(stats, "server").select(F.col("server").alias("series"), "us", "event_id", F.col("body_bytes").cast("double").alias("x"), z.alias("z"))
    return change.smoothed(series, ["us", "event_id"]).select("series", "event_id", F.round("ewma", 6).alias("ewma"), F.round("cusum", 6).alias("cusum"))


SQL["smoothed_sizes"] = SQL["smoothed_sizes"].replace("with ", "with recursive ", 1)


@query(""", h as (select server, epoch // 3600 as hour, sum(body_bytes)::double as actual from req group by all),
q as (select server, hour % 168 as how, quantile_cont(actual, [0.25, 0.5, 0.75, 0.95, 0.995]) as q from h group by all)
select h.server, hour, round(actual, 6) as actual, round(q[2], 6) as p50, round(q[4], 6) as p95, round(q[5], 6) as p995, round((actual - q[5]) / nullif(q[3] - q[1], 0), 3) as breach from h join q on h.server = q.server and hour % 168 = how""")
def egress_breach(spark, d):
    rows = requests(spark, d).select("server", "epoch", F.col("body_bytes").alias("size"))
    got = change.seasonal_breach(rows)
    return got.select("server", "hour", *[F.round(c, 6).alias(c) for c in ("actual", "p50", "p95", "p995")], F.round("breach", 3).alias("breach"))


@query(""" select event_id, sum(body_bytes) over (partition by server, source_ip order by epoch range between 900 preceding and current row)::bigint as sent_15m,
sum(body_bytes) over (partition by server, source_ip order by epoch range between 3600 preceding and current row)::bigint as sent_1h, sum(body_bytes) over (partition by server, source_ip order by epoch range between 86400 preceding and current row)::bigint as sent_24h from req""")
def egress_frames(spark, d):
    sent = {f"sent_{n}": change.sent_within(behaviour.CLIENT, s, "body_bytes") for n, s in (("15m", 900), ("1h", 3600), ("24h", 86400))}
    return requests(spark, d).select("event_id", *[c.alias(n) for n, c in sent.items()])


@query(""", y as (select server, source_ip, us, event_id, case when status_code between 200 and 299 then '2' when status_code between 300 and 399 then '3' when status_code in (401, 403) then 'a' when status_code between 400 and 499 then 'n' when status_code between 500 and 599 then '5' end as b from req),
t as (select server, source_ip, b, lag(b) over (partition by server, source_ip order by us, event_id) as a from y where b is not null),
k as (select server, a, b, count(*) as k from t where a is not null group by all), p as (select *, (k + 1) / (sum(k) over (partition by server, a) + 5) as p from k)
select t.server, source_ip, count(*) as steps, round(avg(ln(p)), 6) as loglik from t join p using (server, a, b) group by all""")
def status_sequences(spark, d):
    got = behaviour.sequence_likelihood(requests(spark, d))
    return got.select(*behaviour.CLIENT, "steps", F.round("loglik", 6).alias("loglik"))


@query(""", u as (select user_agent, count(*) as requests from req where user_agent is not null group by 1),
g as (select user_agent, requests, substr(chr(2) || chr(2) || user_agent || chr(3), i, 3) as g from (select *, unnest(range(1, len(user_agent) + 2)) as i from u)),
n as (select g, sum(requests) as n from g group by 1), m as (select g[1:2] as c, sum(n) as m from n group by 1), v as (select count(distinct g[3]) as v from n)
select user_agent, max(requests)::bigint as requests, round(exp(-avg(ln((n + 1) / (m + v)))), 6) as perplexity from g join n using (g) join m on m.c = g.g[1:2], v group by 1""")
def agent_perplexity(spark, d):
    got = behaviour.agent_perplexity(requests(spark, d))
    return got.withColumn("perplexity", F.round("perplexity", 6))


@query(""", a as (select server, source_ip, us, event_id, us - lag(us) over w as gap from req window w as (partition by server, source_ip order by us, event_id)),
b as (select server, source_ip, gap as g3, lag(gap, 1) over w as g2, lag(gap, 2) over w as g1 from a where gap is not null window w as (partition by server, source_ip order by us, event_id)),
c as (select server, source_ip, count(*) as n from b where g1 is not null group by server, source_ip, g1 <= g2, g1 <= g3, g2 <= g3)
select server, source_ip, sum(n)::bigint as patterns, round(greatest(0.0, (log2(sum(n)) - sum(n * log2(n)) / sum(n)) / log2(6)), 6) as permutation_entropy from c group by all""")
def pause_patterns(spark, d):
    got = behaviour.rhythm(requests(spark, d))
    return got.withColumn("permutation_entropy", F.round("permutation_entropy", 6))


@query(""", h as (select server, source_ip, url_path, count(*) as x from req where url_path is not null group by all),
r as (select *, row_number() over (partition by server, source_ip order by x, url_path) as i from h)
select server, source_ip, count(*) as paths, round(2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*), 6) as gini from r group by all""")
def path_concentration(spark, d):
    got = behaviour.concentration(requests(spark, d))
    return got.withColumn("gini", F.round("gini", 6))


@query(""", s as (select server || '|' || source_ip as client, list(distinct url_path) as s from req where url_path is not null group by 1 having count(distinct url_path) >= 3),
links as (select x.client as a, y.client as b from s x join s y on x.client <> y.client where 5 * len(list_intersect(x.s, y.s)) >= 4 * (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)))),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a)
select s.client, max(len(s.s))::bigint as paths, (select count(*) from links where links.a = s.client) as links, least(s.client, coalesce(min(r.b), s.client)) as campaign from s left join reach r on r.a = s.client group by s.client""")
def campaigns(spark, d):
    return behaviour.campaigns(requests(spark, d))


SQL["campaigns"] = SQL["campaigns"].replace("with ", "with recursive ", 1)


def adaptive_errors(spark, d):
    """The share of failed requests by server and hour, as a mean that follows changes; no SQL."""
    hours = requests(spark, d).groupBy(F.col("server").alias("series"), F.floor(F.col("epoch") / 3600).alias("at"))
    return change.adaptive_means(hours.agg((F.count_if(F.col("status_code") >= 400) / F.count("*")).alias("value"))).select("series", "at", F.round("value", 6).alias("value"), "width", F.round("mean", 6).alias("mean"), "changed")


QUERIES["adaptive_errors"] = adaptive_errors


def hourly_counts(spark, d):
    rows = requests(spark, d).groupBy(F.col("server").alias("series"), F.floor(F.col("epoch") / 3600).alias("at"))
    return rows.agg(F.count("*").alias("value"))


def seasonal_traffic(spark, d):
    """Requests by server and hour as trend, day, week and rest; an hour without requests is 0. No SQL."""
    got = seasons.seasonal_parts(hourly_counts(spark, d), (24, 168), fill=0.0)
    return got.select("series", "at", "value", *[F.round(c, 6).alias(c) for c in ("trend", "seasonal_24", "seasonal_168", "remainder")])


def traffic_regimes(spark, d):
    """Stretches of one level of requests by server and hour, once the day's course is taken out. No SQL."""
    got = seasons.regimes(hourly_counts(spark, d), (24,), fill=0.0)
    return got.select("series", "regime", "start", "end", "steps", F.round("mean", 6).alias("mean"), F.round("change", 6).alias("change"))


QUERIES |= {q.__name__: q for q in (seasonal_traffic, traffic_regimes)}
