"""Queries of scans, scalar functions, profiles and counts, with their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblens.functions import expressions as X
from weblens.functions import fixed
from weblens.operators import profile as P
from weblens.operators.features import keyed
from weblens.sources import canaries, ndjson, web_view
from weblens.sources.web_view import web_events

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, web: bool = True):
    """Register a query with its SQL; ``web`` puts the record view before it."""

    def add(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = f"with {web_view.SQL}{sql}" if web else sql
        return run

    return add


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web_events(spark, sf_dir).where(X.is_request(F.col("event_type_ecs")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal_rows(spark: SparkSession, rows: list[str]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, rows))).alias("value"))


def values(rows: list[str]) -> str:
    return ", ".join("('" + r.replace("'", "''") + "')" for r in rows)


# Scans and sources


@query(" select event_id, us, server, source_ip, user_agent, url_path, status_code, http_method, referrer, body_bytes, geo_country, event_type_ecs from web")
def scan_events(spark, d):
    return web_events(spark, d).select("event_id", "us", "server", "source_ip", "user_agent", "url_path", "status_code", "http_method", "referrer", "body_bytes", "geo_country", "event_type_ecs")


LINES = [
    '{"@timestamp":"2024-01-02T03:04:05Z","observer":{"server":"a"},"source":{"ip":"203.0.113.5"},"http":{"request":{"method":"GET","referrer":"-"},"response":{"status_code":200,"body":{"bytes":12}}},"url":{"path":"/x"},"event":{"type":"access"}}',
    '{"@timestamp":"2024-01-02T08:34:05.250000+05:30","observer":{"server":"a"},"http":{"response":{"status_code":"404"}},"url":{"path":"/old/a.sql"}}',
    '{"@timestamp":"2024-01-02T03:04:05Z","event":{"type":"error"}}',
    '{"@timestamp":"garbage","url":{"path":"/y"}}',
    '{"url":{"path":"/z"}}',
    "not json at all",
    '{"@timestamp": ',
]
#: The rows of ``events`` as lines of JSON, some of them broken; WHEN writes a time in each engine's own way.
LINE = """case when event_id % 17 = 3 then concat('not json ', event_id) when event_id % 19 = 4 then '{"@timestamp": '
when event_id % 23 = 5 then concat('{"@timestamp":"garbage","url":{"path":"/y/', event_id, '"}}') when event_id % 29 = 6 then concat('{"url":{"path":"/z/', event_id, '"}}')
else concat('{"@timestamp":"', WHEN, case when event_id % 7 = 0 then '+05:30' else 'Z' end, '","observer":{"server":"srv', user_id % 3, '"},"source":{"ip":"203.0.113.', user_id % 250,
'"},"http":{"request":{"method":"GET","referrer":"', case when event_id % 5 = 0 then '-' else '/a' end, '"},"response":{"status_code":', 200 + event_id % 300, '}},"url":{"path":"/p/', event_id % 50,
'"},"event":{"type":"', case when event_type = 'error' then 'error' else 'access' end, '"}}') end"""
PARSED = f""" v(value) as (select * from (values {values(LINES)}) union all select {LINE.replace("WHEN", "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')")} from events),
j as (select value, case when json_valid(value) then value end as doc from v),
p as (select value, doc, try_cast(json_extract_string(doc, '$."@timestamp"') as timestamptz) as ts, json_extract_string(doc, '$."@timestamp"') as given, json_extract_string(doc, '$.event.type') as type from j),
r as (select *, case when doc is null then 'json' when given is null then 'missing @timestamp' when ts is null then 'bad @timestamp' end as reason from p)"""


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(reason, raw, ...): the table's lines and those of odd forms, read as a source reads them."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    lines = table(spark, sf_dir, "events").withColumn("at", stamp).select(F.expr(LINE.replace("WHEN", "at")).alias("value"))
    return ndjson.parsed(lines.union(literal_rows(spark, LINES)).withColumn("source", F.lit("events")))


def parsed(spark) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return ndjson.parsed(literal_rows(spark, LINES).withColumn("source", F.lit("fixture")))


@query(f"with {PARSED} select reason, value as raw from r where reason is not null", web=False)
def dead_letter(spark, d):
    return ndjson.dead_letters(event_lines(spark, d)).select("reason", "raw")


@query(f"with {PARSED} select count(*) as lines, count_if(reason is null)::bigint as parsed, count_if(reason is not null)::bigint as failed, count_if(reason is null and type <> 'access')::bigint as skipped, count_if(reason is not null) / count(*) as failure_rate from r", web=False)
def ingest_stats(spark, d):
    return ndjson.ingest_stats(event_lines(spark, d))


@query(f"with {PARSED} select epoch_us(ts) as us, json_extract_string(doc, '$.observer.server') as server, json_extract_string(doc, '$.source.ip') as source_ip, json_extract_string(doc, '$.url.path') as url_path, try_cast(json_extract_string(doc, '$.http.response.status_code') as int) as status_code, nullif(json_extract_string(doc, '$.http.request.referrer'), '-') as referrer from r where reason is null", web=False)
def parse_ts(spark, d):
    rows = event_lines(spark, d).where("reason is null")
    return rows.select(F.unix_micros("ts").alias("us"), "server", "source_ip", "url_path", "status_code", "referrer")


@query(f"with {PARSED} select reason, count(*) as n from r where reason is not null group by 1 order by n desc, reason limit 5", web=False)
def top_reasons(spark, d):
    return ndjson.failure_reasons(event_lines(spark, d))


@query("select event_id, try_cast(json_extract_string(props, '$.k') as int) as k from events", web=False)
def json_flatten(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int").alias("j")).select("event_id", "j.k")


@query(" select event_type_ecs, count(*) as n from req group by 1")
def request_filter(spark, d):
    return requests(spark, d).groupBy("event_type_ecs").agg(F.count("*").alias("n"))


@query(" select event_id, url_path from web order by event_id limit 100")
def limit_prefix(spark, d):
    return ndjson.first_events(web_events(spark, d), 100).select("event_id", "url_path")


START = 1704110400
SCAN_SQL = (
    f"(select {START} + i * 2 + (i * 7) % 3 as epoch, case i % 6 when 0 then '/backup/site_' || lpad(i::varchar, 3, '0') || '.sql' when 1 then '/old/config_' || lpad(i::varchar, 3, '0') || '.env'"
    " when 2 then '/wp-admin/setup_' || lpad(i::varchar, 3, '0') || '.bak' when 3 then '/admin/panel_' || lpad(i::varchar, 3, '0') || '.zip' when 4 then '/.git/objects/' || lpad(i::varchar, 3, '0')"
    " else '/test/debug_' || lpad(i::varchar, 3, '0') || '.tar' end as url_path, case when i % 10 = 0 then 403 else 404 end as status_code from range(150) t(i))"
)


#: A burst begins with the first full hour after the log, on the server with most requests.
PLACE_SQL = ", place as (select (max(epoch) // 3600 + 1) * 3600 as start, (select server from req group by 1 order by count(*) desc, server limit 1) as server from req)"


def place(spark: SparkSession, sf_dir: str) -> tuple[str, int]:
    """Where and when a canary is put among the table's requests."""
    rows = requests(spark, sf_dir)
    most = rows.groupBy("server").count().orderBy(F.desc("count"), "server").first()
    last = rows.agg(F.max("epoch")).first()[0]
    return (most.server, (last // 3600 + 1) * 3600) if most else ("_", START)


@query(f"{PLACE_SQL} select server, epoch - {START} + start as epoch, url_path, status_code from {SCAN_SQL}, place")
def canary_scan(spark, d):
    return canaries.scan_canary(spark, *place(spark, d)).select("server", "epoch", "url_path", "status_code")


@query(f"{PLACE_SQL} select server, start + i * 2 as epoch, case i % 3 when 0 then '/catalog/items' when 1 then '/api/list' else '/export/data' end as url_path, 512::bigint as body_bytes from range(1350) t(i), place")
def canary_spoof(spark, d):
    return canaries.spoof_canary(spark, *place(spark, d)).select("server", "epoch", "url_path", "body_bytes")


@query(f" select epoch, url_path, status_code, 'log' as origin from req union all select epoch, url_path, status_code, 'canary' as origin from {SCAN_SQL}")
def canary_union(spark, d):
    log = requests(spark, d).select("epoch", "url_path", "status_code", F.lit("log").alias("origin"))
    return log.unionByName(canaries.scan_canary(spark, "srv0", START).select("epoch", "url_path", "status_code", F.lit("canary").alias("origin"))).orderBy("epoch", "url_path")


@query(f"select count(*) as n from {SCAN_SQL}", web=False)
def canary_filter(spark, d):
    both = requests(spark, d).select("source_ip").union(canaries.scan_canary(spark, "srv0", START).select("source_ip"))
    return both.where(X.is_canary(F.col("source_ip"))).agg(F.count("*").alias("n"))


# Scalar functions


@query(" select event_id, substr(sha256(coalesce(user_agent, '')), 1, 16) as ua_hash from web")
def ua_hash(spark, d):
    return web_events(spark, d).select("event_id", X.ua_hash(F.col("user_agent")).alias("ua_hash"))


@query(" select event_id, server || '|' || source_ip || '|' || substr(sha256(coalesce(user_agent, '')), 1, 16) as entity from web")
def entity_key(spark, d):
    return web_events(spark, d).select("event_id", X.entity(F.col("server"), F.col("source_ip"), F.col("user_agent")).alias("entity"))


@query(" select event_id, '_/' || coalesce(geo_country, '_') || '/' || server as namespace from web")
def namespace(spark, d):
    return web_events(spark, d).select("event_id", X.namespace(F.lit(""), F.col("geo_country"), F.col("server")).alias("namespace"))


@query(" select event_id, geo_country is null as internal from web")
def internal_flag(spark, d):
    return web_events(spark, d).select("event_id", X.is_internal(F.col("source_ip"), F.col("geo_country")).alias("internal"))


@query(" select event_id, nullif(coalesce(referrer, '-'), '-') as referrer from web")
def referrer_norm(spark, d):
    return web_events(spark, d).select("event_id", F.nullif(F.coalesce("referrer", F.lit("-")), F.lit("-")).alias("referrer"))


EXT_SQL = "nullif(regexp_extract(lower(regexp_extract({0}, '^[^?#]*', 0)), '(^|/)[^/.][^/]*\\.([a-z0-9]{{1,9}})$', 2), '')"
PATHS = ["/a/b.sql", "/.git.config", "/a.b?v=1", "/a/b.tar.gz", "/x.verylongext1", "/A.JS#top", "/", "", "/a.", "/core/d.js?v=9.3.22", "/a.b-c", "/dir.d/", "a.PHP", "/.htaccess"]


@query(f"select page_id as id, {EXT_SQL.format('url')} as ext from pages union all select -1 as id, {EXT_SQL.format('v')} from (values {values(PATHS)}) t(v)", web=False)
def url_extension(spark, d):
    fixture = literal_rows(spark, PATHS).select(F.lit(-1).cast("long").alias("id"), X.extension(F.col("value")).alias("ext"))
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), X.extension(F.col("url")).alias("ext")).union(fixture)


@query(" select t.token, count(*) as n from web, unnest(list_filter(string_split(url_path, '/'), lambda x: x <> '')) t(token) group by 1")
def path_tokens(spark, d):
    return web_events(spark, d).select(F.explode(X.tokens(F.col("url_path"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query(" select event_id, length(url_path) - length(replace(url_path, '/', '')) as depth from web")
def path_depth(spark, d):
    return web_events(spark, d).select("event_id", X.depth(F.col("url_path")).cast("long").alias("depth"))


REF_SQL = "nullif(regexp_extract(case when instr({0}, '://') > 0 then case when instr(regexp_extract({0}, '^.*?://(.*)$', 1), '/') > 0 then regexp_extract(regexp_extract({0}, '^.*?://(.*)$', 1), '(/.*)$', 1) else '/' end else {0} end, '^[^?#]*', 0), '')"


@query(f" select event_id as id, {REF_SQL.format('referrer')} as ref_path from web union all select page_id as id, {REF_SQL.format('url')} as ref_path from pages")
def referrer_path(spark, d):
    return web_events(spark, d).select(F.col("event_id").alias("id"), X.referrer_path(F.col("referrer")).alias("ref_path")).union(table(spark, d, "pages").select("page_id", X.referrer_path(F.col("url"))))


AGENTS = [
    "Mozilla/5.0 (X11) Firefox/120.0", "curl/8.5.0", "Mozilla/5.0 (Linux; CUBOT X30) Chrome/99", "Mozilla/5.0 (compatible; Googlebot/2.1)", "Mozilla/5.0 AppleWebKit (bingbot/2.0)", "msnbot/2.0b",
    "Mozilla/5.0 HeadlessChrome/99", "Mozilla/5.0 netprobe/1.0", "Mozilla/5.0 robotics fan", "python-requests/2.31", "Mozilla/5.0 Slurp",
]
BOT_SQL = f"case when coalesce({{0}}, '') = '' then true when regexp_matches(lower({{0}}), '{fixed.CUBOT}') then false when not starts_with(lower({{0}}), 'mozilla/') then true when contains(lower({{0}}), 'compatible;') then true else regexp_matches(lower({{0}}), '{fixed.BOT_WORDS}') end"
FAMILY_SQL = "case when contains(lower({0}), 'googlebot') then 'googlebot' when contains(lower({0}), 'bingbot') or contains(lower({0}), 'msnbot') then 'bingbot' end"


@query(f" select user_agent, {BOT_SQL.format('user_agent')} as declared from web group by 1 union all select v, {BOT_SQL.format('v')} from (values {values(AGENTS)}) t(v)")
def declared_bot(spark, d):
    seen = web_events(spark, d).select("user_agent").distinct().union(literal_rows(spark, AGENTS))
    return seen.select("user_agent", X.declared_bot(F.col("user_agent")).alias("declared"))


@query(f" select user_agent, {FAMILY_SQL.format('user_agent')} as family from web group by 1 union all select v, {FAMILY_SQL.format('v')} from (values {values(AGENTS)}) t(v)")
def crawler_family(spark, d):
    seen = web_events(spark, d).select("user_agent").distinct().union(literal_rows(spark, AGENTS))
    return seen.select("user_agent", X.crawler_family(F.col("user_agent")).alias("family"))


def ranges_sql() -> str:
    from ipaddress import ip_network

    return ", ".join(f"('{f}', {int(n.network_address)}, {int(n.broadcast_address)})" for f, t in fixed.CRAWLER_RANGES.items() for n in map(ip_network, t.split()) if n.version == 4)


CLAIMS = [("203.0.113.5", "googlebot"), ("66.249.64.1", "googlebot"), ("20.43.120.27", "bingbot"), ("20.43.121.5", "bingbot"), ("66.249.64.1", "bingbot"), ("40.77.191.255", "bingbot")]
NUMBER_SQL = "(split_part({0}, '.', 1)::bigint * 16777216 + split_part({0}, '.', 2)::bigint * 65536 + split_part({0}, '.', 3)::bigint * 256 + split_part({0}, '.', 4)::bigint)"


@query(
    f", c as (select distinct source_ip as ip, {FAMILY_SQL.format('user_agent')} as family from web union all select * from (values {', '.join(map(str, CLAIMS))}) t(ip, family)), "
    f"r(family, lo, hi) as (values {ranges_sql()}) select ip, family, exists (select 1 from r where r.family = c.family and {NUMBER_SQL.format('ip')} between lo and hi) as verified from c"
)
def verified_crawler(spark, d):
    seen = web_events(spark, d).select(F.col("source_ip").alias("ip"), X.crawler_family(F.col("user_agent")).alias("family")).distinct()
    fixture = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).alias("ip"), F.lit(f).alias("family")) for i, f in CLAIMS])))
    return seen.union(fixture).select("ip", "family", X.in_family(F.col("ip"), F.col("family")).alias("verified"))


STATUS_SQL = "coalesce(count_if({0}) / nullif(count(status_code), 0), 0.0)"


@query(f""" select server, {STATUS_SQL.format('status_code between 200 and 299')} as s2xx, {STATUS_SQL.format('status_code between 300 and 399')} as s3xx, {STATUS_SQL.format('status_code in (401, 403)')} as s4xx_auth,
{STATUS_SQL.format('status_code = 404')} as s4xx_notfound, {STATUS_SQL.format('status_code between 400 and 499 and status_code not in (401, 403, 404)')} as s4xx_other, {STATUS_SQL.format('status_code >= 500')} as s5xx from req group by 1""")
def status_histogram(spark, d):
    s = F.col("status_code")
    classes = {"s2xx": s.between(200, 299), "s3xx": s.between(300, 399), "s4xx_auth": s.isin(401, 403), "s4xx_notfound": s == 404, "s4xx_other": s.between(400, 499) & ~s.isin(401, 403, 404), "s5xx": s >= 500}
    return requests(spark, d).groupBy("server").agg(*[F.coalesce(F.count_if(c) / F.nullif(F.count("status_code"), F.lit(0)), F.lit(0.0)).alias(k) for k, c in classes.items()])


@query(" select server, count_if(upper(http_method) = 'GET') / count(http_method) as get, count_if(upper(http_method) = 'POST') / count(http_method) as post, count_if(upper(http_method) = 'HEAD') / count(http_method) as head, count_if(upper(http_method) not in ('GET', 'POST', 'HEAD')) / count(http_method) as other from req group by 1")
def method_histogram(spark, d):
    m = F.upper("http_method")
    return requests(spark, d).groupBy("server").agg(*[(F.count_if(m == k.upper()) / F.count("http_method")).alias(k) for k in ("get", "post", "head")], (F.count_if(~m.isin("GET", "POST", "HEAD")) / F.count("http_method")).alias("other"))


SCORE_SQL = "cast(greatest(0, least(100, round_even((k / 200.0) * 100 * 1.0, 0))) as int)"


@query(f" select distinct k, {SCORE_SQL} as score from web")
def severity_score(spark, d):
    return web_events(spark, d).select("k").distinct().select("k", X.severity_score(F.col("k") / 200.0).alias("score"))


@query(" select distinct k, case when k >= 90 then 'critical' when k >= 70 then 'high' when k >= 45 then 'medium' else 'low' end as band from web")
def severity_band(spark, d):
    return web_events(spark, d).select("k").distinct().select("k", X.severity_band(F.col("k")).alias("band"))


# Profiles and counts

PROFILE_SQL = f"""
, paths as (select server, url_path, count(*) as df from req where url_path <> '' group by all),
path_totals as (select server, sum(df)::bigint as n from paths group by 1),
uas as (select server, user_agent, count(*) as freq from req where user_agent <> '' group by all),
ua_totals as (select server, sum(freq)::bigint as n from uas group by 1),
exts as (select server, {EXT_SQL.format('url_path')} as ext, count(*) as hits from req where status_code between 200 and 299 and {EXT_SQL.format('url_path')} is not null group by all)
"""


@query(f"{PROFILE_SQL} select * from paths")
def profile_paths(spark, d):
    return P.learn(requests(spark, d)).paths


@query(f"{PROFILE_SQL} select * from uas")
def profile_uas(spark, d):
    return P.learn(requests(spark, d)).uas


@query(f"{PROFILE_SQL} select server, ext from exts where hits >= 3")
def profile_exts(spark, d):
    return P.learn(requests(spark, d)).exts.where(F.col("hits") >= fixed.SERVED_MIN).select("server", "ext")


@query(f"{PROFILE_SQL} select server, n from path_totals order by n desc, server limit 1")
def dominant_server(spark, d):
    return P.dominant_server(P.learn(requests(spark, d)))


@query(f"{PROFILE_SQL} select server from path_totals union select server from ua_totals")
def servers(spark, d):
    return P.servers(P.learn(requests(spark, d)))


@query(f"{PROFILE_SQL} select distinct server from paths where url_path like '/old/%' except select server from exts where ext = 'sql'")
def set_except(spark, d):
    p = P.learn(requests(spark, d))
    return p.paths.where("url_path like '/old/%'").select("server").distinct().exceptAll(p.exts.where("ext = 'sql'").select("server").distinct())


IDF_SQL = "case when coalesce(t.n, 0) = 0 then 1.0 else ln((t.n + 1.0) / (coalesce({0}, 0) + 1.0)) / ln(t.n + 1.0) end"


@query(f"{PROFILE_SQL} select event_id, round({IDF_SQL.format('p.df')}, 6) as idf from req r left join path_totals t using (server) left join paths p on p.server = r.server and p.url_path = r.url_path")
def path_idf(spark, d):
    r = requests(spark, d)
    return P.with_path_idf(r, P.learn(r)).select("event_id", F.round("idf", 6).alias("idf"))


@query(f"{PROFILE_SQL} select event_id, round(case when user_agent is null then 1.0 else {IDF_SQL.format('u.freq')} end, 6) as rarity from (select r.event_id, r.server, r.user_agent from req r) r left join ua_totals t using (server) left join uas u using (server, user_agent)")
def ua_rarity(spark, d):
    r = requests(spark, d)
    return P.with_ua_rarity(r.select("event_id", "server", "user_agent"), P.learn(r)).select("event_id", F.round("ua_rarity", 6).alias("rarity"))


@query(f"{PROFILE_SQL} select event_id, {EXT_SQL.format('url_path')} as ext, ({EXT_SQL.format('url_path')} is not null and not exists (select 1 from exts e where e.server = r.server and e.ext = {EXT_SQL.format('r.url_path')} and hits >= 3)) as unknown_ext from req r")
def unknown_ext(spark, d):
    r = requests(spark, d)
    return P.with_unknown_ext(r, P.learn(r)).select("event_id", "ext", "unknown_ext")


@query(" select min(epoch) as first, max(epoch) as last, count(*) as n from req")
def time_span(spark, d):
    from weblens.plans.detection import time_span as span

    return span(requests(spark, d))


@query(" , s as (select min(epoch) + cast(floor((max(epoch) - min(epoch)) * 0.6) as bigint) as cut from req) select case when epoch < cut then 'train' else 'score' end as part, count(*) as n from req, s group by 1")
def time_split(spark, d):
    from weblens.plans.detection import split_by_time

    before, after, _ = split_by_time(requests(spark, d))
    return before.select(F.lit("train").alias("part")).union(after.select(F.lit("score"))).groupBy("part").agg(F.count("*").alias("n"))


COVERED = ("server", "source_ip", "user_agent", "url_path", "status_code", "http_method", "referrer", "body_bytes", "geo_country", "event_type_ecs")


@query(f" select count(*) as records, {', '.join(f'100.0 * count({c}) / count(*) as {c}_pct' for c in COVERED)}, count(distinct server) as servers, count(distinct server || source_ip || coalesce(user_agent, '')) as entities, min(us) as first_us, max(us) as last_us from web")
def contract_coverage(spark, d):
    rows = web_events(spark, d)
    return rows.agg(F.count("*").alias("records"), *[(F.lit(100.0) * F.count(c) / F.count("*")).alias(f"{c}_pct") for c in COVERED], F.count_distinct("server").alias("servers"), F.count_distinct(F.concat("server", "source_ip", F.coalesce("user_agent", F.lit("")))).alias("entities"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


@query(" , c as (select us, count(*) as n from web where us % 1000000 <> 0 group by 1), w as (select count(*) as total from web) select (select coalesce(max(n), 0) from c) as largest, total, ((select coalesce(max(n), 0) from c) >= 10 and (select coalesce(max(n), 0) from c) > 0.01 * total) as batched from w")
def ts_quality(spark, d):
    """Sub-second stamps that many records share show that records were stamped in batches."""
    each = web_events(spark, d).groupBy("us").agg(F.count("*").alias("n"))
    sums = each.agg(F.coalesce(F.max(F.when(F.col("us") % 1000000 != 0, F.col("n"))), F.lit(0)).alias("largest"), F.sum("n").alias("total"))
    return sums.withColumn("batched", (F.col("largest") >= 10) & (F.col("largest") > 0.01 * F.col("total")))


@query(" select event_id, epoch from req order by us, event_id")
def sort_events(spark, d):
    return requests(spark, d).orderBy("us", "event_id").select("event_id", "epoch")


@query(" select server, source_ip, count(*) as n from req group by rollup(server, source_ip)")
def rollup_servers(spark, d):
    return requests(spark, d).rollup("server", "source_ip").agg(F.count("*").alias("n"))


@query(" select event_id from req where status_code = 404 intersect select event_id from req where referrer is null")
def set_intersect(spark, d):
    r = requests(spark, d)
    return r.where("status_code = 404").select("event_id").intersect(r.where("referrer is null").select("event_id"))


@query()
def distinct_sketches(spark, d):
    """Approximate distinct paths and a mergeable sketch of clients, by server."""
    r = keyed(requests(spark, d))
    return r.groupBy("server").agg(F.approx_count_distinct("url_path").alias("paths"), F.hll_sketch_estimate(F.hll_sketch_agg("source_ip")).alias("clients"))
