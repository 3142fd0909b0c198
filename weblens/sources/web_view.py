"""Request records over the ``events`` test table: a fixed mapping, the same text for Spark and for the SQL it is checked by."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The mapping. Both engines read these expressions.
K = "cast(regexp_extract(props, '[0-9]+', 0) as int)"
COLUMNS = {
    "server": "concat('srv', user_id % 3)",
    "source_ip": "case when user_id % 10 = 7 then concat('66.249.66.', user_id % 200 + 1) else concat('203.0.113.', user_id % 250 + 1) end",
    "user_agent": "case user_id % 10 when 7 then 'Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)' when 3 then 'curl/8.5.0'"
    " when 9 then null else concat('Mozilla/5.0 (X11; Linux x86_64; rv:', 100 + user_id % 7, '.0) Gecko/20100101 Firefox/', 100 + user_id % 7, '.0') end",
    "url_path": "case event_type when 'error' then concat('/old/backup_', k, '.sql') when 'click' then concat('/static/app', k % 5, '.js')"
    " when 'signup' then case when k % 10 = 0 then '/robots.txt' else '/account/signup' end when 'purchase' then '/shop/buy' else concat('/page/', k % 20, '.html') end",
    "status_code": "case when event_type = 'error' then case when k % 4 = 0 then 500 else 404 end when event_type = 'click' and k % 3 = 0 then 304"
    " when event_type = 'signup' and k % 7 = 0 then 403 else 200 end",
    "http_method": "case when event_type in ('signup', 'purchase') then 'POST' else 'GET' end",
    "referrer": "case when event_type = 'error' or k % 3 = 0 then null when event_type = 'click' then concat('/page/', k % 20, '.html') else 'https://site.example/page/1.html?x=1' end",
    "body_bytes": "cast(floor(value * 10) as bigint)",
    "geo_country": "case when user_id % 5 = 0 then null else 'US' end",
    "event_type_ecs": "case when k % 11 = 0 then 'error' when k % 11 = 1 then null else 'access' end",
    "original": "concat(event_id, ' ', event_type, ' ', props)",
}


def web_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records. Times are UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    ts = F.col("ts").cast("timestamp")
    rows = events.select("event_id", "user_id", "event_type", "value", "props", ts.alias("ts"), F.unix_micros(ts).alias("us"), F.expr(K).alias("k"))
    return rows.select("event_id", "user_id", "ts", "us", F.expr("us div 1000000").alias("epoch"), "k", *[F.expr(e).alias(c) for c, e in COLUMNS.items()])


#: The same rows for DuckDB, as common table expressions ``web`` and ``req`` (requests with their keys).
SQL = f"""
raw0 as (select *, epoch_us(ts) as us, {K} as k from events),
web as (select event_id, user_id, ts, us, us // 1000000 as epoch, k, {", ".join(f"{e} as {c}" for c, e in COLUMNS.items())} from raw0),
req as (select *, substr(sha256(coalesce(user_agent, '')), 1, 16) as ua_hash from web where event_type_ecs is null or event_type_ecs = 'access')
"""
