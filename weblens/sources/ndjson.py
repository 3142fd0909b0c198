"""Newline-delimited JSON request records: schema, flattening, dead letters, counts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblens.functions.expressions import is_request

#: The nested record. Timestamps and numbers arrive as text or numbers alike, so they are read as text and cast.
RECORD = (
    "`@timestamp` string, observer struct<org:string,dept:string,env:string,server:string,source_host:string,source_program:string>,"
    "source struct<ip:string,geo:struct<country_iso_code:string,country_name:string,city_name:string,location:struct<lat:double,lon:double>>>,"
    "http struct<request:struct<method:string,referrer:string>,response:struct<status_code:string,body:struct<bytes:string>>>,"
    "url struct<path:string,query:string>, user_agent struct<original:string>,"
    "event struct<category:string,type:string,module:string,original:string,timestamp_source:string,original_time:string>, _bad string"
)
#: The flat columns and where they come from.
FLAT = {
    "org": "j.observer.org", "dept": "j.observer.dept", "env": "j.observer.env", "server": "j.observer.server",
    "source_host": "j.observer.source_host", "source_program": "j.observer.source_program", "source_ip": "j.source.ip",
    "geo_country": "j.source.geo.country_iso_code", "geo_name": "j.source.geo.country_name", "geo_city": "j.source.geo.city_name",
    "geo_lat": "j.source.geo.location.lat", "geo_lon": "j.source.geo.location.lon", "http_method": "j.http.request.method",
    "referrer": "nullif(j.http.request.referrer, '-')", "status_code": "try_cast(j.http.response.status_code as int)",
    "body_bytes": "try_cast(j.http.response.body.bytes as bigint)", "url_path": "j.url.path", "url_query": "j.url.query",
    "user_agent": "j.user_agent.original", "event_category": "j.event.category", "event_type_ecs": "j.event.type",
    "event_module": "j.event.module", "original": "j.event.original", "timestamp_source": "j.event.timestamp_source",
}


def lines(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """(value, source) of all lines below a folder or of a file."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path).select("value", F.col("_metadata.file_path").alias("source"))


def parsed(raw: DataFrame) -> DataFrame:
    """Lines (value, ...) with the flat columns, ``ts`` and ``reason``: null, or why the line is no record."""
    j = raw.where(F.trim("value") != "").withColumn("j", F.from_json("value", RECORD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    given = F.col("j.`@timestamp`")
    # A time of day alone casts to a time of today: a date must stand in front.
    ts = F.when(given.rlike(r"^\d{4}-\d\d-\d\d"), given.try_cast("timestamp"))
    reason = F.when(F.col("j").isNull() | F.col("j._bad").isNotNull(), "json").when(given.isNull(), "missing @timestamp").when(ts.isNull(), "bad @timestamp")
    out = j.select(*raw.columns, ts.alias("ts"), *[F.expr(e).alias(c) for c, e in FLAT.items()], reason.alias("reason"))
    # Order of arrival, where there is one; a stream names its events by what they say.
    return out.withColumn("event_id", F.xxhash64("value", "source") if raw.isStreaming else F.monotonically_increasing_id())


def records(lines_: DataFrame) -> DataFrame:
    """What parses and is a request; the filter stands before anything that shuffles."""
    return lines_.where(F.col("reason").isNull() & is_request(F.col("event_type_ecs")))


def dead_letters(lines_: DataFrame) -> DataFrame:
    return lines_.where("reason is not null").select("source", "reason", F.col("value").alias("raw"))


def ingest_stats(lines_: DataFrame) -> DataFrame:
    """One row: lines, parsed, failed, skipped, failure_rate."""
    failed, skipped = F.count_if(F.col("reason").isNotNull()), F.count_if(F.col("reason").isNull() & ~is_request(F.col("event_type_ecs")))
    return lines_.agg(F.count("*").alias("lines"), F.count_if(F.col("reason").isNull()).alias("parsed"), failed.alias("failed"), skipped.alias("skipped"), F.coalesce(failed / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("failure_rate"))


def failure_reasons(lines_: DataFrame, k: int = 5) -> DataFrame:
    return lines_.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(k)


def first_events(events: DataFrame, n: int) -> DataFrame:
    """The first n in order of arrival."""
    return events.orderBy("event_id").limit(n)
