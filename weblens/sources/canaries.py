"""Bursts of known-bad requests that every backtest must find: a scan, and a browser-declared harvester."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Addresses of the test network, agents, and paths.
SCAN_IP, SPOOF_IP = "198.51.100.99", "198.51.100.77"
SCAN_UA = "Mozilla/5.0 (compatible; Canary/1.0)"
SPOOF_UA = "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/125.0 Safari/537.36"
SCAN_PATHS = ("/backup/site_%03d.sql", "/old/config_%03d.env", "/wp-admin/setup_%03d.bak", "/admin/panel_%03d.zip", "/.git/objects/%03d", "/test/debug_%03d.tar")
SPOOF_PATHS = ("/catalog/items", "/api/list", "/export/data")


def _requests(rows: DataFrame, server: str, ip: str, ua: str, status, size: int) -> DataFrame:
    return rows.select(
        (F.lit(-1) - F.col("id")).alias("event_id"), F.timestamp_micros(F.col("epoch") * 1000000).alias("ts"), (F.col("epoch") * 1000000).alias("us"), "epoch",
        F.lit(server).alias("server"), F.lit(ip).alias("source_ip"), F.lit(ua).alias("user_agent"), "url_path", status.cast("int").alias("status_code"),
        F.lit("GET").alias("http_method"), F.lit(None).cast("string").alias("referrer"), F.lit(size).cast("long").alias("body_bytes"),
        F.lit("ZZ").alias("geo_country"), F.lit("access").alias("event_type_ecs"), F.concat(F.lit(f"{ip} GET "), "url_path").alias("original"),
    )


def scan_canary(spark: SparkSession, server: str, start: int, count: int = 150) -> DataFrame:
    """An enumeration burst from ``start`` (seconds): rare paths of unserved types, nine in ten not found."""
    i = F.col("id").cast("long")
    path = F.element_at(F.array(*[F.format_string(p, i) for p in SCAN_PATHS]), (F.col("id") % len(SCAN_PATHS) + 1).cast("int"))
    rows = spark.range(count).select("id", (F.lit(start) + i * 2 + (i * 7) % 3).alias("epoch"), path.alias("url_path"))
    return _requests(rows, server, SCAN_IP, SCAN_UA, F.when(F.col("id") % 10 == 0, 403).otherwise(404), 196)


def spoof_canary(spark: SparkSession, server: str, start: int, duration_min: int = 45, period_s: int = 2) -> DataFrame:
    """A browser by its agent that harvests like a clock, long enough for the sustained gate."""
    i = F.col("id").cast("long")
    path = F.element_at(F.array(*map(F.lit, SPOOF_PATHS)), (F.col("id") % len(SPOOF_PATHS) + 1).cast("int"))
    rows = spark.range(duration_min * 60 // period_s).select("id", (F.lit(start) + i * period_s).alias("epoch"), path.alias("url_path"))
    return _requests(rows, server, SPOOF_IP, SPOOF_UA, F.lit(200), 512)
