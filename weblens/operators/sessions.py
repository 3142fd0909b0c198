"""Sessions of a client: requests without a pause of more than half an hour."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weblens.functions import expressions as X
from weblens.functions import fixed
from weblens.operators.features import cv, keyed, ratio
from weblens.operators.quantiles import long_of, quantiles, steps

ENTITY = ["server", "source_ip", "ua_hash"]


def sessionized(requests: DataFrame, gap_s: int = fixed.SESSION_GAP_S, by: list[str] = ENTITY) -> DataFrame:
    """Requests with session_id (1, 2, ... for each client) and ``gap`` since the one before in the session.

    A pause of exactly ``gap_s`` does not end a session.
    """
    rows = keyed(requests)
    w = Window.partitionBy(*by).orderBy("us", "event_id")
    rows = rows.withColumn("before", F.lag("us").over(w))
    starts = F.when(F.col("before").isNull() | (F.col("us") - F.col("before") > gap_s * 1000000), 1).otherwise(0)
    rows = rows.withColumn("starts", starts).withColumn("session_id", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.withColumn("gap", F.when(F.col("starts") == 0, (F.col("us") - F.col("before")) / 1e6)).drop("before", "starts")


def session_features(rows: DataFrame, by: list[str] = ENTITY) -> DataFrame:
    """The 21 features of each session of sessionized requests, its start, and its first and last path."""
    n, duration = F.count("*"), (F.max("us") - F.min("us")) / 1e6
    status, path, order = F.col("status_code"), F.nullif("url_path", F.lit("")), F.struct("us", "event_id")
    method, uniq = F.upper(F.nullif("http_method", F.lit(""))), F.count_distinct(F.nullif("url_path", F.lit("")))
    classes = {"2xx": status.between(200, 299), "3xx": status.between(300, 399), "4xx_auth": status.isin(401, 403), "4xx_notfound": status == 404, "4xx_other": status.between(400, 499) & ~status.isin(401, 403, 404), "5xx": status >= 500}
    methods = {m.lower(): method == m for m in ("GET", "POST", "HEAD")} | {"other": ~method.isin("GET", "POST", "HEAD")}
    return rows.groupBy(*by, "session_id").agg(
        (F.min("us").cast("long")).alias("start_us"), duration.alias("duration_s"), n.cast("double").alias("event_count"), uniq.cast("double").alias("unique_paths"),
        F.when(duration > 0, n / (duration / 60.0)).otherwise(0.0).alias("paths_per_minute"),
        F.coalesce(F.sum("body_bytes"), F.lit(0)).cast("double").alias("bytes_total"), (F.coalesce(F.sum("body_bytes"), F.lit(0)) / n).alias("bytes_per_request"),
        F.coalesce(F.avg("gap"), F.lit(0.0)).alias("mean_inter_arrival"), cv(F.col("gap")).alias("cv_inter_arrival"),
        ratio(F.count("referrer"), n).alias("referrer_present_ratio"), F.coalesce(F.avg(X.depth(path)), F.lit(0.0)).alias("path_depth_mean"),
        (1.0 - uniq / n).alias("repeat_path_ratio"),
        *[ratio(F.count_if(c), F.count(status)).alias(f"status_{k}_ratio") for k, c in classes.items()],
        *[ratio(F.count_if(c), F.count(method)).alias(f"method_{k}_ratio") for k, c in methods.items()],
        F.min_by("url_path", order).alias("entry_path"), F.max_by("url_path", F.when(path.isNotNull(), order)).alias("exit_path"),
    )


def session_report(features: DataFrame) -> DataFrame:
    """One row: sessions, median, 95 % and greatest values, the 5 % value of the gaps' CV, and the share of sessions of one
    request. The p-th value is the first that at least p of the sessions do not exceed."""
    names = ("event_count", "duration_s", "unique_paths")
    middle, steep = quantiles(long_of(features, [*names]), [0.5]), steps(long_of(features, [*names, "cv_inter_arrival"]), [0.05, 0.95])
    value = lambda got, name, i: F.lit(got[name][i] if name in got else None).cast("double")
    out = [F.count("*").alias("sessions")]
    for name in names:
        out += [value(middle, name, 0).alias(f"{name}_p50"), value(steep, name, 1).alias(f"{name}_p95"), F.max(name).alias(f"{name}_max")]
    out.append(value(steep, "cv_inter_arrival", 0).alias("cv_p05"))
    return features.agg(*out, ratio(F.count_if(F.col("event_count") == 1), F.count("*")).alias("single_event_share"))


def in_order(rows: DataFrame, order: list[str], out: str = "place") -> DataFrame:
    """Sorted rows with their place from 1: by sorted ranges, whose sizes are summed on the driver, so no task holds all."""
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() % (1 << 33)).persist()
    before, starts = 0, {}
    for p, n in sorted((r["_p"], r["count"]) for r in spread.groupBy("_p").count().collect()):  # a row a partition
        starts[p], before = before, before + n
    start = F.element_at(F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]), F.col("_p")) if starts else F.lit(0)
    return spread.withColumn(out, (start + F.col("_i") + 1).cast("long")).drop("_p", "_i")
