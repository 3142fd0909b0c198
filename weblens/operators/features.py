"""The 22 features of a client's window, as one aggregate by key and side aggregates of distinct paths.

A key is (server, source_ip, ua_hash, bucket). Order within a window is by time and event id. Requests are shuffled by key once for
what depends on their order, and counted by key and path before anything meets the profile: a page that everybody asks for joins
with one row a window, not one a request. Path segments come from the same counts. What runs over a client's windows (hours of
activity, robots.txt) runs over rows a window.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblens.functions import expressions as X
from weblens.functions import fixed
from weblens.operators.profile import Profile, with_path_idf, with_ua_rarity, with_unknown_ext

ENTITY = ["server", "source_ip", "ua_hash"]
KEY = [*ENTITY, "bucket"]
HOURS = range(24)


def keyed(requests: DataFrame, window_s: int = fixed.WINDOW_S) -> DataFrame:
    """Requests with their window's key; clients without a server or address are ``_``."""
    named = requests.withColumn("server", F.coalesce("server", F.lit("_"))).withColumn("source_ip", F.coalesce("source_ip", F.lit("_")))
    return named.withColumn("ua_hash", X.ua_hash(F.col("user_agent"))).withColumn("bucket", F.floor(F.col("epoch") / window_s).cast("long"))


def ratio(n: Column, of: Column) -> Column:
    return F.coalesce(n / F.nullif(of, F.lit(0)), F.lit(0.0))


def gaps(requests: DataFrame) -> DataFrame:
    """Keyed requests with ``gap``, the seconds since the one before in the window, and their place ``n``."""
    w = Window.partitionBy(*KEY).orderBy("us", "event_id")
    return requests.withColumn("gap", (F.col("us") - F.lag("us").over(w)) / 1e6).withColumn("place", F.row_number().over(w))


def cv(gap: Column) -> Column:
    """Deviation of the population by the mean, 0 of fewer than two gaps or a mean of 0."""
    return F.when((F.count(gap) >= 2) & (F.avg(gap) > 0), F.stddev_pop(gap) / F.avg(gap)).otherwise(0.0)


def entropy(total: Column, kinds: Column, weighted: Column) -> Column:
    """Shannon entropy by its greatest value, from the total, the number of kinds and the sum of c * log2 c."""
    return F.when((total > 1) & (kinds > 1), (F.log2(total) - weighted / total) / F.log2(kinds)).otherwise(0.0)


def paths_by_key(requests: DataFrame) -> DataFrame:
    """(KEY, url_path, c): how often a window asks for each path; counted before the shuffle."""
    return requests.where("url_path <> ''").groupBy(*KEY, "url_path").agg(F.count("*").alias("c"))


def path_sums(counts: DataFrame, profile: Profile) -> DataFrame:
    """By key, from counts by path: paths, and the requests' sum of idf, of unknown file types and of assets."""
    rows = with_unknown_ext(with_path_idf(counts, profile), profile)
    of = lambda at: F.coalesce(F.sum(F.when(at, F.col("c"))), F.lit(0))
    return rows.groupBy(*KEY).agg(F.count("*").alias("paths"), F.sum(F.col("idf") * F.col("c")).alias("idf_sum"), of(F.col("unknown_ext")).alias("unknown"), of(F.col("ext").isin(*fixed.ASSET_EXTENSIONS)).alias("assets"))


def token_entropy(counts: DataFrame) -> DataFrame:
    """By key, from counts by path: the entropy of path segments."""
    each = counts.select(*KEY, "c", F.explode(X.tokens(F.col("url_path"))).alias("token")).groupBy(*KEY, "token").agg(F.sum("c").cast("double").alias("c"))
    sums = each.groupBy(*KEY).agg(F.sum("c").alias("total"), F.count("*").alias("kinds"), F.sum(F.col("c") * F.log2("c")).alias("weighted"))
    return sums.select(*KEY, entropy(F.col("total"), F.col("kinds"), F.col("weighted")).alias("web_path_token_entropy"))


def fano(n: Column, squares: Column, window_s: int) -> Column:
    """Variance by mean of the requests in sub-bins, from their number and the sum of the bins' squares."""
    bins = window_s // fixed.FANO_BIN_S
    mean = n / bins
    return F.when(F.lit(bins > 1) & (mean > 0), (squares / bins - mean * mean) / mean).otherwise(0.0)


def ordered(requests: DataFrame, window_s: int) -> DataFrame:
    """Keyed requests with their place in the window and what comes of it; one shuffle by key and one sort serve all.

    ``odd`` is 1, 3, 5, ... within a sub-bin, so that its sum over a bin of c requests is c squared.
    """
    rows = requests.withColumn("bin", F.floor((F.col("epoch") - F.col("bucket") * window_s) / fixed.FANO_BIN_S))
    w = Window.partitionBy(*KEY).orderBy("bin", "us", "event_id")  # bins ascend with time
    inside = Window.partitionBy(*KEY, "bin").orderBy("us", "event_id")
    return rows.select(
        "*", ((F.col("us") - F.lag("us").over(w)) / 1e6).alias("gap"), F.row_number().over(w).alias("place"), F.count("body_bytes").over(w).alias("bytes_place"),
        (2 * F.row_number().over(inside) - 1).alias("odd"), (F.count("*").over(Window.partitionBy(*KEY)) - F.row_number().over(w) + 1).alias("from_end"),
    )


def first_of_keys(columns: list[pa.Array]) -> list[int]:
    """The rows of sorted columns at which a key begins; nulls are equal to each other."""
    n = len(columns[0])
    new = np.zeros(max(0, n - 1), bool)
    for c in columns:
        one, two = c.slice(0, max(0, n - 1)), c.slice(1)
        other = pc.fill_null(pc.not_equal(one, two), False).to_numpy(zero_copy_only=False)
        new |= other | (one.is_null().to_numpy(zero_copy_only=False) != two.is_null().to_numpy(zero_copy_only=False))
    return [0, *(np.flatnonzero(new) + 1).tolist()] if n else []


def chain_depth(requests: DataFrame) -> DataFrame:
    """By key: how deep navigation by referrers goes, up to the request that brings a window's path number MAX_CHAIN.

    Requests come sorted and in batches; only the depths of at most MAX_CHAIN paths of one window are held. Keys are compared
    column by column, and only read where a window ends.
    """
    steps = requests.where("url_path <> ''").select(*KEY, "url_path", X.referrer_path(F.col("referrer")).alias("ref_path"), "us", "event_id")
    steps = steps.repartition(*KEY).sortWithinPartitions(*KEY, "us", "event_id").drop("us", "event_id")
    cap = fixed.MAX_CHAIN
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in steps.schema if f.name in KEY]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, known, most, kind = None, {}, 0, None

        def row(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[pa.array([d[0][i] for d in done], kind[i]) for i in range(len(KEY))], pa.array([float(d[1]) for d in done], pa.float64())], names=[*KEY, "bot_referrer_chain_depth"])

        for b in batches:
            kind, done = [b.schema.field(k).type for k in KEY], []
            paths, refs = b.column("url_path").to_pylist(), b.column("ref_path").to_pylist()
            starts = first_of_keys([b.column(k) for k in KEY])
            for start, end in zip(starts, [*starts[1:], len(paths)], strict=True):
                at = [b.column(k)[start].as_py() for k in KEY]
                if at != key:
                    if key is not None:
                        done.append((key, most))
                    key, known, most = at, {}, 0
                for path, ref in zip(paths[start:end], refs[start:end], strict=True):
                    if len(known) >= cap:
                        break
                    depth = known.get(ref, 0) + 1
                    if depth > known.get(path, 0):
                        known[path] = depth
                        if depth > most:
                            most = depth
            if done:
                yield row(done)
        if key is not None:
            yield row([(key, most)])

    return steps.mapInArrow(walk, ", ".join([*kinds, "bot_referrer_chain_depth double"]))


def family_robots(requests: DataFrame) -> DataFrame:
    """(server, family, since): when a verified crawler of a family first fetched robots.txt of a server, in seconds.

    Filters on the family move down to the scan, ahead of the one on the path: the family itself asks for the path first.
    """
    fetched = F.col("url_path") == "/robots.txt"
    robots = requests.where(fetched).withColumn("family", F.when(fetched, X.crawler_family(F.col("user_agent"))))
    robots = robots.where(F.col("family").isNotNull() & X.in_family(F.col("source_ip"), F.col("family")))
    return robots.groupBy("server", "family").agg(F.min("epoch").alias("since"))


def base(requests: DataFrame, window_s: int) -> DataFrame:
    """One aggregate by key over ordered requests."""
    n, status = F.count("*"), F.col("status_code")
    size = F.when(F.col("bytes_place") <= fixed.MAX_BYTES, F.col("body_bytes"))
    return requests.groupBy(*KEY).agg(
        n.alias("event_count"), F.count_if(status == 404).alias("n404"),
        ratio(F.count_if(status == 404), n).alias("web_ratio_404"),
        *[ratio(F.count_if(status.between(a, b)), n).alias(f"web_status_{a // 100}xx_ratio") for a, b in ((200, 299), (300, 399), (400, 499), (500, 10**6))],
        ratio(F.count_if(F.col("referrer").isNull()), n).alias("web_referrer_absent_ratio"),
        F.max("user_agent").alias("user_agent"),
        cv(F.when(F.col("place") <= fixed.MAX_GAPS + 1, F.col("gap"))).alias("timing_interarrival_cv"),
        fano(n, F.sum("odd"), window_s).alias("timing_fano_factor"),
        ratio(F.count_if(F.upper("http_method") == "GET"), F.count_if(F.col("http_method") != "")).alias("bot_method_get_ratio"),
        F.coalesce(F.percentile(size, F.lit(0.5)), F.lit(0.0)).alias("bot_bytes_per_req_p50"),
        F.max(F.coalesce(F.col("url_path") == "/robots.txt", F.lit(False))).alias("robots"),
        F.array_sort(F.collect_list(F.when(F.col("from_end") <= fixed.MAX_RAW, F.struct("us", "event_id", "original")))).alias("raw"),
        *[F.expr(f"count_if(hour(ts) = {h}) as h{h}") for h in HOURS],
    )


def with_path_features(windows: DataFrame, window_s: int) -> DataFrame:
    """Windows with ``path_sums`` (null where none has a path) with the features that come of them."""
    n, paths = F.col("event_count"), F.coalesce("paths", F.lit(0))
    capped = F.least(paths, F.lit(fixed.MAX_PATHS))
    out = windows.withColumns({
        "distinct_paths": capped, "distinct_paths_capped": paths > fixed.MAX_PATHS, "web_mean_path_idf": F.coalesce("idf_sum", F.lit(0.0)) / n, "web_uniq_paths_per_min": capped / (window_s / 60.0),
        "web_unknown_ext_ratio": F.coalesce("unknown", F.lit(0)) / n, "bot_asset_fetch_ratio": F.coalesce("assets", F.lit(0)) / n, "bot_path_repeat_ratio": (n - capped) / n,
    })
    return out.drop("paths", "idf_sum", "unknown", "assets")


def hour_entropy(seen: list[str]) -> Column:
    """Entropy of activity over the hours of a day by log2 24; 0 of one event or one hour."""
    total = f"cast({' + '.join(seen)} as double)"
    kinds = " + ".join(f"if({c} > 0, 1, 0)" for c in seen)
    weighted = " + ".join(f"if({c} > 0, {c} * log2({c}), 0d)" for c in seen)
    return F.expr(f"case when {total} > 1 and {kinds} > 1 then (log2({total}) - ({weighted}) / {total}) / log2(24d) else 0d end")


def remembered(windows: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Windows with what a client has shown up to each window's end: hours of activity and robots.txt.

    ``before`` (ENTITY, b0..b23, ever_before) is what clients have shown before these windows.
    """
    w = f"over (partition by {', '.join(ENTITY)} order by bucket rows unbounded preceding)"
    seen = windows.select("*", *[F.expr(f"sum(h{h}) {w} as s{h}") for h in HOURS], F.expr(f"max(robots) {w} as ever"))
    if before is not None:
        seen = seen.join(before, ENTITY, "left").withColumns({f"s{h}": F.expr(f"s{h} + coalesce(b{h}, 0)") for h in HOURS} | {"ever": F.expr("ever or coalesce(ever_before, false)")})
        seen = seen.drop("ever_before", *[f"b{h}" for h in HOURS])
    out = seen.withColumns({"bot_activity_hour_entropy": hour_entropy([f"s{h}" for h in HOURS]), "bot_robots_txt_fetched": F.col("ever").cast("double")})
    return out.drop("ever", "robots", *[f"{a}{h}" for a in "sh" for h in HOURS])


def activity(requests: DataFrame) -> DataFrame:
    """(ENTITY, b0..b23, ever_before): what clients have shown in these requests."""
    robots = F.max(F.coalesce(F.col("url_path") == "/robots.txt", F.lit(False))).alias("ever_before")
    return keyed(requests).groupBy(*ENTITY).agg(*[F.expr(f"count_if(hour(ts) = {h}) as b{h}") for h in HOURS], robots)


def window_features(requests: DataFrame, profile: Profile, window_s: int = fixed.WINDOW_S, before: DataFrame | None = None, robots_before: DataFrame | None = None) -> DataFrame:
    """All features and the evidence of each window, by (server, source_ip, ua_hash, window_start) in seconds.

    ``before`` and ``robots_before`` are what is known from earlier requests, in the forms of ``activity`` and
    ``family_robots``; a batch over all requests needs neither.
    """
    keyed_ = keyed(requests, window_s)
    counts = paths_by_key(keyed_)
    out = base(ordered(keyed_, window_s), window_s)
    for side in (path_sums(counts, profile), token_entropy(counts), chain_depth(keyed_)):
        on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in KEY]
        out = out.alias("l").join(side.alias("r"), on, "left").select("l.*", *[f"r.{c}" for c in side.columns if c not in KEY])
    out = out.fillna(0.0, ["web_path_token_entropy", "bot_referrer_chain_depth"])
    out = remembered(with_path_features(out, window_s), before)
    out = with_ua_rarity(out, profile)
    robots = family_robots(keyed_)
    if robots_before is not None:
        robots = robots.unionByName(robots_before).groupBy("server", "family").agg(F.min("since").alias("since"))
    robots = robots.select(F.col("server").alias("s1"), F.col("family").alias("f1"), "since")
    end = (F.col("bucket") + 1) * window_s
    out = out.withColumn("crawler_family", X.crawler_family(F.col("user_agent"))).withColumn("declared_bot", X.declared_bot(F.col("user_agent")))
    # A row a server and family; Spark broadcasts it where it is small.
    out = out.join(robots, (F.col("server") == F.col("s1")) & (F.col("crawler_family") == F.col("f1")) & (F.col("since") < end), "left")
    return out.select(
        *ENTITY, (F.col("bucket") * window_s).alias("window_start"), end.alias("window_end"), "event_count", "distinct_paths", "distinct_paths_capped", "n404", "user_agent", "declared_bot", "crawler_family",
        X.in_family(F.col("source_ip"), F.col("crawler_family")).alias("verified_crawler"), F.col("since").isNotNull().alias("family_robots_txt"),
        F.transform("raw", lambda r: r["original"]).alias("raw_lines"),
        F.length(F.coalesce("user_agent", F.lit(""))).cast("double").alias("ua_len"), "ua_rarity", F.col("declared_bot").cast("double").alias("bot_declared_bot"),
        *[c for c in fixed.FEATURES if c not in ("ua_len", "ua_rarity", "bot_declared_bot")],
    )


def long_form(vectors: DataFrame, ids: list[str], features: tuple[str, ...] = fixed.FEATURES) -> DataFrame:
    """(ids, feature, value): a row for each feature that is not null."""
    return vectors.select(*ids, *[F.col(c).cast("double").alias(c) for c in features]).unpivot(ids, list(features), "feature", "value").where("value is not null")


def complete(vectors: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Only whole vectors; what is missing is not taken as 0."""
    return vectors.dropna(how="any", subset=list(required))


def sliding(requests: DataFrame, window: str = "1 day", slide: str = "12 hours") -> DataFrame:
    """Counts of sliding windows by server."""
    got = requests.groupBy("server", F.window("ts", window, slide).alias("w")).agg(F.count("*").alias("n"))
    return got.select("server", F.unix_seconds("w.start").alias("window_start"), "n")


def server_windows(requests: DataFrame, window_s: int) -> DataFrame:
    """Requests and clients of a server in each window: floods that no single client shows."""
    return keyed(requests, window_s).groupBy("server", (F.col("bucket") * window_s).alias("window_start")).agg(F.count("*").alias("n"), F.count_distinct("source_ip").alias("clients"))
