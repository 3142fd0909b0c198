"""What is normal on each server: how often paths and agents occur, which file types are served."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weblens.functions import fixed
from weblens.functions.expressions import extension
from weblens.operators.lineage import cut


@dataclass
class Profile:
    """Tables by server: paths (server, url_path, df), path_totals (server, n), uas (server, user_agent, freq), ua_totals
    (server, n), exts (server, ext, hits)."""

    paths: DataFrame
    path_totals: DataFrame
    uas: DataFrame
    ua_totals: DataFrame
    exts: DataFrame

    TABLES = ("paths", "path_totals", "uas", "ua_totals", "exts")

    def save(self, folder: str) -> None:
        for t in self.TABLES:
            getattr(self, t).write.mode("overwrite").parquet(f"{folder}/{t}")

    @classmethod
    def load(cls, spark, folder: str) -> "Profile":
        return cls(*[spark.read.parquet(f"{folder}/{t}") for t in cls.TABLES])


def most_frequent(counts: DataFrame, n: str, item: str, cap: int) -> DataFrame:
    """The ``cap`` most frequent items of each server; equal ones by name.

    How many items occur how often says which count a server's head ends in; all above it stay. Of those with just that
    count the first by name fill what is left: they lie in sorted ranges, whose sizes are chained on the driver (a row for
    each range and server in it), so that no task orders all items of a server.
    """
    often = counts.groupBy("server", F.col(n).alias("_n")).agg(F.count("*").alias("_m"))
    upto = F.sum("_m").over(Window.partitionBy("server").orderBy(F.desc("_n")))
    # Different counts of a server are few: they add up to its requests.
    full = often.withColumn("_upto", upto).where(F.col("_upto") > cap)
    ends = full.groupBy("server").agg(F.max(F.struct("_n", (F.lit(cap) - F.col("_upto") + F.col("_m")).alias("_left"))).alias("_end")).select("server", "_end.*")
    if not ends.limit(1).count():
        return counts
    rows = counts.join(ends, "server", "left")
    above = rows.where(F.col("_n").isNull() | (F.col(n) > F.col("_n"))).select(*counts.columns)
    ties = rows.where(F.col(n) == F.col("_n")).repartitionByRange("server", item).withColumn("_p", F.spark_partition_id()).persist()
    before: dict[str, int] = {}
    starts = []
    for server, p, m in sorted(map(tuple, ties.groupBy("server", "_p").agg(F.count("*")).collect()), key=lambda r: (r[0] or "", r[1])):
        starts.append((server, p, before.get(server, 0)))
        before[server] = before.get(server, 0) + m
    placed = ties.join(counts.sparkSession.createDataFrame(starts, "server string, _p int, _before long"), ["server", "_p"])
    within = F.row_number().over(Window.partitionBy("server", "_p").orderBy(item))
    kept = placed.where(F.col("_before") < F.col("_left")).withColumn("_i", F.col("_before") + within).where(F.col("_i") <= F.col("_left"))
    return above.unionByName(kept.select(*counts.columns))


def asked(requests: DataFrame) -> DataFrame:
    """(server, url_path, user_agent, n, ok): how often an agent asked a server for a path, and how often with success."""
    return requests.groupBy("server", "url_path", "user_agent").agg(F.count("*").alias("n"), F.count_if(F.col("status_code").between(200, 299)).alias("ok"))


def path_counts(asked_: DataFrame) -> DataFrame:
    return asked_.where("url_path <> ''").groupBy("server", "url_path").agg(F.sum("n").alias("df"))


def ua_counts(asked_: DataFrame) -> DataFrame:
    return asked_.where("user_agent <> ''").groupBy("server", "user_agent").agg(F.sum("n").alias("freq"))


def ext_counts(asked_: DataFrame) -> DataFrame:
    """File types that answered with success, with how often; those of at least SERVED_MIN are served."""
    ok = asked_.where("ok > 0").select("server", extension(F.col("url_path")).alias("ext"), "ok")
    return ok.where("ext is not null").groupBy("server", "ext").agg(F.sum("ok").alias("hits"))


def totals(counts: DataFrame, n: str) -> DataFrame:
    return counts.groupBy("server").agg(F.sum(n).alias("n"))


def learn(requests: DataFrame) -> Profile:
    """Totals count everything; tables keep the most frequent items. One pass over the requests serves all tables."""
    seen = cut(asked(requests))
    paths, uas = path_counts(seen), ua_counts(seen)
    kept_paths, kept_uas = most_frequent(paths, "df", "url_path", fixed.MAX_PROFILE_PATHS), most_frequent(uas, "freq", "user_agent", fixed.MAX_PROFILE_UAS)
    return Profile(kept_paths, totals(paths, "df"), kept_uas, totals(uas, "freq"), ext_counts(seen))


def servers(profile: Profile) -> DataFrame:
    return profile.path_totals.select("server").union(profile.ua_totals.select("server")).distinct()


def dominant_server(profile: Profile) -> DataFrame:
    """The server with most requests; of equal ones the first by name."""
    return profile.path_totals.where("server is not null").orderBy(F.desc("n"), "server").limit(1).select("server", "n")


def rarity(total, count):
    """1 for what was never seen (or of an empty profile), near 0 for what is common."""
    return F.when(F.coalesce(total, F.lit(0)) == 0, 1.0).otherwise(F.log((total + 1.0) / (F.coalesce(count, F.lit(0)) + 1.0)) / F.log(total + 1.0))


def with_path_idf(requests: DataFrame, profile: Profile) -> DataFrame:
    """Requests with ``idf``, 0 without a path. The totals have a row a server; the table of paths may be large, so Spark
    picks the join by its size."""
    t = profile.path_totals.select(F.col("server").alias("s1"), F.col("n").alias("total"))
    p = profile.paths.select(F.col("server").alias("s2"), F.col("url_path").alias("p2"), "df")
    out = requests.join(t, F.col("server").eqNullSafe(F.col("s1")), "left").join(p, F.col("server").eqNullSafe(F.col("s2")) & (F.col("url_path") == F.col("p2")), "left")
    idf = F.when(F.coalesce(F.col("url_path"), F.lit("")) == "", 0.0).otherwise(rarity(F.col("total"), F.col("df")))
    return out.withColumn("idf", idf).drop("s1", "s2", "p2", "total", "df")


def with_ua_rarity(rows: DataFrame, profile: Profile) -> DataFrame:
    """Rows (server, user_agent, ...) with ``ua_rarity``."""
    t = profile.ua_totals.select(F.col("server").alias("s1"), F.col("n").alias("total"))
    u = profile.uas.select(F.col("server").alias("s2"), F.col("user_agent").alias("u2"), "freq")
    out = rows.join(t, F.col("server").eqNullSafe(F.col("s1")), "left").join(u, F.col("server").eqNullSafe(F.col("s2")) & (F.col("user_agent") == F.col("u2")), "left")
    value = F.when(F.coalesce(F.col("user_agent"), F.lit("")) == "", 1.0).otherwise(rarity(F.col("total"), F.col("freq")))
    return out.withColumn("ua_rarity", value).drop("s1", "s2", "u2", "total", "freq")


def with_unknown_ext(requests: DataFrame, profile: Profile) -> DataFrame:
    """Requests with ``ext`` and whether the server does not serve it."""
    served = profile.exts.where(F.col("hits") >= fixed.SERVED_MIN).select(F.col("server").alias("s1"), F.col("ext").alias("e1"), F.lit(True).alias("served"))
    out = requests.withColumn("ext", extension(F.col("url_path")))
    out = out.join(served, F.col("server").eqNullSafe(F.col("s1")) & (F.col("ext") == F.col("e1")), "left")
    return out.withColumn("unknown_ext", F.col("ext").isNotNull() & F.col("served").isNull()).drop("s1", "e1", "served")
