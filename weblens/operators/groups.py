"""Surfaces for features and state that a deployment adds: aggregates that join the one grouping by window, and keyed tables."""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weblens.functions import fixed
from weblens.operators.features import KEY, keyed


class FeatureGroup:
    """Features of a window as aggregates over its requests: Spark combines them before it shuffles."""

    name = ""
    depends_on: tuple[str, ...] = ()

    def aggregates(self) -> dict[str, Column]:
        """A column for each feature that the group produces."""
        raise NotImplementedError

    @property
    def produces(self) -> tuple[str, ...]:
        return tuple(self.aggregates())


def grouped_features(requests: DataFrame, groups: list[FeatureGroup], window_s: int = fixed.WINDOW_S) -> DataFrame:
    """(server, source_ip, ua_hash, window_start, features) of all groups, by one aggregate."""
    columns = {n: c for g in groups for n, c in g.aggregates().items()}
    if len(columns) < sum(len(g.produces) for g in groups):
        raise ValueError("two groups produce a feature of one name")
    rows = keyed(requests, window_s).groupBy(*KEY).agg(*[c.alias(n) for n, c in columns.items()])
    return rows.select(*KEY[:-1], (F.col("bucket") * window_s).alias("window_start"), *columns)


class StateStore:
    """Counters and sets by key, as tables of additions: a batch adds rows, a read sums them.

    ``batch`` names what a job adds, so that a job that runs again replaces what it added before.
    """

    COUNTS, MEMBERS = "key string, n long, at long", "key string, member string, at long"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _add(self, rows: DataFrame, table: str, batch: str | None) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{table}/batch={batch or uuid.uuid4().hex}")

    def _all(self, table: str, schema: str) -> DataFrame:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(f"{schema}, batch string").parquet(f"{self.root}/{table}").drop("batch")

    def incr(self, rows: DataFrame, batch: str | None = None) -> None:
        """Add (key, n, at); at is in seconds."""
        self._add(rows.select("key", F.col("n").cast("long"), F.col("at").cast("long")).groupBy("key", "at").agg(F.sum("n").alias("n")).select("key", "n", "at"), "counts", batch)

    def get(self, since: int = 0) -> DataFrame:
        """(key, n): sums of what was added from ``since``."""
        return self._all("counts", self.COUNTS).where(F.col("at") >= since).groupBy("key").agg(F.sum("n").alias("n"))

    def add_unique(self, rows: DataFrame, batch: str | None = None) -> None:
        """Add (key, member, at)."""
        self._add(rows.groupBy("key", "member").agg(F.max(F.col("at").cast("long")).alias("at")), "members", batch)

    def count_unique(self, since: int = 0) -> DataFrame:
        """(key, n): different members added from ``since``; a row a member first, then a row a key."""
        return self._all("members", self.MEMBERS).where(F.col("at") >= since).select("key", "member").distinct().groupBy("key").agg(F.count("*").alias("n"))

    def expire(self, before: int) -> "StateStore":
        """What is left from ``before`` on, as one batch of a new store beside this one; the old one can go when nothing reads it."""
        left = StateStore(self.spark, f"{self.root}-from-{before}")
        left._add(self._all("counts", self.COUNTS).where(F.col("at") >= before), "counts", "expired")
        left._add(self._all("members", self.MEMBERS).where(F.col("at") >= before), "members", "expired")
        return left
