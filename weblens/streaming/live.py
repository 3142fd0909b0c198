"""The live service: closed windows of a stream go through the batch operators, one micro-batch at a time.

Requests wait in the stream's state until the watermark passes their window; a window is handed on once and whole, later
requests of it are dropped and counted by Spark. Each client's memory (hours of activity, robots.txt) lies in the state
store by client, for as long as it shows itself once in MEMORY_DAYS; closed requests pass it and take along what their
client had shown before the micro-batch. Each micro-batch then runs the same plan as a batch: bot detection first,
reconnaissance with its export. Robots fetches by crawler families are a snapshot that each batch replaces, and scored
windows lie by day, of which the last two carry streaks, folds and budgets on: what a batch reads does not grow with the
number of batches before it. A batch that runs again finds the state as it was and overwrites what it wrote.
"""

import json
import os
import time
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from weblens.functions import fixed
from weblens.functions.expressions import is_request
from weblens.operators import detect
from weblens.operators.drift import drift_report, stability
from weblens.operators.features import family_robots, keyed, long_form, window_features
from weblens.plans import detection, usecases
from weblens.plans.detection import Bundle
from weblens.sources import ndjson

#: Requests of a window wait in so many groups, so that one client's share is not one group.
SALTS = 64
HORIZON_S = 2 * 86400
#: Days after which the memory of a client that was not seen again is given up.
MEMORY_DAYS = 30
#: Seconds between two checks for drift.
DRIFT_S = 3600
HOURS = [f"b{h}" for h in range(24)]


def tailed(spark: SparkSession, path: str, pattern: str = "*.json", start_at_end: bool = False) -> DataFrame:
    """The parsed lines of growing files."""
    from weblens.sources.tail import TailSource

    spark.dataSource.register(TailSource)
    raw = spark.readStream.format("weblens_tail").option("path", path).option("pattern", pattern).option("startAtEnd", str(start_at_end).lower()).load()
    return ndjson.parsed(raw).withColumn("us", F.unix_micros("ts")).withColumn("epoch", F.floor(F.col("us") / 1000000))


COLUMNS = ["event_id", "ts", "us", "epoch", "server", "source_ip", "user_agent", "url_path", "status_code", "http_method", "referrer", "body_bytes", "geo_country", "event_type_ecs", "original"]


def closed_requests(stream: DataFrame, window_s: int = fixed.WINDOW_S, grace_s: int = fixed.GRACE_S) -> DataFrame:
    """The requests of windows that the watermark has passed."""
    rows = stream.where(is_request(F.col("event_type_ecs")) & F.col("ts").isNotNull()).select(*COLUMNS)
    salt = F.pmod(F.xxhash64("event_id", "us"), F.lit(SALTS))
    held = rows.withWatermark("ts", f"{grace_s} seconds").groupBy(F.window("ts", f"{window_s} seconds"), salt.alias("salt"))
    lists = held.agg(F.collect_list(F.struct(*[F.col(c).alias(c) for c in COLUMNS])).alias("held"))
    return lists.select(F.window_time("window").alias("closes"), F.explode("held").alias("r")).select("r.*", "closes")


class Memory(StatefulProcessor):
    """By client: hits by hour of the day, and whether robots.txt was ever fetched. Rows leave with what was known before.

    A timer gives up what is known of a client that was not seen for MEMORY_DAYS of the stream's time.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hours = handle.getMapState("hours", "hour int", "hits long")
        self.robots = handle.getValueState("robots", "ever boolean")
        self.until = handle.getValueState("until", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = {int(k[0]): int(v[0]) for k, v in self.hours.iterator()}
        ever = bool(self.robots.exists() and self.robots.get()[0])
        new, fetched, latest = dict(known), ever, 0
        for frame in rows:
            for h, n in frame["hour"].value_counts().items():
                new[int(h)] = new.get(int(h), 0) + int(n)
            fetched, latest = fetched or bool(frame["robots"].any()), max(latest, int(frame["at"].max()))
            out = frame[["payload"]].copy()
            for h in range(24):
                out[f"b{h}"] = known.get(h, 0)
            out["ever_before"] = ever
            yield out
        for h, n in new.items():
            self.hours.updateValue((h,), (n,))
        self.robots.update((fetched,))
        was = int(self.until.get()[0]) if self.until.exists() else None
        until = max(latest + MEMORY_DAYS * 86_400_000, was or 0)
        if until != was:
            if was is not None:
                self.handle.deleteTimer(was)
            self.handle.registerTimer(until)
            self.until.update((until,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.hours, self.robots, self.until):
            state.clear()
        return iter([])

    def close(self) -> None:
        pass


def remembering(closed: DataFrame) -> DataFrame:
    """Requests of a stream (``closes`` is their watermarked time) with b0..b23 and ever_before, their client's memory before
    this micro-batch."""
    kept = [c for c in COLUMNS if c != "ts"]
    schema = closed.select(*kept).schema
    hour, payload = F.hour(F.timestamp_micros("us")), F.to_json(F.struct(*kept))
    robots = F.coalesce(F.col("url_path") == "/robots.txt", F.lit(False))
    at = F.floor(F.col("us") / 1000)
    slim = keyed(closed.withColumn("payload", payload)).select(*detect.ENTITY, "closes", hour.alias("hour"), at.alias("at"), robots.alias("robots"), "payload")
    fields = ", ".join(["payload string", *[f"{b} long" for b in HOURS], "ever_before boolean"])
    told = slim.groupBy(*detect.ENTITY).transformWithStateInPandas(Memory(), fields, "Append", "EventTime")
    out = told.select(F.from_json("payload", schema).alias("r"), *HOURS, "ever_before").select("r.*", *HOURS, "ever_before")
    return out.withColumn("ts", F.timestamp_micros("us"))


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """A query that starts inside keeps its state in RocksDB, which keyed memory needs; the session's own setting holds after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, was)


class Tables:
    """Tables of a live service, one folder for each batch, of some below their days."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _there(self, path: str) -> bool:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)

    def put(self, df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch}")

    def put_days(self, df: DataFrame, name: str, batch: int, at: str) -> None:
        """Rows by the day of ``at`` and batch; folders of this batch are replaced, others stay."""
        rows = df.withColumn("day", F.floor(F.col(at) / 86400)).withColumn("batch", F.lit(batch))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{self.root}/{name}")

    def get(self, name: str, before: int) -> DataFrame | None:
        """What earlier batches wrote; None if there is nothing."""
        if not self._there(f"{self.root}/{name}"):
            return None
        return self.spark.read.parquet(f"{self.root}/{name}").where(F.col("batch") < before).drop("batch")

    def get_days(self, name: str, before: int, since: int) -> DataFrame | None:
        """What earlier batches wrote of days from that of the second ``since`` on: other days' folders are not listed."""
        days = [f"{self.root}/{name}/day={d}" for d in range(since // 86400, since // 86400 + HORIZON_S // 86400 + 3)]
        there = [d for d in days if self._there(d)]
        if not there:
            return None
        return self.spark.read.option("basePath", f"{self.root}/{name}").parquet(*there).where(F.col("batch") < before).drop("batch", "day")

    def put_snapshot(self, df: DataFrame, name: str, batch: int) -> None:
        """The state after a batch; the one before it stays for a batch that runs again, older ones go."""
        self.put(df, name, batch)
        old = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/batch={batch - 2}")
        old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)

    def get_snapshot(self, name: str, before: int) -> DataFrame | None:
        """The state after the batch before."""
        folder = f"{self.root}/{name}/batch={before - 1}"
        return self.spark.read.parquet(folder) if self._there(folder) else None


class Live:
    """Scores micro-batches with the serving bundles of all use cases, exporters first."""

    def __init__(self, spark: SparkSession, root: str, *bundles: Bundle, mode: str = "live", drift_s: float = DRIFT_S):
        by_name = {b.usecase: b for b in bundles}
        self.tables, self.bundles, self.mode = Tables(spark, root), [by_name[n] for n in usecases.in_order([*by_name])], mode
        self.window_s = self.bundles[-1].metadata["window_s"]
        self.drift_s, self.drift_at = drift_s, time.monotonic()

    def batch(self, requests: DataFrame, number: int) -> None:
        requests = requests.persist()
        try:
            if not requests.isEmpty():
                self.score(requests, number)
            elif (robots := self.tables.get_snapshot("robots", number)) is not None:
                self.tables.put_snapshot(robots, "robots", number)
        finally:
            requests.unpersist()

    def score(self, requests: DataFrame, number: int) -> None:
        t, held = self.tables, []

        def once(df: DataFrame) -> DataFrame:
            """Computed once for all that this batch writes, and released at its end."""
            held.append(df.persist())
            return held[-1]

        known = None
        if "ever_before" in requests.columns:  # a client's rows all carry the same memory
            memory = keyed(requests).groupBy(*detect.ENTITY).agg(*[F.max(b).alias(b) for b in HOURS], F.max("ever_before").alias("ever_before"))
            known, requests = once(memory), requests.drop(*HOURS, "ever_before")
        robots = t.get_snapshot("robots", number)
        first = requests.agg(F.min("epoch")).first()[0] - HORIZON_S
        logs, docs, export = [], [], None
        try:
            for bundle in self.bundles:
                name = bundle.usecase
                rows = once(detection.score_windows(window_features(requests, bundle.profile, self.window_s, known, robots), bundle))
                t.put_days(rows, f"scored_{name}", number, "window_end")
                before = t.get_days(f"scored_{name}", number, first)
                new = rows.withColumn("_new", F.lit(True))
                both = new if before is None else new.unionByName(before.where(F.col("window_end") > first).withColumn("_new", F.lit(False)))
                judged = once(detection.judged(both, bundle, export))
                told = usecases.named(name).annotate(judged)
                export = export if told is None else told
                sent = once(detection.alerts(judged, bundle).where("_new"))
                docs.append(detect.alert_documents(sent, name, bundle.version, sorted(bundle.models)))
                logs.append(detection.dispositions(judged.where("_new"), sent, name))
            if self.mode != "observe":
                documents = reduce(DataFrame.unionByName, docs)
                t.put(reduce(DataFrame.unionByName, logs), "log", number)
                # In shadow mode everything is judged and nothing is delivered.
                t.put(documents if self.mode == "live" else documents.where("false"), "alerts", number)
            seen = family_robots(keyed(requests))
            if robots is not None:
                seen = seen.unionByName(robots).groupBy("server", "family").agg(F.min("since").alias("since"))
            t.put_snapshot(seen, "robots", number)
            self.check_drift(number)
        finally:
            for df in held:
                df.unpersist()

    def check_drift(self, number: int) -> None:
        """Once in DRIFT_S seconds of the service's time: reports of all bundles, a row each."""
        if time.monotonic() - self.drift_at < self.drift_s:
            return
        self.drift_at = time.monotonic()
        reports = [drift_check(self, b).withColumn("usecase", F.lit(b.usecase)).withColumn("at", F.lit(int(time.time()))) for b in self.bundles]
        self.tables.put(reduce(DataFrame.unionByName, reports), "drift", number)

    def start(self, stream: DataFrame, checkpoint: str, window_s: int | None = None, once: bool = False, grace_s: int = fixed.GRACE_S) -> StreamingQuery:
        """Follow a stream; the checkpoint holds position, open windows and clients' memory."""
        rows = remembering(closed_requests(stream, window_s or self.window_s, grace_s))
        writer = rows.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint)
        with state_in_rocksdb(self.tables.spark):
            return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def drift_check(live: Live, bundle: Bundle, newest: int = 4000, least: int = 50) -> DataFrame:
    """Stability of the newest scored windows against the bundle's reference: a batch job on its own schedule."""
    rows = live.tables.get(f"scored_{bundle.usecase}", 2**31 - 1).drop("day").orderBy(F.desc("window_end")).limit(newest)
    current = long_form(rows, [], tuple(c for c in bundle.features if c in rows.columns))
    enough = current.groupBy("feature").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("feature")
    return drift_report(stability(bundle.reference, current.join(F.broadcast(enough), "feature", "left_semi")))


class Health(StreamingQueryListener):
    """Keeps the last progress of each query (rows in, rows dropped as late, batch), and writes it to a file if one is named."""

    def __init__(self, path: str | None = None) -> None:
        self.last: dict[str, dict] = {}
        self.path = path

    def write(self) -> None:
        """The snapshot replaces the one before at once, never half-written."""
        if self.path:
            with open(f"{self.path}.tmp", "w", encoding="utf-8") as f:
                json.dump({"at": int(time.time()), "queries": self.last}, f)
            os.replace(f"{self.path}.tmp", self.path)

    def onQueryStarted(self, event) -> None:
        self.last[str(event.id)] = {"status": "started"}

    def onQueryProgress(self, event) -> None:
        p = event.progress
        late = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        self.last[str(p.id)] = {"status": "running", "batch": p.batchId, "rows": p.numInputRows, "late": late}
        self.write()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.last[str(event.id)] = {"status": "failed" if event.exception else "stopped", "reason": event.exception}
        self.write()


def drain(query: StreamingQuery, wait_s: float = 600.0) -> None:
    """Stop when the running batch has ended, whatever still arrives: the checkpoint holds the rest for the next start."""
    begun = query.lastProgress.batchId if query.lastProgress else -1
    until = time.monotonic() + wait_s
    while query.isActive and time.monotonic() < until:
        done = query.lastProgress.batchId if query.lastProgress else -1
        if done > begun or not query.status["isTriggerActive"]:
            break
        time.sleep(0.05)
    query.stop()


def sessions(stream: DataFrame, gap_s: int = fixed.SESSION_GAP_S, grace_s: int = fixed.GRACE_S) -> DataFrame:
    """Sessions of a stream that have ended: client, start, last request, number of requests."""
    rows = keyed(stream.where(is_request(F.col("event_type_ecs"))).withWatermark("ts", f"{grace_s} seconds"))
    got = rows.groupBy(*detect.ENTITY, F.session_window("ts", f"{gap_s} seconds").alias("w")).agg(F.count("*").alias("event_count"), F.max("us").alias("last_us"))
    return got.select(*detect.ENTITY, F.unix_micros("w.start").alias("start_us"), "last_us", "event_count")
