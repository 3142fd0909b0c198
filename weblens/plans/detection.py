"""Training, scoring and backtests, composed of the operators."""

import hashlib
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weblens.functions import fixed
from weblens.functions.expressions import is_canary
from weblens.operators import detect, models, scoring
from weblens.operators.features import long_form, window_features
from weblens.operators.profile import Profile, learn
from weblens.plans import usecases

ENTITY = detect.ENTITY


class TrainingError(RuntimeError):
    """Too little to learn from."""


@dataclass
class Bundle:
    """What a use case needs to score windows."""

    usecase: str
    version: str
    profile: Profile
    features: list[str]
    stats: DataFrame
    models: dict[str, object]
    grids: dict[str, DataFrame]
    reference: DataFrame
    metadata: dict = field(default_factory=dict)


def vectors(name: str, windows: DataFrame, stats: DataFrame) -> tuple[DataFrame, list[str]]:
    return usecases.named(name).vector(windows, stats)


def feature_code() -> str:
    """The hash of the code that makes features: bundles of different hashes may see different vectors."""
    from weblens.functions import expressions
    from weblens.operators import features as made

    return hashlib.sha256(b"".join(Path(m.__file__).read_bytes() for m in (fixed, expressions, made))).hexdigest()


def train(requests: DataFrame, usecase: str, version: str, window_s: int = fixed.WINDOW_S) -> Bundle:
    """Profile, windows, statistics, hygiene, models and calibration, in this order; the windows are computed once."""
    profile = learn(requests)
    windows = window_features(requests, profile, window_s).persist()
    n = windows.count()
    if n < fixed.LEAST_WINDOWS:
        raise TrainingError(f"{usecase}: {n} windows, {fixed.LEAST_WINDOWS} are needed")
    stats = scoring.feature_stats(long_form(windows, [])).persist()
    rows, features = vectors(usecase, windows, stats)
    rows = scoring.clipped(rows, tuple(features))
    first = models.IsolationForest.fit(rows, features).score(rows, "_anomaly").persist()  # hygiene reads the scores many times
    kept = scoring.without_most_anomalous(first, "_anomaly").drop("_anomaly").persist()
    n_kept = kept.count()  # made here, so that no later task runs this forest beside a model of its own
    first.unpersist()
    case = usecases.named(usecase)
    found, base = case.fit(kept, features), case.calibration_rows(kept)
    grids = {name: scoring.grid(m.score(base if case.votes(name) else kept, "raw"), "raw") for name, m in found.items()}
    reference = long_form(scoring.reference_sample(kept, [*ENTITY, "window_start"]), [], tuple(features)).persist()
    meta = {"usecase": usecase, "rule_id": case.rule, "title": case.title, "feature_code_sha256": feature_code(), "version": version, "train_windows": n, "usable_vectors": rows.count(), "clip_quantile": fixed.CLIP_Q, "windows_dropped": n - n_kept, "models": sorted(found), "window_s": window_s}
    meta["models_skipped"] = list(case.skipped)
    return Bundle(usecase, version, profile, features, stats, found, grids, reference, meta)


def score_windows(windows: DataFrame, bundle: Bundle) -> DataFrame:
    """Windows with each model's raw score and percentile, and the fused percentile."""
    case = usecases.named(bundle.usecase)
    rows, _ = case.vector(windows, bundle.stats)
    for name, model in bundle.models.items():
        rows = scoring.calibrated(model.score(rows, name), name, bundle.grids[name], f"{name}_pct")
    return rows.withColumn("fused_pct", case.fuse([f"{n}_pct" for n in bundle.models if case.votes(n)]))


def judged(scored: DataFrame, bundle: Bundle, annotations: DataFrame | None = None) -> DataFrame:
    """Scored windows with ``fired`` and what others say of the client (joined as of the window)."""
    case = usecases.named(bundle.usecase)
    return case.suppression(case.gate(scored, bundle.metadata["window_s"]), annotations)


def alerts(rows: DataFrame, bundle: Bundle, budget: int | None = fixed.DAILY_BUDGET) -> DataFrame:
    """Fired rows with severity, disposition, top features and narrative."""
    fired = detect.severities(rows.where("fired"), "fused_pct")
    sent = detect.delivery(fired, "fused_pct", budget if budget is not None else 2**31 - 1)
    ids = [*ENTITY, "window_start"]
    top = detect.top_features(long_form(fired, ids, tuple(bundle.features)), bundle.stats, ids)
    return detect.explained(sent, top, ids, detect.USECASES[bundle.usecase][1])


def dispositions(rows: DataFrame, sent: DataFrame, usecase: str) -> DataFrame:
    """The audit log: every scored window, with what became of it."""
    ids = [*ENTITY, "window_start"]
    told = sent.select(*ids, "disposition", "severity_score", "severity")
    return rows.join(told, ids, "left").select(F.lit(usecase).alias("usecase"), *ids, "window_end", "event_count", F.round("fused_pct", 5).alias("fused_pct"), "fired", F.coalesce("disposition", F.lit("scored")).alias("disposition"), "severity_score", "severity", "action_reason")


def all_usecases(requests: DataFrame, bundles: list[Bundle]) -> tuple[DataFrame, DataFrame]:
    """Alerts and log of all use cases in one plan, exporters first."""
    by_name, export, docs, logs = {b.usecase: b for b in bundles}, None, [], []
    for name in usecases.in_order([*by_name]):
        b = by_name[name]
        rows = judged(score_windows(window_features(requests, b.profile, b.metadata["window_s"]), b), b, export)
        told = usecases.named(name).annotate(rows)
        export = export if told is None else told
        sent = alerts(rows, b)
        docs.append(detect.alert_documents(sent, name, b.version, sorted(b.models)))
        logs.append(dispositions(rows, sent, name))
    return reduce(DataFrame.unionByName, docs), reduce(DataFrame.unionByName, logs)


def both_usecases(requests: DataFrame, bots: Bundle, recon: Bundle) -> tuple[DataFrame, DataFrame]:
    return all_usecases(requests, [bots, recon])


def time_span(events: DataFrame) -> DataFrame:
    return events.agg(F.min("epoch").alias("first"), F.max("epoch").alias("last"), F.count("*").alias("n"))


def split_by_time(events: DataFrame, share: float = 0.6) -> tuple[DataFrame, DataFrame, int]:
    """Events before and from the time at which ``share`` of the span has gone."""
    s = time_span(events).first()  # one row
    cut = int(s.first + (s.last - s.first) * share) if s.n else 0
    return events.where(F.col("epoch") < cut), events.where(F.col("epoch") >= cut), cut


def busiest(bundle: Bundle) -> str:
    """The server with most requests of a bundle's profile."""
    most = bundle.profile.path_totals.orderBy(F.desc("n"), "server").first()
    if most is None:
        raise TrainingError(f"{bundle.usecase}: the profile has no server")
    return most.server


def backtest(requests: DataFrame, usecase: str, share: float = 0.6, window_s: int = fixed.WINDOW_S) -> tuple[DataFrame, DataFrame, Bundle]:
    """Train on the first part, score the rest with a canary among it; log, alerts and bundle. No budget applies."""
    before, after, cut = split_by_time(requests, share)
    bundle = train(before, usecase, "backtest", window_s)
    spark, server = requests.sparkSession, busiest(bundle)
    canary = usecases.named(usecase).canary(spark, server, (cut // window_s + 1) * window_s)
    held = after.select(*canary.columns).unionByName(canary)
    rows = judged(score_windows(window_features(held, bundle.profile, window_s), bundle), bundle).persist()
    sent = alerts(rows, bundle, None)
    return dispositions(rows, sent, usecase), sent, bundle


def backtest_report(log: DataFrame) -> DataFrame:
    """One row: windows, fired, delivered, folded, suppressed, servers, days, alerts a day and server, and the canary's fires."""
    of = lambda d: F.count_if(F.col("disposition") == d)
    out = log.agg(
        F.count("*").alias("windows"), F.count_if("fired").alias("fired"), of("delivered").alias("delivered"), of("folded").alias("folded"), of("suppressed").alias("suppressed"),
        F.count_distinct("server").alias("servers"), F.greatest(F.lit(1.0), (F.max("window_end") - F.min("window_end")) / 86400.0).alias("days"), F.count_if(F.col("fired") & is_canary(F.col("source_ip"))).alias("canary_fired"),
    )
    return out.withColumn("per_day_and_server", F.round(F.col("delivered") / F.col("days") / F.greatest(F.col("servers"), F.lit(1)), 4)).withColumn("canary_found", F.col("canary_fired") > 0)


def compared(windows: DataFrame, serving: Bundle, candidate: Bundle) -> DataFrame:
    """One row: how often each of two bundles would fire on the same windows, and how often both."""
    # A window is one row, so the second bundle scores what the first has scored; no key is joined.
    a = score_windows(windows.dropna(subset=[*ENTITY, "window_start"]), serving)
    rows = score_windows(a.select(*windows.columns, F.col("fused_pct").alias("serving_pct")), candidate)
    gate = usecases.named(serving.usecase).gate_pct
    return rows.agg(F.count("*").alias("windows"), F.count_if(F.col("serving_pct") >= gate).alias("serving"), F.count_if(F.col("fused_pct") >= gate).alias("candidate"), F.count_if((F.col("serving_pct") >= gate) & (F.col("fused_pct") >= gate)).alias("both"))


def candidate_check(requests: DataFrame, serving: Bundle, candidate: Bundle, most: float = 3.0) -> DataFrame:
    """One row: fire rates and the canary of both bundles over the same requests, and whether the candidate may serve.

    Not if it misses the canary, or fires more than ``most`` times as often as the serving bundle (1 in 1000 windows at least).
    """
    case, window_s = usecases.named(serving.usecase), serving.metadata["window_s"]
    spark, server = requests.sparkSession, busiest(serving)
    first = requests.agg(F.min("epoch")).first()[0] or 0
    canary = case.canary(spark, server, (first // window_s + 1) * window_s)
    held = requests.select(*canary.columns).unionByName(canary)
    parts = []
    for role, b in (("serving", serving), ("candidate", candidate)):
        rows = judged(score_windows(window_features(held, b.profile, window_s), b), b)
        hit = F.col("fired") & is_canary(F.col("source_ip"))
        parts.append(rows.agg(F.count("*").alias(f"{role}_windows"), (F.count_if(F.col("fired") & ~is_canary(F.col("source_ip"))) / F.greatest(F.count("*"), F.lit(1))).alias(f"{role}_rate"), (F.count_if(hit) > 0).alias(f"{role}_canary")))
    out = parts[0].withColumn("one", F.lit(1)).join(parts[1].withColumn("one", F.lit(1)), "one").drop("one")  # a row each
    fires = F.col("candidate_rate") <= most * F.greatest("serving_rate", F.lit(0.001))
    reason = F.when(~F.col("candidate_canary"), "the canary did not fire").when(~fires, "it fires too often")
    return out.withColumn("approve", F.col("candidate_canary") & fires).withColumn("reason", reason)


def overview(log: DataFrame) -> DataFrame:
    """(usecase, day, windows, fired, delivered, suppressed, folded, digested, fire_rate_pct)."""
    of = lambda d: F.count_if(F.col("disposition") == d)
    rows = log.groupBy("usecase", F.floor(F.col("window_end") / 86400).alias("day"))
    return rows.agg(F.count("*").alias("windows"), F.count_if("fired").alias("fired"), *[of(d).alias(d) for d in ("delivered", "suppressed", "folded", "digested")]).withColumn("fire_rate_pct", F.round(100.0 * F.col("fired") / F.col("windows"), 4))


def tail(log: DataFrame, n: int) -> DataFrame:
    """The newest records first."""
    return log.orderBy(F.desc("window_end"), *ENTITY).limit(n)


def rates(samples: DataFrame) -> DataFrame:
    """Samples (usecase, at, events, fires) of running totals with what came in between, by second."""
    w = Window.partitionBy("usecase").orderBy("at")
    dt = F.col("at") - F.lag("at").over(w)
    return samples.withColumn("rate", (F.col("events") - F.lag("events").over(w)) / F.nullif(dt, F.lit(0))).withColumn("new_fires", F.col("fires") - F.lag("fires").over(w))
