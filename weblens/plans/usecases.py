"""Use cases: what each looks at, which models it fits, when it fires, and what it tells the others.

A use case is a set of column expressions over windows. A deployment adds one by registering a subclass of ``UseCase``; nothing
else has to know its name.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weblens import plugins
from weblens.functions import fixed
from weblens.operators import detect, models, scoring
from weblens.operators.features import complete
from weblens.sources.canaries import scan_canary, spoof_canary


class UseCase:
    """The base: an isolation forest over ``features``, fired by a gate on the fused percentile."""

    name = title = rule = ""
    features: tuple[str, ...] = ()
    depends_on: tuple[str, ...] = ()
    skipped: tuple[str, ...] = ()
    #: Models that vote on the gate and are calibrated on ``calibration_rows``; others only say more of a client. Empty: all.
    voters: tuple[str, ...] = ()
    gate_pct = 0.995

    def vector(self, windows: DataFrame, stats: DataFrame) -> tuple[DataFrame, list[str]]:
        """Complete rows and the columns that the models see."""
        return complete(windows, self.features), list(self.features)

    def fit(self, rows: DataFrame, features: list[str]) -> dict[str, object]:
        return {"iforest": models.IsolationForest.fit(rows, features)}

    def calibration_rows(self, rows: DataFrame) -> DataFrame:
        return rows

    def votes(self, model: str) -> bool:
        return not self.voters or model in self.voters

    def fuse(self, percentiles: list[str]) -> Column:
        return detect.fused(percentiles)

    def gate(self, scored: DataFrame, window_s: int) -> DataFrame:
        """Rows with ``fired``."""
        return scored.withColumn("fired", F.coalesce(F.col("fused_pct") >= self.gate_pct, F.lit(False)))

    def suppression(self, rows: DataFrame, annotations: DataFrame | None) -> DataFrame:
        """Rows with ``action`` and ``action_reason``; without annotations nothing is held back."""
        return rows.withColumn("action", F.lit(None).cast("string")).withColumn("action_reason", F.lit(None).cast("string"))

    def annotate(self, judged: DataFrame) -> DataFrame | None:
        """What other use cases may know of clients."""
        return None

    def canary(self, spark: SparkSession, server: str, start: int) -> DataFrame:
        """Requests that have to fire."""
        return scan_canary(spark, server, start)


def usecase(cls: type[UseCase]) -> type[UseCase]:
    detect.USECASES[cls.name] = (cls.rule, cls.title)
    plugins.register("usecase", cls.name)(cls())
    return cls


@usecase
class BotDetection(UseCase):
    name, rule, title, gate_pct = "bot_detection", *detect.USECASES["bot_detection"], fixed.BOT_GATE
    features = fixed.BOT_FEATURES
    voters = ("gbm_bot", "gmm")

    def fit(self, rows, features):
        behaviour = list(fixed.BEHAVIOUR)
        return {"gbm_bot": models.BotTrees.fit(rows, behaviour), "gmm": models.BotMixture.fit(rows, behaviour), "hdbscan_cluster": models.CrawlerClusters.fit(rows, behaviour)}

    def calibration_rows(self, rows):
        return scoring.calibration_rows(rows)

    def gate(self, scored, window_s):
        return detect.streaks(scored, "fused_pct", window_s).withColumn("fired", F.col("streak") >= fixed.BOT_STREAK)

    def annotate(self, judged):
        return detect.crawler_export(judged, "gbm_bot", "hdbscan_cluster")

    def canary(self, spark, server, start):
        return spoof_canary(spark, server, start)


@usecase
class WebRecon(UseCase):
    name, rule, title, gate_pct = "web_recon", *detect.USECASES["web_recon"], fixed.RECON_GATE
    features, depends_on = fixed.RECON_FEATURES, ("bot_detection",)

    def vector(self, windows, stats):
        """With what a window's share of 404 has above the population's median."""
        row = stats.where("feature = 'web_ratio_404'").select("p50").first()  # one row
        out = complete(windows, self.features).withColumn("web_ratio_404_delta", F.col("web_ratio_404") - F.lit(row.p50 if row else 0.0))
        return out, [*self.features, "web_ratio_404_delta"]

    def gate(self, scored, window_s):
        return scored.withColumn("fired", F.coalesce(detect.recon_gate(F.col("fused_pct")), F.lit(False)))

    def suppression(self, rows, annotations):
        if annotations is None:
            return super().suppression(rows, annotations)
        return detect.suppression(detect.as_of(rows, annotations, ["human_likeness", "is_known", "is_verified", "robots_txt"]))


def named(name: str) -> UseCase:
    return plugins.get("usecase", name)


def in_order(names: list[str]) -> list[str]:
    """Exporters before those that read what they export."""
    return plugins.dependency_order({n: named(n).depends_on for n in names})
