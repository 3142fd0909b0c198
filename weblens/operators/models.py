"""Unsupervised and weakly supervised models of windows, fitted and applied as Spark jobs."""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from weblens import plugins
from weblens.operators import density, neighbours
from weblens.operators.lineage import cut

TREES, PSI, SEED = 200, 256, 7
#: Neighbours, and queries of the clusters that are compared with their rows at once.
LOF_K, LOF_STEP = 20, 256
LEAST_MINORITY, FOLDS = 15, 3
#: The mixture: rows that it starts from, rounds at most, least gain of a round in log likelihood a row, least variance.
START, ROUNDS, TOLERANCE, LEAST_VARIANCE = 2048, 100, 1e-3, 1e-4


# Isolation forest: each tree isolates a sample of PSI rows by random cuts; what is isolated early is anomalous.


def grow(x: np.ndarray, rng: np.random.Generator) -> list[tuple[int, float, int, int, float]]:
    """Nodes (feature, cut, left, right, path length); a leaf has feature -1 and the mean path length below it."""
    limit = math.ceil(math.log2(max(2, len(x))))
    nodes: list = []

    def build(rows: np.ndarray, deep: int) -> int:
        at = len(nodes)
        nodes.append(None)
        spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else []
        if deep >= limit or not len(spread):
            nodes[at] = (-1, 0.0, 0, 0, deep + mean_path(len(rows)))
            return at
        f = int(rng.choice(spread))
        cut = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
        left = rows[:, f] < cut
        nodes[at] = (f, cut, build(rows[left], deep + 1), build(rows[~left], deep + 1), 0.0)
        return at

    build(x, 0)
    return nodes


def mean_path(n: int) -> float:
    """The mean length of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def walked(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Feature, cut, children (left and right of each in turn) and path length of a tree's nodes, and how deep it is."""
    leaf, own = nodes[:, 0] < 0, np.arange(len(nodes))
    children = np.where(leaf[:, None], own[:, None], nodes[:, 2:4]).astype(np.intp)
    deep, level = 0, np.zeros(1, np.intp)
    while not leaf[level].all():
        deep, level = deep + 1, np.unique(children[level])
    return np.where(leaf, 0, nodes[:, 0]).astype(np.intp), nodes[:, 1].copy(), children.ravel(), nodes[:, 4].copy(), deep


class IsolationForest:
    def __init__(self, features: list[str], trees: list[np.ndarray], psi: int):
        self.features, self.trees, self.psi = features, trees, psi

    @classmethod
    def fit(cls, rows: DataFrame, features: list[str], trees: int = TREES, psi: int = PSI, seed: int = SEED) -> "IsolationForest":
        """Each row is dealt to trees by a hash of the whole row; a tree keeps the psi least, and grows in a task of its own.

        Some 8 * psi rows are dealt to each tree: a row gets as many places as its share of them, the first by its hash and
        the others after it, so a row is only written as often as it is dealt, and equal features don't go the same way.
        """
        n = rows.count()
        places = min(float(trees), 8 * psi * trees / max(1, n))
        named = rows.select(*[F.col(c).cast("double").alias(c) for c in features], F.xxhash64(*rows.columns).alias("_tie"))
        first = F.xxhash64(F.lit(seed), "_tie")
        chosen = named.where(F.pmod(first, F.lit(1 << 40)) < int(places * (1 << 40))) if places < 1 else named
        start = F.pmod(F.shiftright(first, 40), F.lit(trees))
        dealt = chosen.withColumn("tree", F.explode(F.transform(F.sequence(F.lit(0), F.lit(math.ceil(places) - 1)), lambda i: F.pmod(start + i, F.lit(trees)).cast("int"))))
        dealt = dealt.withColumn("_u", F.xxhash64(F.lit(seed), "tree", "_tie"))

        def build(frame: pd.DataFrame) -> pd.DataFrame:
            tree = int(frame.tree.iloc[0])
            least = frame.sort_values(["_u", *features], kind="stable").head(psi)
            nodes = grow(least[features].to_numpy(float), np.random.default_rng([seed, tree]))
            return pd.DataFrame({"tree": tree, "psi": len(least), "nodes": [np.array(nodes, dtype=float).tobytes()]})

        got = sorted(dealt.groupBy("tree").applyInPandas(build, "tree int, psi int, nodes binary").collect())  # one row a tree
        return cls(list(features), [np.frombuffer(r.nodes).reshape(-1, 5) for r in got], max((r.psi for r in got), default=1))

    def save(self, spark: SparkSession, folder: str) -> dict:
        trees = [(i, bytearray(np.ascontiguousarray(t).tobytes())) for i, t in enumerate(self.trees)]
        spark.createDataFrame(trees, "tree int, nodes binary").coalesce(1).write.parquet(folder)
        return {"features": self.features, "psi": self.psi}

    @classmethod
    def load(cls, spark: SparkSession, folder: str, told: dict) -> "IsolationForest":
        trees = sorted((r.tree, bytes(r.nodes)) for r in spark.read.parquet(folder).collect())  # a fixed number
        return cls(told["features"], [np.frombuffer(t).reshape(-1, 5) for _, t in trees], told["psi"])

    def score(self, rows: DataFrame, out: str = "iforest") -> DataFrame:
        """Rows with a score near 1 for what is isolated early; the forest is of fixed size and broadcast.

        A leaf is its own child, so all rows of a batch go as many steps as a tree is deep.
        """
        shared = rows.sparkSession.sparkContext.broadcast((self.trees, mean_path(self.psi) or 1.0))

        @pandas_udf("double")
        def apply(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            trees, normal = shared.value
            walks = [walked(nodes) for nodes in trees]
            for columns in batches:
                x = np.concatenate([c.to_numpy(float) for c in columns])
                rows_ = np.arange(len(columns[0]))
                total = np.zeros(len(rows_))
                for feature, cuts, children, path, deep in walks:
                    at = np.zeros(len(rows_), dtype=np.intp)
                    for _ in range(deep):
                        right = ~(x[feature[at] * len(rows_) + rows_] < cuts[at])
                        at = children[2 * at + right]
                    total = total + path[at]
                # One at a time: numpy's powers of arrays differ in the last bit from those of single numbers on some processors.
                yield pd.Series([math.pow(2.0, e) for e in (-(total / max(1, len(trees))) / normal).tolist()], dtype=float)

        return rows.withColumn(out, apply(*[F.col(c).cast("double") for c in self.features]))


# Local outlier factor.


def lof_scores(rows: DataFrame, features: list[str], k: int | None = None, reference: DataFrame | None = None, scale: bool = False) -> DataFrame:
    """(id, lof) of rows (id, features): how much sparser a row lies than its neighbours in a reference of any size.

    Without a reference the rows are their own. Neighbours are exact; see ``neighbours`` for what is skipped. With ``scale``
    features are first put on the reference's scale. A row without any other in the reference has no score.
    """
    same = reference is None or reference is rows
    if scale:
        rows, reference = neighbours.scaled(rows, features, reference), None if same else neighbours.scaled(reference, features)
    reference = rows if same else reference
    k = k or min(LOF_K, max(2, reference.count() - 1))
    near_r = cut(neighbours.nearest(reference, reference, features, k))
    reach_r = near_r.groupBy("q").agg(F.max("d").alias("kd")).withColumnRenamed("q", "r")
    density = near_r.join(reach_r, "r").groupBy("q").agg((1.0 / (F.avg(F.greatest("d", "kd")) + 1e-10)).alias("lrd"))
    near_q = near_r if same else neighbours.nearest(rows, reference, features, k)
    own = near_q.join(reach_r, "r").groupBy("q").agg((1.0 / (F.avg(F.greatest("d", "kd")) + 1e-10)).alias("own"))
    around = near_q.join(density.withColumnRenamed("q", "r").withColumnRenamed("lrd", "theirs"), "r").groupBy("q").agg(F.avg("theirs").alias("theirs"))
    return own.join(around, "q").select(F.col("q").alias("id"), (F.col("theirs") / F.col("own")).alias("lof"))


# Mixture of behaviours, each with its share of declared bots.


def log_parts(x: np.ndarray, parts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Log of weight times density of each row under each part of a mixture with diagonal covariances."""
    weights, means, spread = parts
    far = ((x[:, None, :] - means[None]) ** 2 / spread[None]).sum(axis=2)
    return np.log(weights)[None] - 0.5 * (far + np.log(2 * math.pi * spread).sum(axis=1)[None])


def shared_out(logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Responsibilities of the parts for each row, and the row's log likelihood."""
    top = logs.max(axis=1, keepdims=True)
    raised = np.exp(logs - top)
    total = raised.sum(axis=1, keepdims=True)
    return raised / total, (top + np.log(total))[:, 0]


def moments(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """A row a part: its weight, and the weighted sums of the features and of their squares."""
    return np.column_stack([by.sum(axis=0), by.T @ x, by.T @ (x * x)])


def parts_of(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and variances from moments."""
    width, mass = (sums.shape[1] - 1) // 2, sums[:, :1] + 1e-12
    means = sums[:, 1 : 1 + width] / mass
    return mass[:, 0] / mass.sum(), means, np.maximum(sums[:, 1 + width :] / mass - means**2, 0.0) + LEAST_VARIANCE


def first_parts(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the rounds over all rows begin: k means of a sample, each drawn far from those before."""
    centres = x[[rng.integers(len(x))]]
    for _ in range(k - 1):
        d = ((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1)
        centres = np.vstack([centres, x[rng.choice(len(x), p=d / d.sum()) if d.sum() else rng.integers(len(x))]])
    for _ in range(10):
        own = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([x[own == i].mean(axis=0) if (own == i).any() else centres[i] for i in range(k)])
    return parts_of(moments(x, np.eye(k)[own]))


class BotMixture:
    """Likeness to bots: responsibilities of the mixture's parts, weighted by the share of declared bots in each.

    ``shape`` holds the features' means and deviations; ``parts`` the weights, means and variances of the parts (diagonal covariances).
    """

    def __init__(self, features: list[str], shape: list, parts: list, shares: list[float]):
        self.features, self.shares = list(features), list(shares)
        self.shape, self.parts = tuple(np.array(v, dtype=float) for v in shape), tuple(np.array(v, dtype=float) for v in parts)

    @classmethod
    def fit(cls, rows: DataFrame, features: list[str], label: str = "bot_declared_bot", most: int = 8, seed: int = SEED) -> "BotMixture":
        """The number of parts, 1 to ``most``, is the one of least BIC.

        All numbers of parts are fitted at once: each round is one pass over the rows, from which a task returns sums of fixed
        size. Rounds begin at means of START rows with the least hashes; they and all that follows them see all rows.
        """
        width = len(features)
        data = rows.select(F.array(*[F.col(c).cast("double") for c in features]).alias("x"), F.coalesce(F.col(label).cast("double"), F.lit(0.0)).alias("y")).persist()
        told = data.agg(F.count("*").alias("n"), *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(width)], *[F.stddev_pop(F.col("x")[i]).alias(f"d{i}") for i in range(width)]).first()
        if not told.n:
            data.unpersist()
            raise ValueError("a mixture needs rows")
        shape = np.array([told[f"m{i}"] for i in range(width)]), np.array([told[f"d{i}"] for i in range(width)]) + 1e-9
        start = (np.array([r.x for r in data.orderBy(F.xxhash64("x", F.lit(seed)), "x").limit(START).select("x").collect()]) - shape[0]) / shape[1]
        found = {k: first_parts(start, k, np.random.default_rng([seed, k])) for k in range(1, max(1, min(most, told.n // 10)) + 1)}

        def sums(models: dict[int, tuple]) -> dict[int, tuple[float, np.ndarray]]:
            """By number of parts: log likelihood, and for each part its moments and its mass of declared bots."""

            def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                held = dict.fromkeys(models, 0.0)
                for b in batches:
                    if not b.num_rows:
                        continue
                    x = (np.asarray(b.column(0).flatten(), dtype=float).reshape(-1, width) - shape[0]) / shape[1]
                    y = np.asarray(b.column(1), dtype=float)
                    for k, m in models.items():
                        by, likely = shared_out(log_parts(x, m))
                        held[k] = held[k] + np.append(np.column_stack([moments(x, by), by.T @ y]).ravel(), likely.sum())
                for k, v in held.items():
                    if not np.isscalar(v):
                        yield pa.RecordBatch.from_arrays([pa.array([k] * len(v), pa.int32()), pa.array(range(len(v)), pa.int32()), pa.array(v)], names=["k", "at", "v"])

            out: dict[int, np.ndarray] = {k: np.zeros(k * (2 * width + 2) + 1) for k in models}
            for r in data.mapInArrow(step, "k int, at int, v double").groupBy("k", "at").agg(F.sum("v").alias("v")).collect():  # a fixed number
                out[r.k][r.at] = r.v
            return {k: (v[-1], v[:-1].reshape(k, -1)) for k, v in out.items()}

        open_, last, done = dict(found), {}, {}
        for turn in range(ROUNDS + 1):
            for k, (likely, got) in sums(open_).items():
                if turn == ROUNDS or (k in last and abs(likely - last[k]) / told.n < TOLERANCE):
                    done[k] = (likely, found[k], got)
                    del open_[k]
                else:
                    last[k], found[k] = likely, parts_of(got[:, :-1])
                    open_[k] = found[k]
            if not open_:
                break
        data.unpersist()
        bic = {k: -2 * d[0] + (k - 1 + 2 * k * width) * math.log(told.n) for k, d in done.items()}
        _, parts, got = done[min(bic, key=lambda k: (bic[k], k))]
        return cls(features, shape, parts, [float(b / w) if w > 0 else 0.0 for w, b in got[:, [0, -1]]])

    def save(self, spark: SparkSession, folder: str) -> dict:
        return {"features": self.features, "shape": [v.tolist() for v in self.shape], "parts": [v.tolist() for v in self.parts], "shares": self.shares}

    @classmethod
    def load(cls, spark: SparkSession, folder: str, told: dict) -> "BotMixture":
        return cls(told["features"], told["shape"], told["parts"], told["shares"])

    def score(self, rows: DataFrame, out: str = "gmm") -> DataFrame:
        shape, parts, shares = self.shape, self.parts, np.array(self.shares)

        @pandas_udf("double")
        def apply(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for columns in batches:
                x = (np.column_stack([c.to_numpy(float) for c in columns]) - shape[0]) / shape[1]
                yield pd.Series(shared_out(log_parts(x, parts))[0] @ shares)

        return rows.withColumn(out, apply(*[F.col(c).cast("double") for c in self.features]))


# Boosted trees for P(declares itself a bot | behaviour), made a probability by isotonic regression on scores out of fold.


def assembled(rows: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="keep").transform(rows)


class BotTrees:
    def __init__(self, model, isotonic, constant: float | None, features: list[str]):
        self.model, self.isotonic, self.constant, self.features = model, isotonic, constant, features

    @classmethod
    def fit(cls, rows: DataFrame, features: list[str], label: str = "bot_declared_bot", seed: int = SEED) -> "BotTrees":
        """One class: a constant. A thin minority: raw probabilities. Else calibrated on folds by hash."""
        data = assembled(rows, features).select("_x", F.col(label).cast("double").alias("label"), F.pmod(F.xxhash64(*features), F.lit(FOLDS)).alias("fold")).cache()
        got = {r.label: r["count"] for r in data.groupBy("label").count().collect()}  # two rows
        if len(got) < 2:
            return cls(None, None, float(next(iter(got), 0.0)), list(features))
        learner = GBTClassifier(featuresCol="_x", seed=seed, maxIter=20, maxDepth=4)
        isotonic = None
        if min(got.values()) >= LEAST_MINORITY:
            parts = []
            for f in range(FOLDS):
                rest = data.where(F.col("fold") != f)
                if rest.select("label").distinct().count() == 2:
                    parts.append(learner.fit(rest).transform(data.where(F.col("fold") == f)).select(vector_to_array("probability")[1].alias("p"), "label"))
            if parts:
                out = parts[0]
                for x in parts[1:]:
                    out = out.union(x)
                isotonic = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="_i").fit(out)
        model = learner.fit(data)
        data.unpersist()
        return cls(model, isotonic, None, list(features))

    def save(self, spark: SparkSession, folder: str) -> dict:
        for part, name in ((self.model, folder), (self.isotonic, f"{folder}_isotonic")):
            if part is not None:
                part.write().save(name)
        return {"features": self.features, "constant": self.constant, "isotonic": self.isotonic is not None}

    @classmethod
    def load(cls, spark: SparkSession, folder: str, told: dict) -> "BotTrees":
        model = GBTClassificationModel.load(folder) if told["constant"] is None else None
        return cls(model, IsotonicRegressionModel.load(f"{folder}_isotonic") if told["isotonic"] else None, told["constant"], told["features"])

    def score(self, rows: DataFrame, out: str = "gbm_bot") -> DataFrame:
        if self.model is None:
            return rows.withColumn(out, F.lit(self.constant))
        got = self.model.transform(assembled(rows, self.features)).withColumn("p", vector_to_array("probability")[1]).drop("_x", "probability", "rawPrediction", "prediction")
        if self.isotonic is None:
            return got.withColumnRenamed("p", out)
        return self.isotonic.transform(got).withColumnRenamed("_i", out).drop("p")


# Known crawlers: density clusters in which declared bots are the majority.


class CrawlerClusters:
    """How firmly a row belongs to a cluster of declared bots, 0 outside.

    ``rows`` are the fitted ones in deviations (``shape``: means and deviations), ``core`` how far each has its k-th other,
    ``label`` the cluster of each, ``born`` and ``last`` the clusters' densities, ``bots`` whether bots are their majority.
    """

    #: Rows that are fitted at most, those with the least hashes: a documented bound of the tree and of what is broadcast.
    FIT_ROWS, LEAST, MAJORITY = 20_000, 10, 0.5

    def __init__(self, features: list[str], shape: list, k: int, rows: list, core: list, label: list, born: list, last: list, bots: list[bool]):
        self.features, self.k, self.bots = list(features), k, list(bots)
        self.shape = tuple(np.array(v, dtype=float) for v in shape)
        self.rows = np.array(rows, dtype=float).reshape(-1, len(self.features))
        self.core, self.born, self.last, self.label = (np.array(v, dtype=t) for v, t in ((core, float), (born, float), (last, float), (label, np.int64)))

    @classmethod
    def fit(cls, rows: DataFrame, features: list[str], label: str = "bot_declared_bot", least: int = LEAST, most: int = FIT_ROWS, seed: int = SEED) -> "CrawlerClusters":
        spark = rows.sparkSession
        x = F.array(*[F.col(c).cast("double") for c in features])
        named = rows.select(x.alias("x"), F.coalesce(F.col(label).cast("double"), F.lit(0.0)).alias("y"), F.xxhash64(F.lit(seed), *rows.columns).alias("u"))
        got = named.orderBy("u", "x", "y").limit(most).collect()  # no more rows than the bound
        if not got:
            raise ValueError("clusters need rows")
        raw, bot = np.array([r.x for r in got], dtype=float), np.array([r.y >= 0.5 for r in got])
        shape = raw.mean(axis=0), raw.std(axis=0) + 1e-9
        points = (raw - shape[0]) / shape[1]
        core = density.core_distances(spark, points, least)
        found = density.condensed(len(points), *density.spanning_tree(spark, points, core), least)
        bots = [bool(bot[found.label == i].mean() > cls.MAJORITY) for i in range(len(found.born))]
        return cls(features, list(shape), least, points, core, found.label, found.born, found.last, bots)

    def strengths(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        if not len(self.born) or not any(self.bots):
            return out
        for i in range(0, len(x), LOF_STEP):
            at, dense = density.nearest_by_reach((x[i : i + LOF_STEP] - self.shape[0]) / self.shape[1], self.rows, self.core, self.k)
            cluster = self.label[at]
            inside = (cluster >= 0) & (dense >= self.born[cluster]) & np.array(self.bots)[cluster]
            out[i : i + LOF_STEP] = np.where(inside, np.minimum(dense / self.last[cluster], 1.0), 0.0)
        return out

    def score(self, rows: DataFrame, out: str = "hdbscan_cluster") -> DataFrame:
        """The fitted rows are of bounded number and broadcast."""
        shared = rows.sparkSession.sparkContext.broadcast(self)

        @pandas_udf("double")
        def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for x in batches:
                yield pd.Series(shared.value.strengths(np.array(x.tolist(), dtype=float).reshape(-1, len(shared.value.features))))

        return rows.withColumn(out, apply(F.array(*[F.col(c).cast("double") for c in self.features])))

    def save(self, spark: SparkSession, folder: str) -> dict:
        rows = [(i, x.tolist(), float(c), int(n)) for i, (x, c, n) in enumerate(zip(self.rows, self.core, self.label, strict=True))]
        spark.createDataFrame(rows, "id long, x array<double>, core double, label long").coalesce(1).write.parquet(folder)
        return {"features": self.features, "shape": [v.tolist() for v in self.shape], "k": self.k, "born": self.born.tolist(), "last": self.last.tolist(), "bots": self.bots}

    @classmethod
    def load(cls, spark: SparkSession, folder: str, told: dict) -> "CrawlerClusters":
        got = sorted(spark.read.parquet(folder).collect(), key=lambda r: r.id)  # no more rows than FIT_ROWS
        return cls(told["features"], told["shape"], told["k"], [r.x for r in got], [r.core for r in got], [r.label for r in got], told["born"], told["last"], told["bots"])


#: Models by the name that a bundle keeps of their kind. A model has fit, score, save (which returns what the bundle's own
#: description holds) and load; a deployment registers more.
for _name, _model in (("iforest", IsolationForest), ("mixture", BotMixture), ("trees", BotTrees), ("clusters", CrawlerClusters)):
    _model.kind = _name
    plugins.register("model", _name)(_model)
