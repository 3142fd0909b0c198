"""How distributions and series change: two-sample distances, smoothed and summed deviations, seasonal breaches."""

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblens.operators.lineage import cut
from weblens.operators.quantiles import quantiles


def kolmogorov_smirnov(rows: DataFrame) -> DataFrame:
    """(feature, ks, n_reference, n_current) of rows (feature, value, side: 0 reference, 1 current).

    ks is the greatest distance of the two cumulative distributions, null if a side has no rows. Distinct values with their
    counts lie in sorted ranges, whose sums are chained on the driver (a row for each range and feature in it), so that no
    task holds all values of a feature. Null values don't count.
    """
    sides = [F.count_if(F.col("side") == i).alias(f"n{i}") for i in (0, 1)]
    counts = rows.where("value is not null").groupBy("feature", "value").agg(*sides)
    dealt = counts.repartitionByRange("feature", "value").withColumn("_p", F.spark_partition_id()).persist()
    try:
        sums = sorted(map(tuple, dealt.groupBy("feature", "_p").agg(F.sum("n0"), F.sum("n1")).collect()))
        total: dict[str, tuple[int, int]] = {}
        before = []
        for feature, p, a, b in sums:
            was = total.get(feature, (0, 0))
            before.append((feature, p, *was))
            total[feature] = was[0] + a, was[1] + b
        starts = rows.sparkSession.createDataFrame([(*r, *total[r[0]]) for r in before], "feature string, _p int, b0 long, b1 long, t0 long, t1 long")
        w = Window.partitionBy("feature", "_p").orderBy("value")
        upto = [((F.col(f"b{i}") + F.sum(f"n{i}").over(w)) / F.col(f"t{i}")) for i in (0, 1)]
        placed = dealt.join(starts, ["feature", "_p"]).where("t0 > 0 and t1 > 0").select("feature", F.abs(upto[0] - upto[1]).alias("d"))
        found = dict(map(tuple, placed.groupBy("feature").agg(F.max("d")).collect()))  # a row a feature
        return rows.sparkSession.createDataFrame([(f, found.get(f), *t) for f, t in sorted(total.items())], "feature string, ks double, n_reference long, n_current long")
    finally:
        dealt.unpersist()


def jensen_shannon(rows: DataFrame) -> DataFrame:
    """(feature, js) of rows (feature, item, side): the divergence in bits of two distributions over items, null if a side is empty.

    Items are counted by feature before anything meets, so a popular item is one row.
    """
    counts = rows.groupBy("feature", "item").agg(*[F.count_if(F.col("side") == i).alias(f"n{i}") for i in (0, 1)])
    totals = counts.groupBy("feature").agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"))
    p, q = F.col("n0") / F.nullif("t0", F.lit(0)), F.col("n1") / F.nullif("t1", F.lit(0))
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(F.when(x.isNull(), None).otherwise(0.0))
    both = counts.join(totals, "feature").select("feature", (0.5 * part(p) + 0.5 * part(q)).alias("j"))
    return both.groupBy("feature").agg(F.sum("j").alias("js"))


def smoothed(rows: DataFrame, order: list[str], alpha: float = 0.3) -> DataFrame:
    """Rows (series, x, z, ...) with ``ewma`` of x and ``cusum`` of z, along ``order`` within each series.

    ewma starts at the first x and takes ``alpha`` of each next one; cusum is max(0, before + z). Both steps are maps that
    can be composed: an affine one, and the greater of a constant and a shift. Rows lie in sorted ranges, a task composes the
    maps of the series at its edges, the driver chains them (a row a task), and each task then walks from the state before
    it, so that one long series is many tasks. Null x and z leave the state as it is.
    """
    ordered = cut(rows.repartitionByRange("series", *order).sortWithinPartitions("series", *order))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in ("series", "x", "z")), strict=True)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of the first series the maps; of the last one, if it is another, the state.
        first = last = None
        a, b, c, d, e, s, begun = 1.0, 0.0, 0.0, 0.0, None, 0.0, None
        for series, x, z in walk(batches):
            if begun is None:
                begun, first = True, series
            if series != last:
                e, s = None, 0.0
            last = series
            if x is not None:
                if series == first:
                    a, b = a * (1 - alpha), b * (1 - alpha) + alpha * x
                e = x if e is None else alpha * x + (1 - alpha) * e
            if z is not None:
                if series == first:
                    c, d = max(0.0, c + z), d + z
                s = max(0.0, s + z)
        if begun:
            names = ["pid", "first", "last", "a", "b", "c", "d", "e", "s"]
            row = [TaskContext.get().partitionId(), first, last, a, b, c, d, e, s]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, [pa.int32(), pa.string(), pa.string(), *[pa.float64()] * 6], strict=True)], names=names)

    tasks = sorted(ordered.mapInArrow(ends, "pid int, first string, last string, a double, b double, c double, d double, e double, s double").collect(), key=lambda r: r.pid)
    entry, known = {}, (None, None, 0.0)
    for r in tasks:
        e, s = known[1:] if r.first == known[0] else (None, 0.0)
        entry[r.pid] = (r.first, e, s)
        if r.first == r.last:
            known = (r.last, r.e if e is None else r.a * e + r.b, max(r.c, s + r.d))
        else:
            known = (r.last, r.e, r.s)
    shared = rows.sparkSession.sparkContext.broadcast(entry)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, e, s = shared.value.get(TaskContext.get().partitionId(), (None, None, 0.0))
        for b in batches:
            out_e, out_s = [], []
            for series, x, z in walk(iter([b])):
                if series != last:
                    last, e, s = series, None, 0.0
                if x is not None:
                    e = x if e is None else alpha * x + (1 - alpha) * e
                if z is not None:
                    s = max(0.0, s + z)
                out_e.append(e)
                out_s.append(s)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out_e, pa.float64()), pa.array(out_s, pa.float64())], names=[*b.schema.names, "ewma", "cusum"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return ordered.mapInArrow(told, f"{fields}, ewma double, cusum double")


def seasonal_breach(rows: DataFrame) -> DataFrame:
    """(server, hour, actual, p50, p95, p995, breach) of rows (server, epoch, size): what each hour sent, against all hours of
    the same place in the week; breach counts spans between the quartiles above the 99.5 % value, null where the quartiles are one."""
    hours = rows.groupBy("server", F.floor(F.col("epoch") / 3600).alias("hour")).agg(F.sum("size").cast("double").alias("actual"))
    named = hours.withColumn("feature", F.concat_ws("|", "server", F.col("hour") % 168))
    got = quantiles(named.select("feature", F.col("actual").alias("value")), [0.25, 0.5, 0.75, 0.95, 0.995])
    profile = rows.sparkSession.createDataFrame([(f, *q) for f, q in sorted(got.items())], "feature string, p25 double, p50 double, p75 double, p95 double, p995 double")
    out = named.join(profile, "feature")  # 168 rows a server
    return out.select("server", "hour", "actual", "p50", "p95", "p995", ((F.col("actual") - F.col("p995")) / F.nullif(F.col("p75") - F.col("p25"), F.lit(0.0))).alias("breach"))


def sent_within(by: list[str], seconds: int, size: str = "size", at: str = "epoch") -> Column:
    """What a client has sent in the last ``seconds``, its rows of the same second included."""
    return F.sum(size).over(Window.partitionBy(*by).orderBy(at).rangeBetween(-seconds, 0))


class AdaptiveWindow:
    """ADWIN: the mean of a window that is cut at its oldest end when two parts of it differ by more than chance allows.

    Values (from 0 to 1) lie in buckets of 1, 2, 4, ... values, ``WIDTH`` of each size at most, so a window of n takes about
    log n of them; two buckets of one size too many become one of the next. A bucket is its number, sum and sum of squares.
    """

    WIDTH = 5

    def __init__(self, delta: float = 0.002):
        self.delta = delta
        #: Oldest first.
        self.buckets: list[tuple[int, float, float]] = []

    def add(self, x: float) -> bool:
        """Take a value; whether the window was cut."""
        self.buckets.append((1, x, x * x))
        size = 1
        while sum(b[0] == size for b in self.buckets) > self.WIDTH:
            i = next(i for i, b in enumerate(self.buckets) if b[0] == size)
            self.buckets[i : i + 2] = [tuple(a + b for a, b in zip(self.buckets[i], self.buckets[i + 1], strict=True))]
            size *= 2
        cut = False
        while self._differs():
            self.buckets.pop(0)
            cut = True
        return cut

    def _differs(self) -> bool:
        n, total, squares = (sum(b[k] for b in self.buckets) for k in range(3))
        if n < 2:
            return False
        log = math.log(2 * math.log(n + 1) / self.delta)
        variance = max(0.0, squares / n - (total / n) ** 2)
        n0 = s0 = 0.0
        for b in self.buckets[:-1]:
            n0, s0 = n0 + b[0], s0 + b[1]
            m = 1 / (1 / n0 + 1 / (n - n0))
            if abs(s0 / n0 - (total - s0) / (n - n0)) > math.sqrt(2 * variance * log / m) + 2 * log / (3 * m):
                return True
        return False

    @property
    def width(self) -> int:
        return sum(b[0] for b in self.buckets)

    @property
    def mean(self) -> float:
        return sum(b[1] for b in self.buckets) / self.width if self.buckets else 0.0


def adaptive_means(series: DataFrame, delta: float = 0.002) -> DataFrame:
    """(series, at, value, width, mean, changed) of rows (series, at, value): one row a series and step of time, such as hourly
    shares, so that a series is as long as its time and fits a task. Null values are left out."""

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        window, out = AdaptiveWindow(delta), []
        for r in frame.sort_values("at", kind="stable").itertuples(index=False):
            changed = window.add(float(r.value))
            out.append((r.series, r.at, r.value, window.width, window.mean, changed))
        return pd.DataFrame(out, columns=["series", "at", "value", "width", "mean", "changed"])

    rows = series.select("series", F.col("at").cast("long").alias("at"), F.col("value").cast("double").alias("value")).where("value is not null")
    return rows.groupBy("series").applyInPandas(walk, "series string, at long, value double, width long, mean double, changed boolean")
