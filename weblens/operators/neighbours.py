"""Exact nearest neighbours in a table, by blocks of rows that lie close to each other and skip each other when far apart.

Rows are keyed by their nearest pivot and their distance from it, sorted by both, and cut into blocks of bounded size, each with its
bounding box. What a row finds in its own block and in a bounded sample bounds its k-th distance; a block then meets only blocks that
the triangle inequality at their pivot and the distance of the boxes leave within the greatest bound of its rows. Bounds only save work.

Blocks that follow each other form groups of bounded bytes. A block is sent once for each group that it meets, not for each block, and
a task that has two groups hands on the k nearest of them for a query, so what is shuffled grows with the number of groups. Products in
single precision name the pairs that may be within a query's bound; only these get their distance, feature by feature in double precision.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblens.operators.lineage import cut

#: Rows of a block, queries that are compared with a block at once, rows of the sample that gives first bounds, pivots among them.
BLOCK, STEP, SAMPLE, PIVOTS = 1024, 256, 2048, 32
#: Bytes of a group's features at most, and groups (if there are as many blocks) that keep all cores busy.
GROUP_BYTES, LEAST_GROUPS = 32 << 20, 6
INNER = "pivot int, low double, high double, box_low array<double>, box_high array<double>, ids binary, x binary"


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, feature by feature, so that a pair has the same one wherever it is computed."""
    d = np.zeros((len(a), len(b)))
    for f in range(a.shape[1]):
        d += (a[:, f, None] - b[None, :, f]) ** 2
    return d


def kth(d: np.ndarray, k: int) -> np.ndarray:
    """The k-th least of each row; infinite where there are fewer."""
    return np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(d), np.inf)


def possible(a: np.ndarray, c: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of a, row of c) of all pairs whose squared distance may be within the bound of a's row, and few others."""
    n, m = (a * a).sum(axis=1), (c * c).sum(axis=1)
    with np.errstate(over="ignore", invalid="ignore"):
        about = a.astype(np.float32) @ c.astype(np.float32).T
        about *= -2
        about += n.astype(np.float32)[:, None]
        about += m.astype(np.float32)[None]
        # What rounding may get wrong in sums of so many products of such lengths; what overflows is left to be computed.
        doubt = (a.shape[1] + 16) * np.finfo(np.float32).eps * (np.sqrt(n) + np.sqrt(m.max(initial=0.0))) ** 2 + 1e-30
        edge = np.nextafter((bound + doubt).astype(np.float32), np.float32(np.inf))
        return np.nonzero((about <= edge[:, None]) | ~np.isfinite(about))


def joined(sides: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, squared distance) of the k nearest of each row of all sides, by row, distance and id."""
    row, ids, d = (np.concatenate(x) for x in zip(*sides, strict=True))
    order = np.lexsort((ids, d, row))
    row, ids, d = row[order], ids[order], d[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], ids[kept], d[kept]


def in_blocks(rows: DataFrame, features: list[str], pivots: np.ndarray) -> DataFrame:
    """(number, pivot, low, high, box_low, box_high, ids, x) of rows (id, features), written; nulls and NaN are 0."""
    spark, width = rows.sparkSession, len(features)
    shared = spark.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column("x").flatten(), dtype=float).reshape(-1, width)
            far = squared(x, shared.value) if b.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(far.argmin(axis=1).astype(np.int32)), pa.array(np.sqrt(far.min(axis=1)))], names=["id", "x", "pivot", "far"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            ids, x, pivot, far = zip(*held, strict=True)
            x = np.array(x, dtype=float)
            values = [pivot[0], min(far), max(far), x.min(axis=0).tolist(), x.max(axis=0).tolist(), np.array(ids, dtype=np.int64).tobytes(), x.tobytes()]
            kinds = [pa.int32(), *[pa.float64()] * 2, *[pa.list_(pa.float64())] * 2, *[pa.binary()] * 2]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=["pivot", "low", "high", "box_low", "box_high", "ids", "x"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("id", "x", "pivot", "far")), strict=True):
                if held and (len(held) == BLOCK or held[0][2] != row[2]):
                    yield block()
                    held = []
                held.append(row)
        if held:
            yield block()

    one = rows.select(F.col("id").cast("long").alias("id"), packed_features(features))
    placed = one.mapInArrow(place, "id long, x array<double>, pivot int, far double")
    order = ("pivot", "far", "id")
    dealt = placed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    return cut(cut(dealt.mapInArrow(packed, INNER)).withColumn("number", F.monotonically_increasing_id()))


def group_of(blocks: DataFrame, width: int) -> Callable[[Column], Column]:
    """The group of a block by its number; numbers ascend within each partition, and the partitions' sizes are chained on the driver."""
    starts, n = {}, 0
    for p, m in sorted((r["p"], r["count"]) for r in blocks.groupBy(F.shiftright("number", 33).alias("p")).count().collect()):  # a row a partition
        starts[p], n = n, n + m
    each = max(1, min(GROUP_BYTES // (8 * BLOCK * max(1, width)), -(-n // LEAST_GROUPS)))
    known = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]) if starts else F.create_map().cast("map<bigint,int>")
    return lambda number: F.floor((F.element_at(known, F.shiftright(number, 33)) + number % (1 << 33)) / each).cast("int")


def packed_features(features: list[str]):
    value = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.array(*[value(c) for c in features]).alias("x")


def nearest(queries: DataFrame, reference: DataFrame, features: list[str], k: int) -> DataFrame:
    """(q, r, d): for each query id its k nearest others of the reference, exactly; equal distances go by the smaller id.

    Ids are unique in either table; a row is no neighbour of its own id. With fewer than k others a query has all of them.
    """
    width, same = len(features), queries is reference
    some = reference.select(F.col("id").cast("long").alias("id"), packed_features(features)).orderBy(F.xxhash64("x", "id"), "id").limit(SAMPLE).collect()
    s_ids, s = np.array([r.id for r in some], dtype=np.int64), np.array([r.x for r in some], dtype=float).reshape(-1, width)
    pivots = np.unique(s[:PIVOTS], axis=0) if len(s) else np.zeros((1, width))
    shared = reference.sparkSession.sparkContext.broadcast((s_ids, s, pivots))
    theirs = in_blocks(reference, features, pivots)
    ours = theirs if same else in_blocks(queries, features, pivots)

    def unpacked(ids: bytes, x: bytes) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(ids, dtype=np.int64), np.frombuffer(x).reshape(-1, width)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block with its rows' bounds (squared), and the distances from each pivot between which it must look."""
        s_ids, s, pivots = shared.value
        for b in batches:
            for number, packed_ids, packed_x in zip(*(b.column(c).to_pylist() for c in ("number", "ids", "x")), strict=True):
                ids, x = unpacked(packed_ids, packed_x)
                bound = np.empty(len(ids))
                for i in range(0, len(ids), STEP):
                    part = slice(i, i + STEP)
                    tries = [(s_ids, s), (ids, x)] if same else [(s_ids, s)]
                    bound[part] = np.min([kth(np.where(ids[part, None] == r[None], np.inf, squared(x[part], y)), k) for r, y in tries], axis=0)
                reach, far = np.sqrt(bound)[:, None], np.sqrt(squared(x, pivots))
                slack = 1e-9 * (1 + far.max())
                low, high = (far - reach).min(axis=0) - slack, (far + reach).max(axis=0) + slack
                arrays = [pa.array([number]), pa.array([bound.tobytes()]), pa.array([float(bound.max())])]
                ranges = [{"pivot": i, "from": lo, "to": hi} for i, (lo, hi) in enumerate(zip(low.tolist(), high.tolist(), strict=True))]
                kind = pa.list_(pa.struct([("pivot", pa.int32()), ("from", pa.float64()), ("to", pa.float64())]))
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([ranges], kind)], names=["number", "bound", "most", "ranges"])

    bounds = cut(ours.select("number", "ids", "x").mapInArrow(bounded, "number long, bound binary, most double, ranges array<struct<pivot:int,from:double,to:double>>"))
    box = lambda df, n: df.select(F.col("number").alias(n), F.col("box_low").alias(f"low_{n}"), F.col("box_high").alias(f"high_{n}"))
    need = bounds.select(F.col("number").alias("a"), "most", F.explode("ranges").alias("at")).select("a", "most", "at.pivot", F.col("at.from").alias("from"), F.col("at.to").alias("to"))
    need = need.join(box(ours, "a"), "a")
    met = need.join(box(theirs, "b").join(theirs.select(F.col("number").alias("b"), "pivot", "low", "high"), "b"), "pivot")
    gap = lambda i: F.greatest(F.lit(0.0), F.get("low_b", i) - F.get("high_a", i), F.get("low_a", i) - F.get("high_b", i))
    apart = F.aggregate(F.sequence(F.lit(0), F.lit(width - 1)), F.lit(0.0), lambda total, i: total + gap(i) * gap(i))
    pairs = met.where((F.col("high") >= F.col("from")) & (F.col("low") <= F.col("to")) & (apart <= F.col("most") * (1 + 1e-9))).select("a", "b")

    # Which blocks of a group of the reference a block meets: a row for each block and group.
    group_a, group_b = group_of(ours, width), group_of(theirs, width)
    met = cut(pairs.withColumn("ga", group_a(F.col("a"))).withColumn("gb", group_b(F.col("b"))).groupBy("a", "ga", "gb").agg(F.collect_list("b").alias("bs")))

    def search(asked: pa.Table, there: pa.Table) -> pa.Table:
        blocks = {b: unpacked(ids, x) for b, ids, x in zip(*(there.column(c).to_pylist() for c in ("b", "r_ids", "r_x")), strict=True)}
        out: list[pa.Table] = []
        for packed_ids, packed_x, packed_bound, bs in zip(*(asked.column(c).to_pylist() for c in ("ids", "x", "bound", "bs")), strict=True):
            (q, a), bounds_ = unpacked(packed_ids, packed_x), np.frombuffer(packed_bound)
            for i in range(0, len(q), STEP):
                mine, x, bound = q[i : i + STEP], a[i : i + STEP], bounds_[i : i + STEP].copy()
                held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
                for r, c in map(blocks.__getitem__, sorted(bs)):
                    row, at = possible(x, c, bound)
                    d = np.zeros(len(row))
                    for f in range(width):
                        d += (x[row, f] - c[at, f]) ** 2
                    fits = (d <= bound[row]) & np.isfinite(d) & (mine[row] != r[at])
                    held = joined([held, (row[fits], r[at[fits]], d[fits])], k)
                    # A row that has k others has its k-th as bound.
                    full = np.searchsorted(held[0], np.arange(len(mine)), side="right") - 1
                    full = full[np.bincount(held[0], minlength=len(mine)) == k]
                    bound[held[0][full]] = np.minimum(bound[held[0][full]], held[2][full])
                out.append(pa.table({"q": mine[held[0]], "r": held[1], "d": np.sqrt(held[2])}))
        return pa.concat_tables(out)

    asked = met.join(ours.select(F.col("number").alias("a"), "ids", "x").join(bounds.select(F.col("number").alias("a"), "bound"), "a"), "a")
    there = met.select(F.col("ga").alias("ra"), F.col("gb").alias("rb"), F.explode("bs").alias("b")).distinct()
    there = there.join(theirs.select(F.col("number").alias("b"), F.col("ids").alias("r_ids"), F.col("x").alias("r_x")), "b")
    found = asked.groupBy("ga", "gb").cogroup(there.groupBy("ra", "rb")).applyInArrow(search, "q long, r long, d double")
    w = Window.partitionBy("q").orderBy("d", "r")
    return found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")


def scaled(rows: DataFrame, features: list[str], reference: DataFrame | None = None) -> DataFrame:
    """Features less their mean over their deviation in the reference (the rows themselves if none); a constant one keeps its unit."""
    reference = rows if reference is None else reference
    known = [c for f in features for c in (F.avg(f).alias(f"_m_{f}"), F.stddev_pop(f).alias(f"_s_{f}"))]
    stats = reference.agg(*known).first()  # a row
    shift = {f: (float(stats[f"_m_{f}"] or 0.0), float(stats[f"_s_{f}"] or 1.0)) for f in features}
    return rows.withColumns({f: (F.col(f) - F.lit(m)) / F.lit(s) for f, (m, s) in shift.items()})
