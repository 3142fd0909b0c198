"""Embedding near-dedup by an epsilon grid order join, exact.

Unit vectors with cosine t are ``eps = sqrt(2 - 2 t)`` apart. Vectors are sorted by their grid cells of width eps on the
leading principal axes of all vectors. The sequence is cut into blocks, and blocks into intervals of several, each with
its bounding box on these axes. Intervals whose boxes are within eps are found by the first axis' cells and box distance,
then their blocks likewise. Pairs whose blocks lie in the same two groups of neighbours in the sequence are one tile: each block is sent
once a tile, not once a pair. A pair again skips provably distant parts before it takes exact cosines in double precision. Any orthonormal axes give right results; principal ones skip most.

Identical vectors become one node with a count first. A task sends link counts and a spanning set of links for each pair
of parts, so a dense group costs rows in proportion to its nodes.

Null, empty and zero vectors, vectors with null or non-finite components, and rows with a null id link with nothing; a null
id has a null component. Vectors of other lengths than each other's never link. Rows that repeat an id count as vectors of
their own and share a component only through links. One row comes out for each row that goes in.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.llm.common import batches_of, blobs, chunk_rows, components, keep, lists, summed_chunks
from weblens.llm.vectors import common_width, valid

#: Leading axes of the grid; vectors in a block, in a part of a block, blocks in an interval, and in a group (a task holds one group).
AXES, BLOCK, PART, INTERVAL, GROUP = 6, 4096, 512, 16, 4
SCALE = 1e9


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def arrays(column: pa.Array) -> list[np.ndarray]:
    return [np.asarray(x, dtype=np.float64) for x in column.to_pylist()]


def principal_axes(nodes: DataFrame, width: int) -> np.ndarray:
    """The leading eigenvectors of the second moments of all unit vectors of the common width, as (width, AXES)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            if b.num_rows:
                u = unit(np.stack(arrays(b.column(0))))
                total += u.T @ u
        yield from chunk_rows(np.rint(total.ravel() * SCALE).astype(np.int64))

    moments = summed_chunks(nodes.where(F.size("vector") == width).select("vector").mapInArrow(read, "chunk int, blob binary"), width * width)
    return np.linalg.eigh(moments.reshape(width, width) / SCALE)[1][:, ::-1][:, :AXES]


def axes_for(width: int, axes: np.ndarray) -> np.ndarray:
    return axes if len(axes) == width else np.eye(width)[:, :AXES]


def in_blocks(nodes: DataFrame, axes: np.ndarray, eps: float, partitions: int, single: bool) -> DataFrame:
    """(block, interval, group, width, low, high, ids, times, vectors): the sequence in grid order, cut into blocks."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = arrays(b.column("vector"))
            at = [np.floor(unit(v[None]) @ axes_for(len(v), axes) / eps)[0].astype(np.int64) for v in rows]
            at = [np.pad(a, (0, AXES - len(a))) for a in at]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "times", "vector")), pa.array([len(v) for v in rows], pa.int32()), lists(at, pa.int64())], names=["id", "times", "vector", "width", "cell"])

    def block(rows: list[tuple], interval: int, group: int) -> pa.RecordBatch:
        v = np.stack([x for *_, x in rows])
        on = unit(v) @ axes_for(v.shape[1], axes)
        low, high = (np.pad(x, (0, AXES - len(x))) for x in (on.min(axis=0), on.max(axis=0)))
        ids, times = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        return pa.RecordBatch.from_arrays([pa.array([rows[0][0]]), pa.array([interval]), pa.array([group]), pa.array([v.shape[1]], pa.int32()), lists([low], pa.float64()), lists([high], pa.float64()), blobs([ids]), blobs([times]), blobs([v.astype(np.float32 if single else np.float64)])], names=["block", "interval", "group", "width", "low", "high", "ids", "times", "vectors"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, interval, group, blocks = [], None, None, 0
        for b in batches:
            for i, n, v in zip(b.column("id").to_pylist(), b.column("times").to_pylist(), arrays(b.column("vector")), strict=True):
                if held and (len(held) == BLOCK or len(held[0][2]) != len(v)):
                    yield block(held, interval, group)
                    # Intervals and groups hold vectors of one length.
                    blocks = blocks + 1 if len(held[0][2]) == len(v) else 0
                    held = []
                if not held and blocks % INTERVAL == 0:
                    interval = i
                if not held and blocks % INTERVAL % GROUP == 0:
                    group = i
                held.append((i, n, v))
        if held:
            yield block(held, interval, group)

    kind = nodes.schema["vector"].dataType.simpleString()
    placed = nodes.mapInArrow(place, f"id long, times long, vector {kind}, width int, cell array<long>")
    order = ["width", *[F.get("cell", F.lit(i)) for i in range(AXES)], "id"]
    dealt = placed.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    return keep(dealt.mapInArrow(cut, "block long, interval long, group long, width int, low array<double>, high array<double>, ids binary, times binary, vectors binary"))


def near_boxes(eps: float):
    """Whether the boxes (low_a, high_a) and (low_b, high_b) are within eps."""
    gap = lambda i: F.greatest(F.lit(0.0), F.get("low_b", F.lit(i)) - F.get("high_a", F.lit(i)), F.get("low_a", F.lit(i)) - F.get("high_b", F.lit(i)))
    return sum((gap(i) * gap(i) for i in range(1, AXES)), gap(0) * gap(0)) <= (eps + 1e-9) ** 2


def block_pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """(a, b, group_a, group_b) of blocks, each pair once, whose boxes are within eps: first between intervals, then inside those that are."""
    boxes = keep(blocks.select("block", "interval", "group", "width", "low", "high"))
    bound = lambda least_or_most, column: F.array(*[least_or_most(F.get(column, F.lit(i))) for i in range(AXES)]).alias(column)
    spans = boxes.groupBy("interval", "width").agg(bound(F.min, "low"), bound(F.max, "high"))
    cells = lambda reach: F.explode(F.sequence(F.floor(F.get("low", F.lit(0)) / eps), F.floor(F.get("high", F.lit(0)) / eps) + reach)).alias("cell")
    named = lambda df, s, *keys: df.select(*[F.col(k).alias(f"{k}_{s}") for k in keys], F.col("low").alias(f"low_{s}"), F.col("high").alias(f"high_{s}"), "width", *(c for c in df.columns if c == "cell"))
    one = named(spans.select("*", cells(1)), "a", "interval")
    two = named(spans.select("*", cells(1)), "b", "interval")
    near = one.join(two, ["width", "cell"]).where((F.col("interval_a") <= F.col("interval_b")) & near_boxes(eps)).select("interval_a", "interval_b").distinct()
    pairs = near.join(named(boxes, "a", "block", "interval", "group").drop("width"), "interval_a").join(named(boxes, "b", "block", "interval", "group"), "interval_b")
    inner = (F.col("interval_a") < F.col("interval_b")) | (F.col("block_a") <= F.col("block_b"))
    return pairs.where(inner & near_boxes(eps)).select(F.col("block_a").alias("a"), F.col("block_b").alias("b"), "group_a", "group_b")


def connected(mask: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and column of a block of links the smallest id that it reaches inside it."""
    top = np.iinfo(np.int64).max
    x, y = a.copy(), b.copy()
    while True:
        x2 = np.minimum(x, np.where(mask, y[None, :], top).min(axis=1))
        y2 = np.minimum(y, np.where(mask, x2[:, None], top).min(axis=0))
        if (x2 == x).all() and (y2 == y).all():
            return x, y
        x, y = x2, y2


def parts(ids: np.ndarray, times: np.ndarray, v: np.ndarray, axes: np.ndarray) -> list[tuple]:
    """A block in parts of PART unit vectors with their boxes."""
    u = unit(v)
    on = u @ axes_for(u.shape[1], axes)
    return [(ids[s], times[s], u[s], on[s].min(axis=0), on[s].max(axis=0)) for s in (slice(i, i + PART) for i in range(0, len(ids), PART))]


def tile(x: list[tuple], y: list[tuple], same: bool, threshold: float, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of two blocks: ids with their numbers of links, and links (id, to) that span what is connected."""
    counted, counts, linked, to = ([np.zeros(0, dtype=np.int64)] for _ in range(4))
    for i, (ids, times, u, low, high) in enumerate(x):
        for j, (ids2, times2, u2, low2, high2) in enumerate(y):
            gap = np.maximum(0, np.maximum(low2 - high, low - high2))
            if (same and j < i) or gap @ gap > (eps + 1e-9) ** 2:
                continue
            mask = u @ u2.T >= threshold
            if same and i == j:
                np.fill_diagonal(mask, False)
            if not mask.any():
                continue
            sides = [(ids, mask @ times2)] if same and i == j else [(ids, mask @ times2), (ids2, times @ mask)]
            for own, n in sides:
                counted.append(own[n > 0])
                counts.append(n[n > 0])
            for own, least in zip((ids, ids2), connected(mask, ids, ids2), strict=True):
                linked.append(own[least != own])
                to.append(least[least != own])
    own, at = np.unique(np.concatenate(counted), return_inverse=True)
    n = np.zeros(len(own), dtype=np.int64)
    np.add.at(n, at, np.concatenate(counts))
    links = np.unique(np.stack([np.concatenate(linked), np.concatenate(to)], axis=1), axis=0)
    return own, n, links[:, 0], links[:, 1]


def joined(pairs: DataFrame, blocks: DataFrame, axes: np.ndarray, threshold: float, eps: float, single: bool) -> DataFrame:
    """(id, links, to): link counts of nodes in a pair of blocks (to is null), and a spanning set of their links.

    A tile's blocks come one by one: first those of its first group, which the task holds, then each of the others with the
    blocks that it is to be joined with.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}
        for b in batches:
            for values in zip(*b.columns, strict=True):
                row = dict(zip(b.schema.names, values, strict=True))
                key = row["group_a"].as_py(), row["group_b"].as_py()
                if key != at:
                    at, held = key, {}
                own_ids = np.frombuffer(row["ids"].as_buffer(), dtype=np.int64)
                vectors = np.frombuffer(row["vectors"].as_buffer(), dtype=np.float32 if single else np.float64)
                number = row["block"].as_py()
                y = parts(own_ids, np.frombuffer(row["times"].as_buffer(), dtype=np.int64), vectors.reshape(len(own_ids), -1), axes)
                if row["side"].as_py() == 0:
                    held[number] = y
                    continue
                for a in row["with"].as_py():
                    ids, n, own, to = tile(held[a], y, a == number, threshold, eps)
                    if len(ids):
                        some = [pa.concat_arrays([pa.array(u), pa.array(v)]) for u, v in ((ids, own), (n, np.zeros(len(own), dtype=np.int64)))]
                        yield pa.RecordBatch.from_arrays([*some, pa.concat_arrays([pa.nulls(len(ids), pa.int64()), pa.array(to)])], names=["id", "links", "to"])

    spark, key = blocks.sparkSession, ["group_a", "group_b"]
    first = pairs.select(*key, F.lit(0).alias("side"), F.col("a").alias("block"), F.lit(None).cast("array<long>").alias("with")).distinct()
    then = pairs.groupBy(*key, F.col("b").alias("block")).agg(F.sort_array(F.collect_list("a")).alias("with"))  # GROUP at most
    rows = first.union(then.select(*key, F.lit(1).alias("side"), "block", "with")).join(blocks.select("block", "ids", "times", "vectors"), "block")
    # A given number of partitions: tiles are work for processors, whatever their bytes.
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *key).sortWithinPartitions(*key, "side", "block")
    with batches_of(spark, 1):  # a row is a block
        return keep(dealt.mapInArrow(read, "id long, links long, to long"))


def near_vectors(rows: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of (vec_id, embedding) linked at a cosine of ``threshold`` or more."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    # Vectors of single precision travel as such; all products are of double precision.
    single = rows.schema["vector"].dataType.simpleString() == "array<float>"
    ok = valid(F.col("vector")) & F.exists("vector", lambda x: x != 0) & F.col("vec_id").isNotNull()
    nodes = keep(rows.where(ok).groupBy("vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("times")))
    width, n = common_width(nodes, "vector"), nodes.count()
    eps = math.sqrt(2 - 2 * threshold)
    axes = principal_axes(nodes, width) if width else np.zeros((0, AXES))
    blocks = in_blocks(nodes.select("id", "times", F.col("vector").cast("array<float>" if single else "array<double>").alias("vector")), axes, eps, max(1, n // (4 * BLOCK)), single)
    found = joined(keep(block_pairs(blocks, eps)), blocks, axes, threshold, eps, single)
    labels = components(found.where("to is not null").select(F.col("id").alias("a"), F.col("to").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    full = nodes.join(links, "id", "left").join(labels.withColumnRenamed("node", "id"), "id", "left")
    full = full.select("vector", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("label", "id").alias("component_id"))
    good = rows.where(ok).join(full, "vector").select("vec_id", "n_links", "component_id")
    rest = rows.where(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
