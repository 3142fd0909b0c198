"""Exact top-k search by inner product over a pivot-distance index.

Vectors become integers ``floor(scale * x)``. With one more component ``sqrt(M - |x|^2)``, M the greatest squared length,
larger inner products are smaller distances, so the triangle inequality serves. Each vector is keyed by its nearest pivot
and its distance from it; sorted by both, the sequence is cut into annuli of bounded size. A bounded sample of rows gives
each query a first bound of its k-th score. Queries, which are few, travel in blocks to the annuli within their bounds: first
to the nearest annulus of each pivot, which tightens the bounds, then to those that still may hold a better row. Bounds only
save work: every row is indexed and the result is exact.

Null vectors, vectors with null or non-finite components and rows with a null id take no part. Vectors of each length have an
index of their own, and a query is answered among those of its length. Rows of the query's own id are no candidates; a
query id with several rows of one length has the least of its vectors. Repeated rows are candidates each. Equal scores go by
the smaller id. Vectors whose scores could exceed 64 bits raise an error. An empty table gives no rows.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblens.llm.common import blobs, keep
from weblens.llm.vectors import valid, widths

#: Pivots, rows of the sample that gives first bounds, vectors of an annulus, and queries of a block.
PIVOTS, SAMPLE, ANNULUS, QUERIES = 48, 4096, 1024, 128
#: What distances may be off by, relative to M.
SLACK = 1e-6


def matrix(column: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.int64).reshape(-1, width)


def products(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Exact inner products: sums below 2**53 are exact in double precision."""
    return np.rint(x.astype(np.float64) @ y.T.astype(np.float64)).astype(np.int64) if most < 2**53 else x @ y.T


def squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k greatest scores, ties to the smaller id."""
    if len(scores) > k:
        edge = np.partition(scores, -k)[-k]
        some = np.flatnonzero(scores >= edge)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def top_k(rows: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query among rows (vec_id, embedding) its k best others."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector")).where(valid(F.col("vector")) & F.col("vec_id").isNotNull())
    out = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for width in widths(rows, "vector"):
        out = out.union(best_of_width(rows, width, is_query, k, scale))
    return out


def best_of_width(rows: DataFrame, width: int, is_query: Column, k: int, scale: int) -> DataFrame:
    """The search among vectors of one length."""
    spark = rows.sparkSession

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.floor(scale * np.array(b.column("vector").to_pylist(), dtype=np.float64).reshape(-1, width))
            if v.size and width * np.abs(v).max() ** 2 >= 2**62:
                raise OverflowError("scores of these vectors don't fit into 64 bits")
            v = v.astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), blobs(list(v)), pa.array(squares(v))], names=["vec_id", "v", "square"])

    vectors = keep(rows.where(F.size("vector") == width).mapInArrow(whole, "vec_id long, v binary, square long"))
    most = vectors.agg(F.max("square")).first()[0]
    sample = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE).collect()  # SAMPLE rows, whatever the input
    some, some_ids = matrix([r.v for r in sample], width), np.array([r.vec_id for r in sample])
    pivots = np.unique(some[:PIVOTS], axis=0)
    shared = spark.sparkContext.broadcast((some, some_ids, pivots))
    lift = np.sqrt((most - squares(pivots)).astype(np.float64))
    slack = SLACK * (1 + float(most) ** 0.5)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value[2]
        for b in batches:
            if b.num_rows:
                v = matrix(b.column("v").to_pylist(), width)
                square = 2 * float(most) - 2 * (products(v, p, most) + np.sqrt((most - squares(v)).astype(np.float64))[:, None] * lift[None])
                far = np.sqrt(np.maximum(square, 0))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(far.argmin(axis=1).astype(np.int32)), pa.array(far.min(axis=1))], names=["vec_id", "v", "pivot", "far"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def annulus() -> pa.RecordBatch:
            ids, v, pivot, far = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([pivot[0]], pa.int32()), pa.array([min(far)]), pa.array([max(far)]), blobs([np.array(ids)]), pa.array([b"".join(v)], pa.binary())], names=["pivot", "low", "high", "ids", "v"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("vec_id", "v", "pivot", "far")), strict=True):
                if held and (len(held) == ANNULUS or held[0][2] != row[2]):
                    yield annulus()
                    held = []
                held.append(row)
        if held:
            yield annulus()

    placed = vectors.mapInArrow(place, "vec_id long, v binary, pivot int, far double")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartitionByRange(partitions, "pivot", "far", "vec_id").sortWithinPartitions("pivot", "far", "vec_id")
    index = keep(dealt.mapInArrow(cut, "pivot int, low double, high double, ids binary, v binary")).withColumn("annulus", F.monotonically_increasing_id())
    index = keep(index)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of queries, each query with the k-th score that the sample gives it."""
        x, x_ids, _ = shared.value
        for b in batches:
            for i in range(0, b.num_rows, QUERIES):
                part = b.slice(i, QUERIES)
                ids, q = np.array(part.column("vec_id").to_pylist()), matrix(part.column("v").to_pylist(), width)
                scores = products(q, x, most)
                bound = np.full(len(ids), -np.inf)
                for j in range(len(ids)):
                    other = scores[j][x_ids != ids[j]]
                    if len(other) >= k:
                        bound[j] = np.partition(other, -k)[-k]
                yield pa.RecordBatch.from_arrays([blobs([ids]), blobs([q]), blobs([bound])], names=["q_ids", "q", "bound"])

    def tighten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The same blocks with the k-th scores that were found, where those are greater."""
        for b in batches:
            for r in b.to_pylist():
                bound, got = np.frombuffer(r["bound"]).copy(), {g["query_id"]: g["score"] for g in r["got"] or []}
                for j, q in enumerate(np.frombuffer(r["q_ids"], dtype=np.int64).tolist()):
                    bound[j] = max(bound[j], got.get(q, -np.inf))
                yield pa.RecordBatch.from_arrays([pa.array([r["block"]]), pa.array([r["q_ids"]]), pa.array([r["q"]]), blobs([bound])], names=["block", "q_ids", "q", "bound"])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each block and pivot the distances from it between which the block must look."""
        p = shared.value[2]
        for b in batches:
            for block, q, bound in zip(*(b.column(c).to_pylist() for c in ("block", "q", "bound")), strict=True):
                q, bound = matrix([q], width), np.frombuffer(bound)
                reach = np.sqrt(np.maximum(squares(q) + float(most) - 2 * bound, 0)) + slack
                far = np.sqrt(np.maximum(squares(q)[:, None] + float(most) - 2.0 * products(q, p, most), 0))
                low, high = (far - reach[:, None]).min(axis=0), (far + reach[:, None]).max(axis=0)
                names = ["block", "pivot", "from", "to"]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(p), pa.int64()), pa.array(range(len(p)), pa.int32()), pa.array(low), pa.array(high)], names=names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best rows of an annulus for each query of a block that may find some there."""
        p = shared.value[2]
        for b in batches:
            for r in b.to_pylist():
                q_ids, q, bound = np.frombuffer(r["q_ids"], dtype=np.int64), matrix([r["q"]], width), np.frombuffer(r["bound"])
                far = np.sqrt(np.maximum(squares(q) + float(most) - 2.0 * products(q, p[r["pivot"]][None], most)[:, 0], 0))
                reach = np.sqrt(np.maximum(squares(q) + float(most) - 2 * bound, 0)) + slack
                open_ = np.flatnonzero((far - reach <= r["high"]) & (far + reach >= r["low"]))
                if not len(open_):
                    continue
                ids = np.frombuffer(r["ids"], dtype=np.int64)
                scores = products(q[open_], matrix([r["v"]], width), most)
                for j, s in zip(open_.tolist(), scores, strict=True):
                    some = (s >= bound[j]) & (ids != q_ids[j])
                    if some.any():
                        there, s = ids[some], s[some]
                        first = best(s, there, k)
                        yield pa.RecordBatch.from_arrays([pa.array([r["block"]] * len(first)), pa.array([int(q_ids[j])] * len(first)), pa.array(there[first]), pa.array(s[first])], names=["block", "query_id", "vec_id", "score"])

    def meeting(blocks: DataFrame) -> DataFrame:
        """(block, annulus, gap): annuli within a block's ranges, and how far each is from the middle of its range."""
        need = blocks.select("block", "q", "bound").mapInArrow(ranges, "block long, pivot int, from double, to double")
        met = need.join(index.select("annulus", "pivot", "low", "high"), "pivot").where((F.col("high") >= F.col("from")) & (F.col("low") <= F.col("to")))
        middle = (F.col("from") + F.col("to")) / 2
        return met.select("block", "pivot", "annulus", F.greatest(F.lit(0.0), F.col("low") - middle, middle - F.col("high")).alias("gap"))

    def found(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
        # Blocks of queries are shuffled for each pair; an annulus is shuffled once.
        sent = pairs.select("block", "annulus").join(blocks, "block")
        return index.join(sent, "annulus").select("block", "pivot", "low", "high", "ids", "v", "q_ids", "q", "bound").mapInArrow(search, "block long, query_id long, vec_id long, score long")

    def ranked(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    # Queries of a block lie close to each other, so that few annuli are of interest to it.
    queries = vectors.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")).mapInArrow(place, "vec_id long, v binary, pivot int, far double")
    queries = queries.repartitionByRange(max(1, partitions // 2), "pivot", "far", "vec_id").sortWithinPartitions("pivot", "far", "vec_id").select("vec_id", "v")
    asked = keep(keep(queries.mapInArrow(ask, "q_ids binary, q binary, bound binary")).withColumn("block", F.monotonically_increasing_id()))
    near = keep(meeting(asked).groupBy("block", "pivot").agg(F.min(F.struct("gap", "annulus")).alias("best")).select("block", F.col("best.annulus").alias("annulus")))
    first = keep(ranked(found(asked, near)))
    got = first.where(F.col("rank") == k).groupBy("block").agg(F.collect_list(F.struct("query_id", "score")).alias("got"))  # QUERIES at most
    tighter = keep(asked.join(got, "block", "left").mapInArrow(tighten, "block long, q_ids binary, q binary, bound binary"))
    rest = meeting(tighter).join(near, ["block", "annulus"], "left_anti")
    names = ("query_id", "vec_id", "score")
    return ranked(first.select(*names).union(found(tighter, rest).select(*names))).select("query_id", "rank", "vec_id", "score")
