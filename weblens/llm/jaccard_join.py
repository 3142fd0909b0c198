"""N-gram Jaccard join: an exact metric-space join of documents by their word shingles.

Jaccard distance is a metric, and every pair within ``eps = 1 - threshold`` is found:

1. Copies with the same shingle set become one node, named by a 64-bit fingerprint of the set.
2. *Outer regions.* Almost all documents are at distance 1 from any document pivot, where the triangle inequality says
   nothing, so the outermost regions come from the sets themselves. Nodes fall into classes by size; a class bounds the
   number D of shingles in which two linked sets differ. The shingle space is cut into more than D parts, so that linked
   sets agree on a part, and what a set holds of a part names a region. A node is replicated to the regions of its parts.
3. *Root regions.* Linked sets agree on a known number of parts, so a set with company in fewer regions stays behind, and two
   sets that meet in fewer small regions and in no large one are not chained. Nodes that outer regions chain together form a
   root region; all links lie inside one. A root of bounded size is joined in one task.
4. *Recursion.* A larger region gets document pivots, and each node's distances from them. The nodes that link with their
   nearest pivot are its Voronoi region, one component by those links. Whatever else may link with them lies within
   ``2 * eps`` of the pivot by the triangle inequality: these boundary nodes, unless they link with the pivot itself, are
   replicated to the region and joined with it. The nodes that link with no pivot are a smaller region, and so on. Regions that pivots do not make smaller
   are joined in tiles of two blocks, exactly as well.
Every candidate is verified on whole shingle sets. Fingerprints and shingles are 64-bit hashes; two different ones among
N coincide with probability about N * N / 2**65.

Null or empty texts have an empty set and link with nothing. Rows with a null id link with nothing and get a null
component. Rows that repeat an id are one document: a link of any of its texts counts. One row comes out for each row
that goes in; further columns of the input are ignored.
"""

import math
from collections.abc import Iterator
from functools import cache
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.llm.common import Words, blobs, components, keep, mixed, polynomial, shingles, signed, texts_in_batches

#: Sizes of a class differ by up to this factor.
WIDTH = 1.5
#: A task hands on its parts when it has this many; buckets of parts for each shuffle partition.
FLUSH, BUCKETS = 1_500_000, 16
#: Sets in a block; a task joins two blocks at most. Shingles that a task compares at once.
BLOCK, COLUMNS = 512, 16384
#: Document pivots of a region, and how often what is left is split again.
PIVOTS, DEPTH = 4, 4
#: Ids up to which documents are told by a broadcast which of them is meant; ids of texts under a null id start here.
IDS, NAMELESS = 1_000_000, 1 << 62
#: Sets of a region up to which its pairs are counted.
SMALL = 12
#: Bytes of pivots' shingles, and rows of cells, up to which they are sent to the sets instead of the sets to them.
PIVOT_BYTES, CELL_ROWS = 16 << 20, 400_000


def fingerprint(s: np.ndarray) -> int:
    """Of a sorted set, from its size, its sum and its exclusive or."""
    if len(s) == 0:
        return 0
    parts = np.array([[len(s)], [s.sum(dtype=np.uint64)], [np.bitwise_xor.reduce(s)]], dtype=np.uint64)
    return int(signed(mixed(polynomial(list(parts))))[0])


def size_class(n: int) -> int:
    return int(math.log(n + 0.5, WIDTH))


@cache
def cut(c: int, num: int, den: int) -> tuple[int, int]:
    """The number of parts of a class, and how many of them may be empty before empty parts name regions too.

    Two linked sets, the smaller of which is in the class, differ in D shingles at most. With D + 1 + E parts they agree
    on E + 1 of them; if a set has no more than E empty parts, they agree on one that isn't empty.
    """
    low = next(n for n in count(max(1, int(WIDTH**c) - 2)) if size_class(n) == c)
    high = next(n for n in count(low) if size_class(n + 1) > c)
    differ = (den - num) * (high + high * den // num) // (den + num)
    empty = 0
    for _ in range(20):
        mean = (differ + 1 + empty) * math.exp(-low / (differ + 1 + empty))
        empty = math.ceil(mean + 5 * math.sqrt(mean))
    return differ + 1 + min(empty, differ), min(empty, differ)


def parts(s: np.ndarray, num: int, den: int, needs: list | None = None) -> np.ndarray:
    """The names of a set's outer regions. ``needs`` gets, for each, in how many regions of its class a linked set meets
    this one at least: the parts on which the two agree, less those that are empty here."""
    n = len(s)
    out = []
    scattered = s * np.uint64(0xD6E8FEB86659FD93)
    for c in range(size_class(-(-n * num // den)), size_class(n) + 1):
        m, spare = cut(c, num, den)
        of = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        name = mixed((np.add.reduceat(scattered, first) * np.uint64(m + 1) + of[first]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(c))
        out.append(name)
        if needs is not None:
            needs.append(np.full(len(name), max(1, spare + 1 - (m - len(first)))))
        if m - len(first) > spare:
            if needs is not None:
                needs.append(np.ones(m - len(first), dtype=np.int64))
            gone = np.setdiff1d(np.arange(m, dtype=np.uint64), of[first])
            out.append(mixed(mixed(gone + np.uint64(1)) + np.uint64(c)))
    return np.concatenate(out)


# Documents meet in outer regions. What one task has found travels as rows (bucket, kind, x, y, z) of packed arrays.
NAMED, DOCUMENT, NO_ID, COMPANY, PAIR, STAR = range(6)
#: The types of y and z by kind; x has 64 bits but for names.
TYPES = {DOCUMENT: (np.int64, np.int64), NO_ID: (np.int64, np.int64), COMPANY: (np.int32, np.uint8), PAIR: (np.int64, np.uint8), STAR: (np.int64, np.uint8)}
PACKED = "bucket int, kind int, x binary, y binary, z binary"
#: Set in a need: the region holds more sets than are told here. Needs are kept below.
LARGE = 128


def packs(rows: list[tuple]) -> pa.RecordBatch:
    bucket, kind, *arrays = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), *map(blobs, map(list, arrays))], names=["bucket", "kind", "x", "y", "z"])


def regions_of(names: np.ndarray, fps: np.ndarray, needs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct (name, fp) with their needs, the place of each name's first row, each row's first, and its name's rows."""
    order = np.lexsort((needs, fps, names))
    names, fps, needs = names[order], fps[order], needs[order]
    last = np.concatenate([(names[1:] != names[:-1]) | (fps[1:] != fps[:-1]), [True]])
    names, fps, needs = names[last], fps[last], needs[last]
    first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
    rows = np.diff(np.append(first, len(names)))
    return names, fps, needs, first, np.repeat(first, rows), np.repeat(rows, rows)


def in_company(fps: np.ndarray, needs: np.ndarray) -> tuple:
    """A pack of sets with the number of regions in which each has company, and the least need of these."""
    fps, at, n = np.unique(fps, return_inverse=True, return_counts=True)
    least = np.full(len(fps), LARGE - 1, dtype=np.uint8)
    np.minimum.at(least, at, needs & (LARGE - 1))
    return -1, COMPANY, fps, n.astype(np.int32), least


def star(fps: np.ndarray, centres: np.ndarray) -> tuple:
    return -1, STAR, fps, centres, np.zeros(len(fps), dtype=np.uint8)


def leaders(names: np.ndarray, fps: np.ndarray, needs: np.ndarray, buckets: int) -> list[tuple]:
    """What a task sends of its sets' regions: by bucket of names, all sets of small regions and one of each large one,
    whose other sets are told to be in company here, so a region may hold any share of the documents."""
    names, fps, needs, first, own, size = regions_of(names, fps, needs)
    large = size > SMALL
    follows = large & (own != np.arange(len(names)))
    out = [in_company(fps[follows], needs[follows]), star(fps[follows], fps[own[follows]])] if follows.any() else []
    names, fps, needs = names[~follows], fps[~follows], np.where(large, needs | LARGE, needs)[~follows]
    edges = np.searchsorted(names, [np.uint64(i * 2**64 // buckets) for i in range(1, buckets)])
    # 32 bits below those that pick a bucket: names that coincide only put more sets in company.
    low = ((names >> np.uint64(12)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    cut_ = [np.split(c, edges) for c in (low, fps, needs)]
    return out + [(i, NAMED, *c) for i, c in enumerate(zip(*cut_, strict=True)) if len(c[0])]


def meeting(names: np.ndarray, fps: np.ndarray, needs: np.ndarray) -> list[tuple]:
    """Who meets in a bucket's regions: each set with its number of regions in company, pairs of sets that share a small
    region, and the sets of a large one with the one that stands in its centre."""
    _, fps, needs, first, own, size = regions_of(names, fps, needs)
    large = np.repeat(np.maximum.reduceat(needs, first) >= LARGE, size[first]) | (size > SMALL)
    needs = needs & (LARGE - 1)
    out, company = [], large | (size > 1)
    if company.any():
        out.append(in_company(fps[company], needs[company]))
    follows = large & (own != np.arange(len(fps)))
    if follows.any():
        out.append(star(fps[follows], fps[own[follows]]))
    pairs = []
    for step in range(1, SMALL):
        i = np.flatnonzero((own[step:] == own[:-step]) & ~large[step:])
        pairs.append((fps[i], fps[i + step], np.maximum(needs[i], needs[i + step])))
    a, b, need = map(np.concatenate, zip(*pairs, strict=True))
    return [*out, (-1, PAIR, a, b, need)] if len(a) else out


def meetings(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """One pass over the texts: packs of the documents (doc_id, fp, n_shingles), and of who meets whom."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = partitions * BUCKETS

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, n = Words(), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            sent = leaders(*map(np.concatenate, zip(*held, strict=True)), buckets)
            for i in range(0, len(sent), 256):
                yield packs(sent[i : i + 256])

        for b in batches:
            found = shingles(b.column("text").to_pylist(), k, words)
            fps, sizes = np.array([fingerprint(s) for s in found], dtype=np.int64), np.array([len(s) for s in found], dtype=np.int64)
            known = b.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            ids = b.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            yield packs([(-1, kind, ids[some], fps[some], sizes[some]) for kind, some in ((DOCUMENT, known), (NO_ID, ~known))])
            for i in np.flatnonzero(known & (sizes > 0)):
                needs: list[np.ndarray] = []
                names = parts(found[i], num, den, needs)
                held.append((names, np.full(len(names), fps[i]), np.minimum(np.concatenate(needs), LARGE - 1).astype(np.uint8)))
                n += len(names)
                if n > FLUSH:
                    yield from flush()
                    held, n = [], 0
        if held:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def met() -> Iterator[pa.RecordBatch]:
            got = meeting(*[np.frombuffer(b"".join(c), dtype=t) for c, t in zip(zip(*held, strict=True), (np.uint32, np.int64, np.uint8), strict=True)])
            if got:
                yield packs(got)

        for b in batches:
            apart = b.filter(pc.not_equal(b.column("kind"), NAMED))
            if apart.num_rows:
                yield apart
            named = b.filter(pc.equal(b.column("kind"), NAMED))
            for bucket, *arrays in zip(*(named.column(c).to_pylist() for c in ("bucket", "x", "y", "z")), strict=True):
                if held and bucket != at:
                    yield from met()
                    held = []
                at = bucket
                held.append(arrays)
        if held:
            yield from met()

    sent = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(read, PACKED)
    dealt = sent.repartition(partitions, F.when(F.col("bucket") < 0, F.xxhash64("x", "kind")).otherwise(F.col("bucket").cast("long")))
    return dealt.sortWithinPartitions("bucket").mapInArrow(meet, PACKED)


def unpacked(met: DataFrame, kind: int, *columns: str) -> DataFrame:
    """The rows of one kind of packs."""
    types = (np.int64, *TYPES[kind])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for arrays in zip(*(b.column(c) for c in "xyz"), strict=True):
                flat = [np.frombuffer(a.as_buffer(), dtype=t) for a, t in zip(arrays, types, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(f.astype(np.int64)) for f in flat], names=list(columns))

    return met.where(F.col("kind") == kind).select("x", "y", "z").mapInArrow(read, ", ".join(f"{c} long" for c in columns))


def documents(met: DataFrame) -> DataFrame:
    """(doc_id, fp, n_shingles) of each row."""
    nameless = unpacked(met, NO_ID, "doc_id", "fp", "n_shingles").withColumn("doc_id", F.lit(None).cast("long"))
    return unpacked(met, DOCUMENT, "doc_id", "fp", "n_shingles").unionByName(nameless)


def root_regions(met: DataFrame) -> DataFrame:
    """(cell, fp, degree): the sets that may link with others, by the roots that outer regions chain together.

    A set that links has company in as many regions as it needs at least; the others stay behind before any set is
    shipped. Two sets that meet in small regions only are chained if they meet in as many as they need. The sets of a
    large region are chained through its centre: each set once, with the least of its centres, and its centres with that.
    """
    company = unpacked(met, COMPANY, "fp", "regions", "need").groupBy("fp").agg(F.sum("regions").alias("degree"), F.min("need").alias("need"))
    company = keep(company.where("degree >= need").select("fp", "degree"))
    pairs = unpacked(met, PAIR, "a", "b", "need").groupBy("a", "b").agg(F.count("*").alias("met"), F.min("need").alias("need")).where("met >= need").select("a", "b")
    stars = unpacked(met, STAR, "a", "b", "need").select("a", "b").distinct()
    stars = stars.join(company.select(F.col("fp").alias("a")), "a", "left_semi").groupBy("a").agg(F.min("b").alias("b"), F.collect_set("b").alias("centres"))
    stars = keep(stars)
    centres = stars.select(F.explode("centres").alias("a"), "b").where("a <> b").distinct()
    roots = components(pairs.union(stars.select("a", "b")).union(centres))
    placed = company.join(roots.withColumnRenamed("node", "fp"), "fp").select(F.col("label").alias("cell"), "fp", "degree")
    several = placed.groupBy("cell").agg(F.count("*").alias("sets")).where("sets > 1")
    return keep(placed.join(several, "cell").select("cell", "fp", "degree"))


def shipped(docs: DataFrame, rows: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(fp, shingles), once for each wanted set (fp): of each set one document is read again."""
    one = rows.where("doc_id is not null").join(wanted.select("fp"), "fp", "left_semi").groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    ids = keep(one.select("doc_id").distinct())
    ids = F.broadcast(ids) if ids.count() <= IDS else ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            found = [s for s in shingles(b.column("text").to_pylist(), k, words) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([fingerprint(s) for s in found], pa.int64()), blobs(found)], names=["fp", "shingles"])

    texts = docs.where("text is not null").select(F.col("doc_id").cast("long"), "text").join(ids, "doc_id", "left_semi").select("text")
    return texts.mapInArrow(read, "fp long, shingles binary").dropDuplicates(["fp"])


def distances(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, both, n_a, n_b) of distinct pairs (a, b): the sizes of the intersection and of the sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = [[np.frombuffer(x, dtype=np.uint64) for x in b.column(c).to_pylist()] for c in "xy"]
            both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sides, strict=True)]
            sizes = [pa.array([len(x) for x in side], pa.int64()) for side in sides]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(both, pa.int64()), *sizes], names=["a", "b", "both", "n_a", "n_b"])

    one = nodes.select(F.col("fp").alias("a"), F.col("shingles").alias("x"))
    two = nodes.select(F.col("fp").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long, both long, n_a long, n_b long")


def to_pivots(regions: DataFrame, pivots: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """(a, b, both, n_a, n_b) of sets a in regions (cell, fp) and their pivots (cell, b) that have a shingle in common.

    While the pivots' shingles are few enough they go to the sets, and no set is shuffled; else the pairs are joined.
    """
    pairs = regions.select("cell", F.col("fp").alias("a")).join(pivots, "cell").select("a", "b").distinct()
    own = pivots.select(F.col("b").alias("fp")).distinct().join(nodes.select("fp", "shingles"), "fp")
    if own.agg(F.coalesce(F.sum(F.length("shingles")), F.lit(0))).first()[0] > PIVOT_BYTES:
        return keep(distances(pairs, nodes), most)
    got = sorted((r.fp, np.frombuffer(bytes(r.shingles), dtype=np.uint64)) for r in own.collect())  # PIVOT_BYTES at most
    if not got:
        return keep(distances(pairs, nodes), most)
    flat, of = np.concatenate([x for _, x in got]), np.repeat(np.arange(len(got)), [len(x) for _, x in got])
    order = np.argsort(flat, kind="stable")
    shared_ = nodes.sparkSession.sparkContext.broadcast((flat[order], of[order], np.array([f for f, _ in got]), np.array([len(x) for _, x in got])))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, of, fps, sizes = shared_.value
        for b in batches:
            out = []
            for fp, x in zip(b.column("fp").to_pylist(), b.column("shingles").to_pylist(), strict=True):
                x = np.frombuffer(x, dtype=np.uint64)
                first, last = np.searchsorted(flat, x, "left"), np.searchsorted(flat, x, "right")
                n = last - first
                if n.any():
                    at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    both = np.bincount(of[at], minlength=len(fps))
                    hit = np.flatnonzero(both)
                    out.append((np.full(len(hit), fp), fps[hit], both[hit], np.full(len(hit), len(x)), sizes[hit]))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, dtype=np.int64)] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["a", "b", "both", "n_a", "n_b"])

    met = keep(nodes.select("fp", "shingles").mapInArrow(compare, "a long, b long, both long, n_a long, n_b long"))
    return keep(met.join(pairs, ["a", "b"]).select("a", "b", "both", "n_a", "n_b"), most)


def intersections(sets_: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections of some sets, by products of their incidence with bounded numbers of shingles."""
    flat, row = np.concatenate(sets_), np.repeat(np.arange(len(sets_)), [len(s) for s in sets_])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    again = ~(new & np.concatenate([new[1:], [True]]))  # a shingle of one set only is in no intersection
    column, row = np.cumsum(new[again]) - 1, row[again]
    out = np.diag([len(s) for s in sets_]).astype(np.float64)
    total = np.zeros_like(out)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        has = np.zeros((len(sets_), COLUMNS), dtype=np.float32)
        has[row[a:b], column[a:b] - start] = 1
        total += has @ has.T
    return np.where(out > 0, out, total)


def all_links(cells: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) that connect what links inside each cell (cell, fp) of two blocks at most."""

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("fp")
        fps, members = frame.fp.to_numpy(), [np.frombuffer(x, dtype=np.uint64) for x in frame.shingles]
        both, n = intersections(members), np.array([len(s) for s in members], dtype=np.float64)
        link = den * both >= num * (n[:, None] + n[None] - both)
        label = fps.copy()
        while True:  # the smallest of a row's links, until nothing changes
            least = np.where(link, label[None], np.iinfo(np.int64).max).min(axis=1)
            if (least == label).all():
                break
            label = least
        return pd.DataFrame({"a": fps[label != fps], "b": label[label != fps]})

    cells = keep(cells)
    cells = F.broadcast(cells) if cells.count() <= CELL_ROWS else cells
    return nodes.select("fp", "shingles").join(cells, "fp").groupBy("cell").applyInPandas(join, "a long, b long")


def in_blocks(regions: DataFrame) -> DataFrame:
    """Regions (cell, fp, side) of any size as cells of two blocks at most that hold all pairs of different sides.

    Side 0 is left, 1 right, and null both. Only what neither bounds nor pivots make smaller comes here.
    """
    many = lambda side: F.ceil(F.count(F.when(side, 1)) / BLOCK).cast("int")
    sized = regions.groupBy("cell").agg(many(F.col("side").isNull()).alias("all"), many(F.col("side") == 0).alias("left"), many(F.col("side") == 1).alias("right"), F.count("*").alias("size"))
    # A Voronoi region without boundary nodes is one component as it is.
    sized = sized.where("(all > 0 and size > 1) or (left > 0 and right > 0)").drop("size")
    rows = regions.join(sized, "cell").withColumn("blocks", F.when(F.col("side").isNull(), F.col("all")).when(F.col("side") == 0, F.col("left")).otherwise(F.col("right")))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp", F.lit("block")), F.col("blocks")).cast("int"))
    others = F.when(F.col("side").isNull(), F.col("all")).when(F.col("side") == 0, F.col("right")).otherwise(F.col("left"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    # Blocks of one side meet in pairs of different blocks, if there are several.
    rows = rows.where(F.col("side").isNotNull() | (F.col("all") == 1) | (F.col("own") != F.col("other")))
    i = F.when(F.col("side").isNull(), F.least("own", "other")).when(F.col("side") == 0, F.col("own")).otherwise(F.col("other"))
    j = F.when(F.col("side").isNull(), F.greatest("own", "other")).when(F.col("side") == 0, F.col("other")).otherwise(F.col("own"))
    return rows.select(F.xxhash64("cell", i, j).alias("cell"), "fp")


def split(regions: DataFrame, nodes: DataFrame, num: int, den: int, depth: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of large regions (cell, fp, degree, size): links (a, b) with pivots; Voronoi regions and their boundaries
    (cell, fp, side); and what links with no pivot (cell, fp, degree, parent)."""
    of = F.pmod(F.xxhash64("fp", F.lit(depth)), F.lit(PIVOTS))
    picked = regions.groupBy("cell").agg(*[F.max(F.when(of == j, F.struct("degree", "fp"))).alias(f"p{j}") for j in range(PIVOTS)])
    n = PIVOTS * regions.count()
    pivots = keep(picked.select("cell", F.explode(F.array(*[F.col(f"p{j}.fp") for j in range(PIVOTS)])).alias("b")).where("b is not null"), n)
    found = to_pivots(regions, pivots, nodes, n * 8)
    rows = regions.withColumnRenamed("fp", "a").join(pivots, "cell")
    union = F.col("n_a") + F.col("n_b") - F.col("both")
    # No distance is left out by rounding: the window is a little wider than twice eps.
    window = 1 - F.col("both") / union <= 2 * (1 - num / den) + 1e-9
    far = keep(rows.join(found, ["a", "b"]).select("cell", "a", "b", "degree", "size", (F.col("both") * den >= union * num).alias("link"), (F.col("both") / union).alias("near"), window.alias("window")), n)
    home = far.where("link").groupBy("cell", "a").agg(F.max(F.struct("near", "b")).alias("m")).select("cell", "a", F.col("m.b").alias("home"))
    placed = keep(far.join(home, ["cell", "a"], "left"), n)
    inside = placed.where("b = home").select("cell", "b", "a", F.lit(1).alias("side"))
    # What links with the pivot is one component with its region already.
    border = placed.where("window and not link").select("cell", "b", "a", F.lit(0).alias("side"))
    # Pairs without a common shingle are not among the found ones; what has no home is left.
    rest = regions.join(home.select("cell", F.col("a").alias("fp")), ["cell", "fp"], "left_anti").select(F.xxhash64("cell", F.lit("rest")).alias("cell"), "fp", "degree", F.col("size").alias("parent")).distinct()
    return placed.where("link and a <> b").select("a", "b"), inside.union(border).select(F.xxhash64("cell", "b").alias("cell"), F.col("a").alias("fp"), "side"), rest


def region_links(regions: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) that connect what links inside each region (cell, fp, degree)."""
    n, links, cells, regions = regions.count(), [], [], regions.withColumn("parent", F.lit(None).cast("long"))
    for depth in range(DEPTH + 1):
        sized = keep(regions.join(regions.groupBy("cell").agg(F.count("*").alias("size")), "cell"), n)
        done = (F.col("size") <= BLOCK) | F.coalesce(F.col("size") > 0.9 * F.col("parent"), F.lit(False)) | F.lit(depth == DEPTH)
        cells.append(sized.where(done).select("cell", "fp", F.lit(None).cast("int").alias("side")))
        large = sized.where(~done)
        if not large.limit(1).count():
            break
        with_pivots, borders, regions = split(large.drop("parent"), nodes, num, den, depth)
        links.append(with_pivots)
        cells.append(borders)
    for c in cells:
        links.append(all_links(in_blocks(keep(c, n)), nodes, num, den))
    out = links[0]
    for x in links[1:]:
        out = out.union(x)
    return keep(out)


def linked(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, fp, n_shingles, component_id) of documents (doc_id, text)."""
    texts_in_batches(docs.sparkSession)
    met = keep(meetings(docs, k, num, den))
    roots = root_regions(met)
    rows = documents(met)
    nodes = keep(shipped(docs, rows, roots, k))
    return grouped(rows, region_links(roots, nodes, num, den))


def jaccard_join(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) of documents (doc_id, text) that link at a similarity of num / den or more."""
    return linked(docs, k, num, den).select("doc_id", "n_shingles", "component_id")


def grouped(rows: DataFrame, links: DataFrame) -> DataFrame:
    """The rows (doc_id, n_shingles, fp) with the smallest doc_id that each reaches through links of fingerprints."""
    full = rows.where("doc_id is not null and n_shingles > 0")
    # A document that comes in several rows ties the sets of its texts together.
    again = full.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("last")).where("a <> last").select("doc_id", "a")
    ties = full.join(again, "doc_id").where("a <> fp").select("a", F.col("fp").alias("b"))
    labels = components(links.union(ties))
    named = keep(rows.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("doc_id", "fp", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("label", "fp")).alias("label")))
    least = named.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("size")).where("size > 1").drop("size")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    return named.join(least, "label", "left").select("doc_id", "fp", "n_shingles", own)


def one_of_each(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The documents that have the smallest id of their component, with all their columns.

    Texts under a null id count as documents that come after all others, named by a hash of the text. Rows of one id leave
    one row for each different text (case and white space made alike).
    """
    named = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NAMELESS) + F.pmod(F.xxhash64("text"), F.lit(NAMELESS))).alias("doc_id"), "text")
    rows = keep(linked(named.select("doc_id", "text"), k, num, den).select("doc_id", "component_id"))
    gone = keep(rows.where("component_id <> doc_id").select("doc_id").distinct())
    again = keep(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    # Rows that go and ids that repeat are broadcast up to a number of ids; beyond it they are joined.
    gone, again = (F.broadcast(ids) if ids.count() <= IDS else ids for ids in (gone, again))
    stay = named.join(gone, "doc_id", "left_anti")
    alike = F.trim(F.regexp_replace(F.lower("text"), "[ \\x09-\\x0D]+", " "))
    one = stay.join(again, "doc_id", "left_semi").withColumn("alike", alike).dropDuplicates(["doc_id", "alike"])
    return stay.join(again, "doc_id", "left_anti").select("doc.*").union(one.select("doc.*"))
