"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words.

Rows that carry only ids, sizes and hashes are dealt out evenly, whatever their keys, and sorted in each task, the largest
first. A task packs its rows as they come and keeps its bins open to its end. Open bins are ordered by what is left in them;
a bitmap of the occupied residuals gives the successor of a size. Each bin carries a bitmap of the duplicate clusters that it
holds, which the exact set confirms, and the set of sources that it holds as often as allowed; bins of one residual stand
together by that set. The search goes from the tightest bin that is large enough to the next until one is compatible,
the oldest of equal ones, and opens a bin if there is none. A run of copies goes on where the search for the last one ended.

The scope of best fit is a task: bins are not shared between tasks, so the packing depends on how many there are. A row opens
one bin at most, so the rows of a task, which a count bounds, bound its open bins.

A text longer than a bin fills whole bins of its own first; its last piece is packed like a document. A bin holds no two
documents of one duplicate cluster and at most ``per_source`` of one source. The cluster is a hash of the text with case and
white space made alike, or a column. Null texts have no words and no cluster, null sources are one source, rows with null
or repeated ids are documents like others. Texts without words take a place of no words. An empty table has no bins.
"""

from bisect import insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.llm.mixing import word_count

#: Rows of a task at most, and so its open bins.
TASK_ROWS = 50_000
NOT_FULL: frozenset = frozenset()


class Bins:
    """Open bins, in the order of what is left in them."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        #: By residual and set of full sources, the bins' numbers in order.
        self.by_left: list[dict[frozenset, list[int]]] = [{} for _ in range(capacity + 1)]
        self.occupied = self.opened = 0
        self.clusters: dict[int, set] = {}
        self.marks: dict[int, int] = {}
        self.sources: dict[int, Counter] = {}
        self.run: tuple | None = None
        #: For the run: the residual at which its search goes on, and how many of a list are known not to fit.
        self.floor, self.passed = 0, {}

    def place(self, size: int, source: str | None, cluster: int | None) -> int:
        """The bin for a piece: the tightest compatible one, or a new one."""
        if self.run != (size, source, cluster):
            self.run, self.floor, self.passed = (size, source, cluster), size, {}
        found = self.search(source, cluster)
        if found is None:
            i, left, full = self.new(), self.capacity, NOT_FULL
        else:
            i, left, full = found
        left -= size
        if cluster is not None:
            self.clusters[i].add(cluster)
            self.marks[i] |= 1 << (cluster & 63)
        self.sources[i][source] += 1
        if self.sources[i][source] >= self.per_source:
            full = full | {source}
        insort(self.by_left[left].setdefault(full, []), i)
        self.occupied |= 1 << left
        # Without a cluster the bin itself may take the next of the run again.
        if cluster is None and left >= size:
            self.floor = min(self.floor, left)
        return i

    def search(self, source: str | None, cluster: int | None) -> tuple[int, int, frozenset] | None:
        mark = 0 if cluster is None else 1 << (cluster & 63)
        while above := self.occupied >> self.floor:
            self.floor += (above & -above).bit_length() - 1
            least = None
            for full, bins in self.by_left[self.floor].items():
                if source in full:
                    continue
                at = self.passed.get((self.floor, full), 0) if mark else 0
                while at < len(bins) and self.marks[bins[at]] & mark and cluster in self.clusters[bins[at]]:
                    at += 1
                if mark:
                    self.passed[self.floor, full] = at
                if at < len(bins) and (least is None or bins[at] < least[0]):
                    least = bins[at], full, at
            if least is not None:
                self.take(self.floor, least[1], least[2])
                return least[0], self.floor, least[1]
            self.floor += 1
        return None

    def take(self, left: int, full: frozenset, at: int) -> int:
        bins = self.by_left[left][full]
        i = bins.pop(at)
        if not bins:
            del self.by_left[left][full]
            if not self.by_left[left]:
                self.occupied ^= 1 << left
        return i

    def new(self) -> int:
        i = self.whole()
        self.clusters[i], self.marks[i], self.sources[i] = set(), 0, Counter()
        return i

    def whole(self) -> int:
        """The number of a bin that is never open."""
        self.opened += 1
        return self.opened - 1


def packed(rows: Iterator[tuple], capacity: int, per_source: int) -> Iterator[tuple]:
    """(bin, doc_id, piece, start, words) of rows (doc_id, source, pieces, last, cluster), the greatest ``last`` first."""
    bins = Bins(capacity, per_source)
    for doc_id, source, pieces, last, cluster in rows:
        for p in range(pieces):
            yield bins.whole(), doc_id, p, p * capacity, capacity
        yield bins.place(last, source, cluster), doc_id, pieces, pieces * capacity, last


def pack(docs: DataFrame, capacity: int = 2048, per_source: int = 2, cluster: str | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """(bin_id, doc_id, piece, start, words) of documents (doc_id, source, text); start and words count words."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        held = []

        def out() -> pa.RecordBatch:
            bins, *rest = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([base + b for b in bins], *rest)], names=["bin_id", "doc_id", "piece", "start", "words"])

        for piece in packed(rows, capacity, per_source):
            held.append(piece)
            if len(held) == 8192:
                yield out()
                held = []
        if held:
            yield out()

    alike = F.xxhash64(F.trim(F.regexp_replace(F.lower("text"), "[ \\x09-\\x0D]+", " ")))
    name = F.when(F.col(cluster).isNotNull(), F.xxhash64(cluster)) if cluster else F.when(F.col("text").isNotNull(), alike)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), name.alias("cluster"))
    pieces = F.floor(F.greatest(F.lit(0), F.col("size") - 1) / capacity)
    slim = slim.withColumn("pieces", pieces).select("doc_id", "source", "pieces", (F.col("size") - F.col("pieces") * capacity).alias("last"), "cluster")
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // task_rows))
    dealt = slim.repartition(partitions).sortWithinPartitions(F.desc("last"), "cluster", "source", "doc_id", "pieces")
    return dealt.mapInArrow(read, "bin_id long, doc_id long, piece long, start long, words long")
