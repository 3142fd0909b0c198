"""Helpers that several operators share: reading, checkpoints, words, shingles, bounded counters, components."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries of a worker's word cache; it is emptied when full, so its memory is bounded.
WORD_CACHE = 300_000
#: Largest number of records in one Arrow batch of whole texts.
TEXTS_A_BATCH = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints; a temporary one where it names none and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


#: Rows of ids and numbers that make a task worth its files.
TASK_ROWS = 100_000


def keep(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder that the session names; a known number of rows makes as many
    tasks as are worth it, so that rounds over small frames don't write a file for each shuffle partition."""
    spark = df.sparkSession
    df = df if rows is None else df.coalesce(-(-rows // TASK_ROWS) or 1)
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def texts_in_batches(spark: SparkSession) -> None:
    """Long texts go to Python in small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXTS_A_BATCH))


@contextmanager
def batches_of(spark: SparkSession, records: int) -> Iterator[None]:
    """Arrow batches of so many records for what runs inside; the session's own setting holds again after it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(records))
    try:
        yield
    finally:
        spark.conf.set(name, was)


class Words(dict):
    """64-bit hashes of words, computed once for each word of a worker."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return value

    def of(self, text: str | None) -> np.ndarray:
        """The hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z lower-cased.

        ``bytes.lower`` and ``bytes.split`` know only ASCII letters and exactly these six separators.
        """
        found = (text or "").encode("utf-8", "surrogatepass").lower().split()
        return np.fromiter(map(self.__getitem__, found), dtype=np.uint64, count=len(found))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str | None], k: int, words: Words) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its k-word shingles; fewer words make one shingle of their own kind."""
    found = [words.of(t) for t in texts]
    every = np.concatenate([*found, np.zeros(k, dtype=np.uint64)])
    total = len(every) - k
    by_width = {k: mixed(polynomial([every[j : j + total] for j in range(k)]))}
    out, start = [], 0
    for w in found:
        n = len(w)
        if n >= k:
            s = np.sort(by_width[k][start : start + n - k + 1])
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        else:
            s = mixed(polynomial([w[j : j + 1] for j in range(n)])) if n else w
        out.append(s)
        start += n
    return out


def polynomial(terms: list[np.ndarray]) -> np.ndarray:
    """Of hashed words in order, and of their number."""
    acc = np.full(len(terms[0]), len(terms), dtype=np.uint64)
    for t in terms:
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + t
    return acc


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from numpy arrays."""
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, type=kind))


def blobs(values: list[np.ndarray]) -> pa.Array:
    return pa.array([x.tobytes() for x in values], type=pa.binary())


#: Counters in one row of a partial count.
CHUNK = 8192


def chunk_rows(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's counters as rows (chunk, blob); chunks of zeros are left out."""
    parts = [(i, c) for i in range(0, len(counts), CHUNK) if (c := counts[i : i + CHUNK]).any()]
    yield pa.RecordBatch.from_arrays([pa.array([i // CHUNK for i, _ in parts], pa.int32()), blobs([c.astype(np.int64) for _, c in parts])], names=["chunk", "blob"])


def summed_chunks(parts: DataFrame, size: int) -> np.ndarray:
    """Sum the tasks' counters chunk by chunk; the driver gets one array of ``size`` numbers, whatever the input."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, blob in zip(b.column("chunk").to_pylist(), b.column("blob").to_pylist(), strict=True):
                got = np.frombuffer(blob, dtype=np.int64)
                sums[chunk] = sums[chunk] + got if chunk in sums else got
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), blobs(list(sums.values()))], names=["chunk", "blob"])

    out = np.zeros(size, dtype=np.int64)
    chunks = max(1, -(-size // CHUNK))
    for row in parts.repartition(min(chunks, 8), "chunk").mapInArrow(add, "chunk int, blob binary").collect():
        got = np.frombuffer(row.blob, dtype=np.int64)
        out[row.chunk * CHUNK : row.chunk * CHUNK + len(got)] += got
    return out


class Scratch:
    """Tables between the rounds of a job, in the shared folder; each is whole before the one it replaces goes."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}", 0

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.folder}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{self.n}")

    def drop(self, n: int) -> None:
        """Delete a table by its number."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the undirected edges (a, b): label is the smallest node that it reaches.

    Labels take the minimum of the neighbours and then jump to their label's label, so the rounds grow with the
    logarithm of a chain. All state stays in tables, of which a round leaves the last; the driver sees one count a round.
    """
    rounds = Scratch(edges.sparkSession)
    both = rounds.put(edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").where("a <> b").distinct())
    labels = rounds.put(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        before = rounds.n
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        nearer = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        nearer = rounds.put(nearer)
        far = nearer.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = rounds.put(nearer.join(far, "label").select("node", "was", F.least("label", "next").alias("label")))
        moved = jumped.where("label <> was").limit(1).count()
        labels = jumped.select("node", "label")
        rounds.drop(before)
        rounds.drop(before + 1)
        if not moved:
            rounds.drop(1)
            return labels
