"""Labelled rows for fitting: a bounded, repeatable sample."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)).cast("int")


def sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, most: int) -> DataFrame:
    """(doc_id, label, text) of at most ``most`` labelled ids outside ``held_out``, by a hash of the id.

    The sample of ids has a fixed bound of 16 bytes each, so it is broadcast and no text is shuffled. Null labels and
    ids are left out; of an id with several labels the greatest counts, and of one with several texts all do.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    ids = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "label", F.coalesce("text", F.lit("")).alias("text"))
