"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblens.llm.byte_bpe import decode, encode
from weblens.llm.chat import chat_turns
from weblens.llm.common import table
from weblens.llm.jaccard_join import jaccard_join
from weblens.llm.labelled import fold
from weblens.llm.licenses import license_scan
from weblens.llm.mixing import mix, word_count
from weblens.llm.near_vectors import near_vectors
from weblens.llm.oracles import SQL
from weblens.llm.packing import pack
from weblens.llm.periodic import periodic_runs
from weblens.llm.prefix_trie import prefix_trie
from weblens.llm.quality import quality
from weblens.llm.secrets import secret_scan
from weblens.llm.top_k import top_k
from weblens.llm.toxicity import toxicity


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op2_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4) == 2)


def op3_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op4_segment_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) == 1)


def op5_grid_order_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op6_license_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op7_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op8_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op10_transcript_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_turns(table(spark, sf_dir, "conversations"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids whose crc32 is divisible by 10 have a periodic tail put in first, as far as their number of words says."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(h / 10), word_count(F.col("text"))
    start = F.when((h % 10 == 0) & (n > 0), g % n)
    docs = table(spark, sf_dir, "documents")
    runs = periodic_runs(docs, least=6, times=4, tail=(start, 1 + F.floor((n - start) / (3 + g % 8))))
    each = F.arrays_zip("starts", "lengths", "periods")
    best = F.element_at(F.array_sort(F.transform(each, lambda r: F.struct(-r["lengths"], r["starts"], r["periods"]))), 1)
    lines = F.transform(each, lambda r: F.concat_ws(",", r["starts"], r["lengths"], r["periods"]))
    found = runs.select("doc_id", "collapsed", F.size("starts").cast("long").alias("n_runs"), F.when(F.size("starts") > 0, best).alias("best"), lines.alias("lines"))
    length, period = -F.col("best.col1"), F.col("best.periods")
    return found.select(
        "doc_id", "n_runs", F.col("best.starts").alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("lines", lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokens = encode(table(spark, sf_dir, "documents"), path)
    digests = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256)
    slim = tokens.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), digests.alias("ids_sha256"))
    return decode(slim, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = (
    op1_ngram_jaccard_join, op2_neighbour_quality, op3_secret_ownership, op4_segment_toxicity, op5_grid_order_near_dedup, op6_license_paragraphs, op7_pareto_mixing,
    op8_pivot_top_k, op9_best_fit_packing, op10_transcript_turns, op11_periodic_runs, op12_byte_bpe, op13_prefix_trie,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
