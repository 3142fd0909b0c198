"""Queries against their SQL over whole small tables, and the pipeline's stages against what they promise."""

from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from weblens.llm import oracles, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(oracles.SQL[name])
    got = queries.queries()[name](spark, SF).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, SF).write.parquet(f"{tmp_path}/{i}")
        after = spark.read.parquet(f"{tmp_path}/{i}")
        kept[name] = (before, after)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns
        before = after
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    before, after = kept["toxicity"]
    assert ids(after) <= ids(before) and after.count() > 0.7 * before.count()
    before, after = kept["n-gram Jaccard join"]
    assert ids(after) <= ids(before) and 0.7 * before.count() < after.count() < before.count()
    before, after = kept["secret scans"]
    assert ids(after) == ids(before)
    words = lambda t: len((t or "").encode().split())
    mixed = kept["mixing sources to target weights"][1].select("doc_id", "text").collect()
    bins = kept["best-fit packing"][1].collect()
    assert sum(b.words for b in bins) == sum(words(r.text) for r in mixed)
    full = Counter()
    for b in bins:
        full[b.bin_id] += b.words
    assert max(full.values()) <= 2048


@pytest.mark.parametrize("empty", [True, False])
def test_pipeline_of_odd_tables(spark, tmp_path, empty):
    """Empty tables; nulls in any column, repeated rows, and columns that operators might use themselves."""
    words = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(i, f"{words} {i} and {i * 7} more of text{i}", "en", "a" if i % 3 else None, 9, "x", i, 1, True) for i in range(60)]
    rows += [(5, rows[5][1], "en", "a", 9, "x", 5, 1, True), (100, None, None, None, None, None, None, None, None), (None, words, "en", "b", 3, "y", 1, 0, False), (101, "", "en", "b", 0, "y", 1, 0, False), (102, rows[7][1], None, "b", 9, "z", 7, 1, True)]
    names = "doc_id long, text string, lang string, source string, n_chars long, cluster string, size long, label int, held_out boolean"
    spark.createDataFrame([] if empty else rows, names).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(i % 10 == 0)) for i in range(40)] + [(None, 1, 1), (3, None, None)]
    spark.createDataFrame([] if empty else labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert bool(got) != empty and all(r.words >= 0 for r in got)
    ids = {r.doc_id for r in got}
    assert empty or (len(ids & set(range(60))) > 20 and not {7, 102} <= ids)
