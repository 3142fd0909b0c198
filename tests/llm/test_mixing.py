import math
import random

import pytest
from pyspark.sql import functions as F

from weblens.llm import mixing


def expected_targets(sizes, weights, share, most):
    """Water-filling, one limit at a time."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while True:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > most * sizes[s] + 1e-9]
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            open_.remove(s)
        left = share * sum(sizes.values()) - sum(out.values())


def docs(seed):
    r = random.Random(seed)
    rows = [(i, r.choice(["a"] * 6 + ["b", "c", "é", None]), "\t ".join(["w"] * r.choice([0, 1, 5, 30, 60]))) for i in range(3000)]
    return rows + [(1, "a", "x\x0by\x0cz\rq\x85r"), (1, "a", "x\x0by\x0cz\rq\x85r"), (None, "b", "one two"), (7, "b", None), (8, "only", "w " * 50)]


@pytest.mark.parametrize("share", [1.5, 0.4, 2.0])
def test_targets_and_amounts(spark, share):
    rows = docs(1)
    frame = spark.createDataFrame([(*x, 5) for x in rows], "doc_id long, source string, text string, size int")
    got = mixing.mix(frame, share=share).collect()
    assert len(got) == len(rows)
    count = lambda t: len((t or "").encode().split())
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + count(t)
    want = expected_targets(sizes, mixing.WEIGHTS, share, 2.0)
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(i), count(t)) for i, _, t in rows)
    by_size = {r.source_size: r.target for r in got}
    assert all(by_size[sizes[s]] == pytest.approx(want[s]) for s in sizes)
    taken = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
        taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
    assert all(abs(taken[sizes[s]] - want[s]) <= 30 for s in sizes)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(frame.repartition(3), share=share).collect()), key=str)


def test_equal_lengths_have_equal_chances(spark):
    frame = spark.createDataFrame([(i, "s", "w") for i in range(4000)], "doc_id long, source string, text string")
    copies = [r.copies for r in mixing.mix(frame, share=1.25).collect()]
    assert sum(copies) == 5000 and set(copies) == {1, 2}


@pytest.mark.parametrize("share", [0.3, 1.2, 1.9])
def test_the_sample_is_that_of_ranks_by_chances(spark, share):
    """One source, by hand: c by halving, then whole copies, then the lowest ranks."""
    r = random.Random(3)
    rows = [(i, "s", " ".join(["w"] * r.choice([0, 1, 2, 9, 40, 700]))) for i in range(1500)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {x.doc_id: x for x in mixing.mix(frame, share=share).collect()}
    u = {i: ((h % (1 << 50)) + 0.5) / (1 << 50) for i, h in frame.selectExpr("doc_id", "xxhash64(17, xxhash64(doc_id, text))").collect()}
    size = {i: len(t.split()) for i, _, t in rows}
    m = {i: 2.0 ** (math.floor(4 * math.log2(n) + 1e-9) / 16) for i, n in size.items() if n}
    low, high, target = 0.0, 10.0, share * sum(size.values())
    for _ in range(200):
        c = (low + high) / 2
        low, high = (c, high) if sum(n * min(2.0, c * m[i]) for i, n in size.items() if n) < target else (low, c)
    expected = {i: min(2.0, c * x) for i, x in m.items()}
    whole = {i: math.floor(e + 1e-9) for i, e in expected.items()}
    p = {i: e - whole[i] for i, e in expected.items() if e - whole[i] > 1e-9}
    left, copies = sum(size[i] * x for i, x in p.items()), dict(whole)
    for i in sorted(p, key=lambda i: u[i] / (1 - u[i]) / (p[i] / (1 - p[i]))):
        if abs(left - size[i]) >= abs(left):
            break
        left -= size[i]
        copies[i] += 1
    assert {i: x.copies for i, x in got.items()} == {i: copies.get(i, 0) for i in size}
    assert len(set(expected.values())) > 2


def test_copied_rows(spark):
    frame = spark.createDataFrame([(*x, 5) for x in docs(2)], "doc_id long, source string, text string, size int")
    out = mixing.copied(frame)
    assert out.columns == frame.columns
    assert out.count() == sum(r.copies for r in mixing.mix(frame).collect())


def test_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix(frame).collect() == [] == mixing.copied(frame).collect()


def test_too_many_sources_to_broadcast_are_joined(spark, monkeypatch):
    frame = spark.createDataFrame(docs(3), "doc_id long, source string, text string")
    want = sorted(map(tuple, mixing.mix(frame).collect()), key=str)
    monkeypatch.setattr(mixing, "SOURCES", 0)
    assert sorted(map(tuple, mixing.mix(frame).collect()), key=str) == want


def test_words_of_a_long_text_are_counted_without_listing_them(spark):
    """A list of these words does not fit the session's memory."""
    text = F.repeat(F.concat(F.lit("a "), F.repeat(F.lit("b"), F.col("id").cast("int"))), 50_000_000)
    assert spark.range(1).select(mixing.word_count(text).alias("n")).first().n == 50_000_000


def test_words_of_odd_texts(spark):
    texts = [None, "", " ", "\t\n", "a", " a", "a ", "a\tb", "\x0b\x0ca\r\nb  c ", "a\xa0b 　 \U0001f600x $1 \\", "\x1c \x85"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.n for r in rows.select("i", mixing.word_count(F.col("t")).alias("n")).collect()}
    assert got == {i: len((t or "").encode().split()) for i, t in enumerate(texts)}
