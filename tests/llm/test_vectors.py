import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weblens.llm import near_vectors, top_k

KIND = "vec_id long, embedding array<float>, width int, id string"


def vectors(seed, n=300, d=8):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((12, d))
    rows = [(i, (centres[r.integers(12)] + r.choice([0, 0.02, 0.12, 0.3]) * r.standard_normal(d)).astype(np.float32).tolist(), 1, "x") for i in range(n)]
    same = rows[3][1]
    rows += [(n + i, same, 1, "x") for i in range(60)]
    odd = [None, [], [0.0] * d, [None] + [1.0] * (d - 1), [math.nan] * d, [math.inf] + [1.0] * (d - 1), [1.0, 2.0], [1.0, 2.0], [-1e30] * d]
    rows += [(n + 100 + i, v, 1, "x") for i, v in enumerate(odd[:8] if seed % 2 else odd[:6])] + [(None, same, 1, "x")]
    random.Random(seed).shuffle(rows)
    return rows


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


@pytest.mark.parametrize("seed", [1, 2])
def test_links_as_brute_force(spark, monkeypatch, seed):
    for name, value in (("BLOCK", 32), ("PART", 8), ("INTERVAL", 3 if seed == 1 else 2), ("GROUP", 2), ("AXES", 3)):
        monkeypatch.setattr(near_vectors, name, value)
    rows = vectors(seed)
    ids = [r[0] for r in rows]
    good = [i is not None and usable(r[1]) and any(r[1]) for i, r in zip(ids, rows, strict=True)]
    near = {i: set() for i in range(len(rows))}
    for i in range(len(rows)):
        for j in range(i):
            if good[i] and good[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], dtype=float), np.array(rows[j][1], dtype=float)
                if a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= 0.95:
                    near[i].add(j)
                    near[j].add(i)
    component = {}
    for i in sorted(range(len(rows)), key=lambda i: (ids[i] is None, ids[i])):
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in component:
                component[x] = ids[i]
                todo += near[x]
    want = sorted(((ids[i], len(near[i]), component[i], ids[i] is not None and component[i] == ids[i]) for i in near), key=str)
    assert sorted(map(tuple, near_vectors.near_vectors(spark.createDataFrame(rows, KIND)).collect()), key=str) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_top_k_as_brute_force(spark, monkeypatch, seed):
    for name, value in (("PIVOTS", 5), ("SAMPLE", 40), ("ANNULUS", 16), ("QUERIES", 4)):
        monkeypatch.setattr(top_k, name, value)
    rows = vectors(seed)
    full = [(i, [math.floor(1024 * x) for x in v]) for i, v, *_ in rows if i is not None and usable(v)]
    want = []
    for i, q in full:
        if i % 5 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in full if j != i and len(v) == len(q))[:10]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    got = top_k.top_k(spark.createDataFrame(rows, KIND), F.col("vec_id") % 5 == 0)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_few_and_no_rows(spark):
    none = spark.createDataFrame([], KIND)
    assert near_vectors.near_vectors(none).collect() == [] == top_k.top_k(none, F.lit(True)).collect()
    two = spark.createDataFrame([(0, [1.0, 0.0], 1, "x"), (1, [0.5, 0.5], 1, "x")], KIND)
    assert sorted(map(tuple, top_k.top_k(two, F.lit(True)).collect())) == [(0, 1, 1, 512 * 1024), (1, 1, 0, 512 * 1024)]


def test_scores_that_exceed_64_bits_are_an_error(spark):
    rows = [(0, [1e30, 0.0], 1, "x"), (1, [0.5, 0.5], 1, "x")]
    with pytest.raises(Exception, match="64 bits"):
        top_k.top_k(spark.createDataFrame(rows, KIND), F.lit(True)).collect()


def test_blocks_of_production_size(spark):
    """Some blocks of the true size: links of copies and near copies over block ends, and the ten best by plain products."""
    r = np.random.default_rng(7)
    v = r.standard_normal((9000, 8)).astype(np.float32)
    v[4000:5000] = v[:1000] + 0.02 * r.standard_normal((1000, 8)).astype(np.float32)
    frame = spark.createDataFrame([(i, x, 1, "x") for i, x in enumerate(v.tolist())], KIND)
    u = v.astype(float) / np.sqrt((v.astype(float) ** 2).sum(axis=1, keepdims=True))
    links = np.concatenate([(u[i : i + 500] @ u.T >= 0.95).sum(axis=1) - 1 for i in range(0, len(u), 500)])
    got = {x.vec_id: x for x in near_vectors.near_vectors(frame).collect()}
    assert [got[i].n_links for i in range(len(u))] == links.tolist()
    whole = np.floor(1024 * v.astype(float)).astype(np.int64)
    best = {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in top_k.top_k(frame, F.col("vec_id") % 1000 == 0).collect()}
    for q in range(0, 9000, 1000):
        order = sorted((-s, i) for i, s in enumerate((whole @ whole[q]).tolist()) if i != q)[:10]
        assert [best[q, n + 1] for n in range(10)] == [(i, -s) for s, i in order]


def test_several_lengths_at_production_size(spark):
    """Vectors of three lengths in one table, blocks as in production: links and best scores stay among equal lengths."""
    r = np.random.default_rng(11)
    v = [x.astype(np.float32).astype(float) for d in (2, 5, 8) for x in r.standard_normal((80, d))]
    frame = spark.createDataFrame([(i, x.tolist(), 1, "x") for i, x in enumerate(v)], KIND)
    unit = [x / np.sqrt(x @ x) for x in v]
    links = [sum(j != i and len(b) == len(a) and a @ b >= 0.95 for j, b in enumerate(unit)) for i, a in enumerate(unit)]
    got = {x.vec_id: x.n_links for x in near_vectors.near_vectors(frame).collect()}
    assert [got[i] for i in range(len(v))] == links
    whole = [np.floor(1024 * x).astype(np.int64) for x in v]
    best = {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in top_k.top_k(frame, F.col("vec_id") % 40 == 0).collect()}
    for q in range(0, len(v), 40):
        order = sorted((-int(x @ whole[q]), i) for i, x in enumerate(whole) if i != q and len(x) == len(whole[q]))[:10]
        assert [best[q, n + 1] for n in range(10)] == [(i, -s) for s, i in order]
