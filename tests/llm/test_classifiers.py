import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weblens.llm import labelled, quality, toxicity


def brute_segments(scores):
    """Maximal segments by their definition: the best segment, then the same to its left and right."""
    best, at = 0, None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            if (s := sum(scores[i:j])) > best + 1e-9:
                best, at = s, (i, j)
    if not at:
        return []
    i, j = at
    left, right = brute_segments(scores[:i]), brute_segments(scores[j:])
    return left + [(i, j, best)] + [(a + j, b + j, s) for a, b, s in right]


@pytest.mark.parametrize("seed", range(30))
def test_segments_by_definition(seed):
    r = random.Random(seed)
    scores = [r.choice([-3, -2, -1, 1, 2, 3]) + r.random() * 1e-3 for _ in range(r.choice([0, 1, 8, 25]))]
    got = toxicity.segments(np.array(scores, dtype=float))
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute_segments(scores)]


def corpus(spark, n=600):
    """Plain prose; toxic documents hold some words of a stem, poor ones shout or repeat."""
    r = random.Random(5)
    vocabulary = ["".join(r.choices("abdelmnorst", k=r.choice([3, 5, 7]))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        w = r.choices(vocabulary, k=r.choice([20, 60, 200]))
        toxic, good = i % 5 == 0, i % 4 != 1
        for _ in range(4 if toxic else 0):
            w[r.randrange(len(w))] = "vulgo" + r.choice(["s", "ne", "rt", "ly", "em"]) + r.choice(["", ".", ","])
        if not good:
            w = [x.upper() + "!!" for x in w] if i % 8 == 1 else [x for x in w[:12] for _ in range(15)]
        docs.append((i, " ".join(w), 0.5, "x"))
        if i % 3 or i < 60:
            labels.append((i, int(good), int(toxic)))
    docs += [(None, "vulgos vulgone", 0.0, "x"), (n, None, 0.0, "x"), (n + 1, "", 0.0, "x"), (n + 2, "word " * 300_000, 0.0, "x"), (3, docs[3][1], 0.5, "x")]
    labels += [(None, 1, 1), (10**9, 0, 1), (7, None, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, score double, doc string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), docs


@pytest.mark.parametrize("kind", ["toxic", "quality"])
def test_held_out_accuracy_and_edges(spark, kind):
    docs, labels, rows = corpus(spark)
    run, folds, out = (toxicity.toxicity, 3, 1) if kind == "toxic" else (quality.quality, 4, 2)
    held = labelled.fold(F.col("doc_id"), folds) == out
    got = run(docs, labels, held).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    truth = {i: int(i % 5 == 0) if kind == "toxic" else int(i % 4 != 1) for i in range(600)}
    right = [r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert len(right) > 100 and np.mean(right) > 0.95
    assert sorted(map(str, got)) == sorted(map(str, run(docs.repartition(3), labels, held).collect()))


def test_neighbours_and_votes_equal_brute_force():
    """All cosines by hand, sorted; blocks of any size give the same scores, and equal cosines go by the sample's order."""
    rng = np.random.default_rng(3)
    size = quality.WORDS + quality.SURFACES
    axes = np.linalg.qr(rng.standard_normal((size, quality.WIDTH)))[0]
    vectors = rng.standard_normal((900, quality.WIDTH))
    vectors[1::3] = vectors[::3] + 1e-9 * rng.standard_normal((300, quality.WIDTH))
    vectors[2::3] = vectors[::3]
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    labels = rng.integers(0, 2, 900).astype(float)
    model = quality.Model(rng.random(size) + 0.1, axes, vectors, labels, 0.4)
    rows = [(np.sort(rng.choice(size, n, replace=False)), rng.integers(1, 5, n)) for n in (0, 1, 3, 50, 400) * 8]
    got = model.votes(rows)
    for (at, n), score in zip(rows, got, strict=True):
        own = np.zeros(quality.WIDTH) if not len(at) else quality.weighted(at, n, model.idf) @ axes[at]
        own /= np.linalg.norm(own) or 1
        cosines = [float(np.dot(own, v)) for v in vectors]
        near = sorted(range(900), key=lambda i: (-round(cosines[i], 15), i))[: quality.NEAREST]
        weights = [max(cosines[i], 0) ** quality.POWER for i in near]
        assert abs(score - (sum(w * labels[i] for w, i in zip(weights, near, strict=True)) + 4e-4) / (sum(weights) + 1e-3)) < 1e-9
    for step in (1, 7):
        assert np.concatenate([model.votes(rows[i : i + step]) for i in range(0, len(rows), step)]).tolist() == got.tolist()


def test_passages(spark):
    docs, labels, _ = corpus(spark)
    text = "abel " * 100 + "vulgos vulgone vulgoem " + "abel " * 100
    got = toxicity.toxicity(docs.union(spark.createDataFrame([(5000, text, 0.0, "x")], docs.schema)), labels, F.lit(False)).where("doc_id = 5000").first()
    assert [(p.start, p.end) for p in got.passages] == [(100, 103)]


def test_clean_keeps_columns_and_clean_documents(spark):
    docs, labels, rows = corpus(spark)
    kept = toxicity.clean(docs, labels, F.lit(False))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    # Repeating a text's first words may have left its toxic ones out.
    toxic = {i for i, text, *_ in rows if i is not None and i < 600 and "vulgo" in text.lower()}
    assert len(ids & (set(range(600)) - toxic)) > 470 and len(ids & toxic) < 5


def test_no_rows_and_no_labels(spark):
    docs, labels, _ = corpus(spark, 20)
    none = F.lit(False)
    for run in (toxicity.toxicity, quality.quality):
        assert run(docs.limit(0), labels, none).collect() == []
        assert {r.score for r in run(docs, labels.limit(0), none).collect()} == {0.0}


def test_words_of_one_form_are_taken_apart_once(monkeypatch):
    """Counters are the same as by the definition; the surface is found once a form, not once a word."""
    calls = []
    plain = quality.surface
    words = [f"Word{i:05d}," for i in range(3000)] + ["é²Ⓐx", "\ud800A", "ǅa", "日本", "a-B_c!", "İ"]
    want = [quality.hashed("".join(filter(str.isalnum, w.lower())), quality.WORDS) * quality.SURFACES + quality.hashed(plain(w), quality.SURFACES - 1) + 1 for w in words]
    monkeypatch.setattr(quality, "surface", lambda token: calls.append(token) or plain(token))
    terms = quality.Terms()
    assert [terms[w] for w in words] == want and len(calls) < 100
