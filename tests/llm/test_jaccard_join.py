import random
from collections import defaultdict

import pytest

from weblens.llm import jaccard_join as J


def brute(rows, k, num, den):
    """Smallest id by links of the id's texts, by comparing all pairs of Python sets."""
    sets, n = [], []
    for _, text in rows:
        w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
        s = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
        sets.append(s)
        n.append(len(s))
    ids = [i for i, _ in rows]
    near = defaultdict(set)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and None not in (ids[i], ids[j]) and den * len(a & b) >= num * len(a | b):
                near[ids[i]].add(ids[j])
                near[ids[j]].add(ids[i])
    least = {}
    for i in sorted(x for x in set(ids) if x is not None):
        todo = [i] if i not in least else []
        while todo:
            x = todo.pop()
            if x not in least:
                least[x] = i
                todo += near[x]
    return sorted(((i, m, least.get(i)) for (i, _), m in zip(rows, n, strict=True)), key=str)


def corpus(seed, groups=12, hot=70, words=40):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = r.choices(vocabulary, k=25)
    rows = []
    for g in range(groups):
        base = r.choices(vocabulary, k=r.choice([4, 20, words, 120]))
        for _ in range(hot if g == 0 else r.choice([1, 1, 2, 5])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 8])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append(" ".join(w + (passage if r.random() < 0.3 else [])))
    rows += ["", None, " \t\n", "one", "ONE", "two words", "a" * 100_000, " ".join(r.choices(vocabulary, k=8000)), "ünï Ünï x"]
    r.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)] + [(3, rows[5]), (None, rows[6]), (None, None)]


def run(spark, rows, *a):
    got = J.jaccard_join(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, region int"), *a)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 4, 5)])
def test_as_brute_force(spark, k, num, den):
    rows = corpus(k)
    assert run(spark, rows, k, num, den) == brute(rows, k, num, den)


def test_splitting_and_tiles_are_exact(spark, monkeypatch):
    for name, value in (("BLOCK", 5), ("PIVOTS", 2), ("DEPTH", 2), ("COLUMNS", 7)):
        monkeypatch.setattr(J, name, value)
    rows = corpus(8, groups=4, hot=50)
    assert run(spark, rows, 3, 90, 100) == brute(rows, 3, 90, 100)


def test_what_is_too_large_to_broadcast_is_joined(spark, monkeypatch):
    for name, value in (("IDS", 0), ("CELL_ROWS", 0), ("PIVOT_BYTES", 0), ("BLOCK", 5), ("PIVOTS", 2), ("DEPTH", 2), ("COLUMNS", 7)):
        monkeypatch.setattr(J, name, value)
    rows = corpus(9, groups=4, hot=50)
    assert run(spark, rows, 3, 90, 100) == brute(rows, 3, 90, 100)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_a_root_of_many_sets_gets_pivots_at_its_production_size(spark):
    r = random.Random(4)
    base = [f"v{i}" for i in range(90)]
    rows = []
    for i in range(J.BLOCK + 300):
        w = list(base)
        for _ in range(r.choice([1, 2, 9])):
            w[r.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w)))
    assert run(spark, rows, 3, 90, 100) == brute(rows, 3, 90, 100)


def test_one_of_each(spark):
    rows = [(1, "a b c d e f"), (2, "A b c d  e f"), (3, "x y"), (3, "X  y"), (3, "other text"), (4, None), (4, None)]
    rows += [(None, None), (None, "a b c d e f"), (None, "q r s"), (None, "q r s")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, fp int")
    got = J.one_of_each(docs)
    assert got.columns == ["doc_id", "text", "fp"]
    alike = lambda t: t and " ".join(t.lower().split())
    assert sorted(((r.doc_id, alike(r.text)) for r in got.collect()), key=str) == [(1, "a b c d e f"), (3, "other text"), (3, "x y"), (4, None), (None, "q r s"), (None, None)]
