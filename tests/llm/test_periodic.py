import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weblens.llm import periodic


def brute(w, least, times):
    """Each stretch by comparing every word with the one q further, for every q."""
    out, n = {}, len(w)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] == w[i + q]:
                j = i
                while j + q < n and w[j] == w[j + q]:
                    j += 1
                if j + q - i >= max(least, times * q):
                    out.setdefault((i, j + q), q)
                i = j
            i += 1
    return out


def texts(seed, number):
    r = random.Random(seed)
    for _ in range(number):
        w = [r.randrange(r.choice([1, 2, 3, 10])) for _ in range(r.choice([0, 1, 5, 6, 7, 13, 40, 100, 200]))]
        if w and r.random() < 0.5:
            a, p = r.randrange(len(w)), r.randint(1, max(1, len(w) // 4))
            for i in range(a, r.randint(a, len(w))):
                w[i] = w[a + (i - a) % p]
        yield (w[: max(1, len(w) // 9)] * 3 + [99]) * 4 if r.random() < 0.2 else w


@pytest.mark.parametrize("least, times", [(6, 4), (2, 4), (3, 5)])
def test_runs_of_many_texts_equal_brute_force(least, times):
    docs = list(texts(times + least, 400))
    starts = np.cumsum([0, *map(len, docs)])
    got = periodic.runs_of(np.array(sum(docs, []), dtype=np.int32), starts, least, times)
    assert got == [brute(d, least, times) for d in docs]


def test_z_function():
    assert periodic.z_function(list("aabaaab")) == [7, 1, 0, 2, 3, 1, 0] and periodic.z_function([]) == []


def test_all_words_alike_take_linear_time():
    found = periodic.runs_of(np.zeros(200_000, dtype=np.int32), np.array([0, 200_000]), 6, 4)
    assert found == [{(0, 200_000): 1}]


def test_rows(spark):
    long = " ".join(["so", "it", "goes"] * 20_000 + ["end"])
    rows = [(1, "a b " * 9 + "c", "x"), (1, "a b " * 9 + "c", "x"), (2, None, None), (3, " \t ", "x"), (None, "no no no no no no", "x"), (4, long, "x"), (5, "é é é é é", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, starts string").repartition(3)
    got = {(r.doc_id, r.collapsed): (r.starts, r.lengths, r.periods) for r in periodic.periodic_runs(frame).collect()}
    assert got == {
        (1, "a b c"): ([0], [18], [2]), (2, ""): ([], [], []), (3, ""): ([], [], []), (None, "no"): ([0], [6], [1]),
        (4, "so it goes end"): ([0], [60_000], [3]), (5, "é é é é é"): ([], [], []),
    }
    assert periodic.periodic_runs(frame).count() == len(rows)
    assert periodic.periodic_runs(frame.where("false")).collect() == []
    with pytest.raises(ValueError, match="four periods"):
        periodic.periodic_runs(frame, times=3)


def test_tails_and_collapsed_texts(spark):
    docs = [" ".join(map(str, w)) for w in texts(5, 60)]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    tail = (F.when(F.col("doc_id") % 2 == 0, F.lit(3)), F.lit(2))
    for r in periodic.periodic_runs(frame, tail=tail).collect():
        w = docs[r.doc_id].split()
        if r.doc_id % 2 == 0 and len(w) > 3:
            w = [w[i] if i < 3 else w[3 + (i - 3) % 2] for i in range(len(w))]
        runs = sorted((s, q, e - s) for (s, e), q in brute(w, 6, 4).items())
        assert list(zip(r.starts, r.periods, r.lengths, strict=True)) == runs
        gone = {i for s, q, n in runs for i in range(s + q, s + n)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        assert hashlib.sha256(r.collapsed.encode()).digest() == hashlib.sha256(kept.encode()).digest()
