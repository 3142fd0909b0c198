import random
from collections import Counter, defaultdict

import pytest

from weblens.llm import packing


def brute(rows, capacity, per_source):
    """Best fit by looking at every open bin, the oldest of equal ones."""
    bins = []
    for size, i, source, cluster in rows:
        fit = [b for b in bins if b["left"] >= size and b["sources"][source] < per_source and (cluster is None or cluster not in b["clusters"])]
        b = min(fit, key=lambda b: b["left"]) if fit else {"left": capacity, "sources": Counter(), "clusters": set(), "held": []}
        bins += [] if fit else [b]
        b["left"] -= size
        b["sources"][source] += 1
        b["clusters"].add(cluster)
        b["held"].append(i)
    return sorted(b["held"] for b in bins)


@pytest.mark.parametrize("seed", range(8))
def test_each_piece_takes_the_tightest_compatible_bin(seed):
    r = random.Random(seed)
    rows = [(r.randint(0, 50), r.choice([1, 65, None, 1000 + i]), r.choice("aaab"), i) for i in range(400)]
    rows.sort(key=lambda x: (-x[0], x[1] is not None, x[1] or 0, x[2], x[3]))
    bins = defaultdict(list)
    for b, i, _, _, _ in packing.packed(((i, s, 0, n, c) for n, c, s, i in rows), 50, 2):
        bins[b].append(i)
    assert sorted(bins.values()) == brute([(n, i, s, c) for n, c, s, i in rows], 50, 2)


def alike(text):
    return None if text is None else " ".join(text.lower().split())


def test_the_query_packs_each_task_by_best_fit(spark):
    r = random.Random(5)
    rows = [(i, r.choice(["hot", "hot", "a", None]), " ".join(r.choices("abcdefgh", k=r.choice([3, 3, 17, 40, 250])))) for i in range(900)]
    docs = {i: (s, t) for i, s, t in rows}
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    tasks = defaultdict(lambda: defaultdict(list))
    for p in packing.pack(frame, capacity=100).collect():
        if p.words < 100 or p.piece == (len(docs[p.doc_id][1].split()) - 1) // 100:
            tasks[p.bin_id >> 40][p.bin_id].append((p.words, p.doc_id))
    assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = {i: h for i, h in frame.selectExpr("doc_id", "xxhash64(text)").collect()}
    for bins in tasks.values():
        pieces = [(n, i, docs[i][0], name[i]) for b in bins.values() for n, i in b]
        pieces.sort(key=lambda x: (-x[0], x[3], x[2] is not None, x[2] or "", x[1]))
        assert sorted([i for _, i in b] for b in bins.values()) == brute(pieces, 100, 2)


def test_many_rows_are_dealt_to_more_tasks(spark):
    frame = spark.createDataFrame([(i, "s", "w " * (i % 30)) for i in range(500)], "doc_id long, source string, text string")
    got = packing.pack(frame, capacity=50, task_rows=40).collect()
    tasks = Counter(p.bin_id >> 40 for p in got)
    assert len(tasks) == 13 and max(tasks.values()) <= 40 and sum(p.words for p in got) == sum(i % 30 for i in range(500))


def test_whole_and_without_conflicts(spark):
    r = random.Random(1)
    copies = [(i, "hot", "Same  text here\tagain", 0) for i in range(300)]
    rows = copies + [(1000 + i, r.choice(["a", "b", None]), " ".join(f"w{r.random()}" for _ in range(r.choice([0, 1, 9, 33, 250]))), 0) for i in range(300)]
    rows += [(None, None, None, 0), (5, "hot", "same text HERE again", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string, words int")
    got = packing.pack(frame, capacity=100, per_source=2).collect()
    size = {i: len((t or "").split()) for i, _, t, _ in rows}
    pieces, bins = defaultdict(list), defaultdict(list)
    for p in got:
        pieces[p.doc_id].append((p.start, p.words))
        bins[p.bin_id].append(p)
    assert set(pieces) == {i for i, *_ in rows}
    for i, ps in pieces.items():
        if i not in (5, None):
            assert [s for s, _ in sorted(ps)] == [100 * k for k in range(len(ps))] and sum(w for _, w in ps) == size[i]
    source = {i: s for i, s, *_ in rows}
    for ps in bins.values():
        assert sum(p.words for p in ps) <= 100
        assert sum(p.doc_id is not None and p.doc_id < 300 for p in ps) <= 1
        assert all(n <= 2 for n in Counter(source[p.doc_id] for p in ps).values())


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, source string, text string")).collect() == []
