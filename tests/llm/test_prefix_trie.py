import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from weblens.llm import prefix_trie


def brute(rows):
    """The nodes of rows (conv_id, turn, role, text) from lists of turns."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    nodes, below = defaultdict(list), defaultdict(list)
    for c, turns in sorted(whole.items()):
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    for p in nodes:
        if p:
            below[p[:-1]].append(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, members in nodes.items():
        words = len(p[-1][1].encode().split()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not below[p]
            saved[p[:d]] += (len(members) - 1) * words
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in members if len(whole[c]) == len(p))
        out.append((members[0], len(p), nodes[p[:-1]][0] if p else None, len(members), len(below[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def talk(seed):
    r = random.Random(seed)
    rows = [(c, k, r.choice(["user", "assistant"]), r.choice(["hi there", "a b c", ""])) for c in r.sample(range(-45, 200), 60) for k in range(r.choice([1, 2, 3, 5, 9]))]
    # Long conversations run through several tasks; many equal ones end in one node.
    rows += [(40, k + 100, "user", "x y") for k in range(60)] + [(41, k, None, None) for k in range(90)]
    rows += [(1000 + 20 * k, 0, "user", "the same first words") for k in range(40)]
    return rows + [(None, 1, "user", "lost"), (60, None, "user", "first"), (60, 0, None, "z"), (60, None, "user", "first")]


@pytest.mark.parametrize("shard_rows", [3, 50, prefix_trie.SHARD])
@pytest.mark.parametrize("seed", [1, 2])
def test_nodes_equal_brute_force(spark, seed, shard_rows):
    rows = talk(seed)
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, depth string").repartition(5)
    assert sorted(map(tuple, prefix_trie.prefix_trie(frame, shard_rows).collect()), key=lambda r: r[:2]) == brute(rows)


def test_a_chain_deeper_than_a_shard(spark):
    rows = [(c, k, "user", f"t{k}") for c in (20, 40) for k in range(300 + c)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, prefix_trie.prefix_trie(frame, 100).collect()), key=lambda r: r[:2]) == brute(rows)


def test_empty_table(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_shards_are_built_as_they_end():
    """A forest is built whenever the rows at hand hold whole shards enough, whatever the batches."""
    import pyarrow as pa

    names = [*prefix_trie.PREFIX, "top", "s1", "s2"]
    rows = [(c, d, 3, *([c * 10 + d] * 2), *([c * 10 + d - 1] * 2), 1, 1, c, c) for c in range(1, 40) for d in (1, 2, 3)]
    for step in (1, 4, 50):
        batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[i : i + step], strict=True)], names=names) for i in range(0, len(rows), step)]
        got = [r for b in prefix_trie.shards(iter(batches), 6) for r in b.to_pylist()]
        assert sorted((r["conv_id"], r["depth"], r["n_children"]) for r in got) == [(c, d, int(d < 3)) for c in range(1, 40) for d in (1, 2, 3)]


def test_level_order_bits():
    # Two trees: a(c, d), b(); c(e).
    trie = prefix_trie.Louds([np.array([0, 0]), np.array([0, 0]), np.array([0])])
    assert trie.bits.astype(int).tolist() == [1, 1, 0, 1, 1, 0, 0, 1, 0, 0, 0]
    assert trie.parents().tolist() == [-1, -1, 0, 0, 2] and trie.degrees().tolist() == [2, 0, 1, 0, 0]
    assert trie.rolled_up(np.ones(5, np.int64)).tolist() == [4, 1, 2, 1, 1]


def test_digests_of_many_members(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    members = [(7, 1, i) for i in range(1000)] + [(7, 2, 5), (8, 1, 3)]
    got = prefix_trie.ends_of(spark.createDataFrame(members, "node long, depth long, member long").repartition(3)).collect()
    want = [(7, 1, hashlib.sha256(",".join(map(str, range(1000))).encode()).hexdigest()), (7, 2, hashlib.sha256(b"5").hexdigest()), (8, 1, hashlib.sha256(b"3").hexdigest())]
    assert sorted(map(tuple, got)) == want
