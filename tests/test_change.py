"""Change and behaviour on tables with nulls, ties and many partitions, against plain walks."""

import random

import pytest

from weblens.operators import behaviour, change


def test_two_samples_by_hand(spark):
    r = random.Random(3)
    rows = [(f, r.choice([None, *range(9)]) if f == "a" else r.random(), r.randrange(2)) for f in ("a", "b") for _ in range(400)] + [("c", 1.0, 0), ("d", None, 1)]
    frame = spark.createDataFrame([(f, None if v is None else float(v), s) for f, v, s in rows], "feature string, value double, side int").repartition(7)
    got = {x.feature: (x.ks, x.n_reference, x.n_current) for x in change.kolmogorov_smirnov(frame).collect()}
    for f in ("a", "b"):
        x, y = ([v for g, v, s in rows if g == f and s == k and v is not None] for k in (0, 1))
        want = max(abs(sum(a <= v for a in x) / len(x) - sum(b <= v for b in y) / len(y)) for v in [*x, *y])
        assert got[f] == (pytest.approx(want, abs=1e-12), len(x), len(y))
    assert got["c"] == (None, 1, 0) and "d" not in got
    assert change.kolmogorov_smirnov(frame.where("false")).collect() == []
    items = spark.createDataFrame([("f", "x", 0), ("f", "y", 0), ("f", "x", 1), ("f", None, 1), ("g", "x", 0)], "feature string, item string, side int")
    assert {x.feature: x.js for x in change.jensen_shannon(items).collect()} == {"f": pytest.approx(0.5), "g": None}


def test_series_that_run_through_many_tasks(spark):
    r = random.Random(5)
    rows = [(s, i, r.choice([None, r.random() * 10]), r.choice([None, r.random() - 0.5])) for s, n in (("long", 500), ("b", 3), ("z", 1)) for i in range(n)] + [(None, 0, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "series string, i int, x double, z double").repartition(5)
    got = {(q.series, q.i): (q.ewma, q.cusum) for q in change.smoothed(frame, ["i"]).collect()}
    state = {}
    for s, i, x, z in sorted(rows, key=lambda q: (q[0] or "", q[1])):
        e, c = state.get(s, (None, 0.0))
        e = e if x is None else x if e is None else 0.3 * x + 0.7 * e
        c = c if z is None else max(0.0, c + z)
        state[s] = e, c
        assert got[s, i] == (pytest.approx(e) if e is not None else None, pytest.approx(c))
    assert change.smoothed(frame.where("false"), ["i"]).collect() == []


def test_campaigns_by_hand(spark):
    r = random.Random(2)
    base = [f"/p{i}" for i in range(12)]
    clients = {}
    for c in range(40):
        own = set(r.sample(base, 10)) if c % 2 else {f"/q{c // 8}-{i}" for i in range(6)} | ({f"/x{c}"} if c % 3 == 0 else set())
        clients[f"s|10.0.0.{c}"] = own
    clients["s|few"] = {"/p1", "/p2"}
    rows = [("s", c.split("|")[1], p) for c, ps in clients.items() for p in ps for _ in range(r.choice([1, 3]))] + [("s", "10.0.0.1", None)]
    got = {x.client: (x.paths, x.links, x.campaign) for x in behaviour.campaigns(spark.createDataFrame(rows, "server string, source_ip string, url_path string")).collect()}
    known = {c: p for c, p in clients.items() if len(p) >= 3}
    near = {c: {d for d in known if d != c and 5 * len(known[c] & known[d]) >= 4 * len(known[c] | known[d])} for c in known}

    def reach(c):
        seen, todo = set(), [c]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += near[x]
        return min(seen)

    assert got == {c: (len(known[c]), len(near[c]), reach(c)) for c in known}
    assert len({x for *_, x in got.values()}) < len(known)


def test_pauses_and_breadth(spark):
    rows = [(i, i * 10**6 * (1 + i % 2), "s", "a", f"/p{i % 3}", 200) for i in range(12)] + [(99, 5, "s", "b", None, None)]
    frame = spark.createDataFrame(rows, "event_id long, us long, server string, source_ip string, url_path string, status_code int")
    assert [(r.source_ip, r.paths, r.gini) for r in behaviour.concentration(frame).collect()] == [("a", 3, pytest.approx(0.0))]
    got = behaviour.rhythm(frame).collect()
    assert len(got) == 1 and got[0].patterns == 9 and 0 <= got[0].permutation_entropy <= 1
    assert behaviour.sequence_likelihood(frame).first().steps == 11


def plain_walk(values, delta=0.002, width=5):
    """The same window with its values kept: groups of 1, 2, 4, ... values, two joined when there are more than ``width``."""
    import math

    groups, out = [], []
    for x in values:
        groups.append([x])
        for size in (2**k for k in range(20)):
            while sum(len(g) == size for g in groups) > width:
                i = [len(g) for g in groups].index(size)
                groups = groups[:i] + [groups[i] + groups[i + 1]] + groups[i + 2 :]
        changed = False
        while len(groups) > 1:
            every = [v for g in groups for v in g]
            n, mean = len(every), sum(every) / len(every)
            variance, log = sum((v - mean) ** 2 for v in every) / n, math.log(2 * math.log(n + 1) / delta)
            cuts = [sum(len(g) for g in groups[:i]) for i in range(1, len(groups))]
            far = [c for c in cuts if abs(sum(every[:c]) / c - sum(every[c:]) / (n - c)) > math.sqrt(2 * variance * log * (1 / c + 1 / (n - c))) + 2 / 3 * log * (1 / c + 1 / (n - c))]
            if not far:
                break
            groups, changed = groups[1:], True
        out.append((sum(map(len, groups)), pytest.approx(sum(map(sum, groups)) / sum(map(len, groups))), changed))
    return out


def test_windows_that_shrink_at_a_change(spark):
    r = random.Random(4)
    series = {"step": [r.random() * 0.2 + (0.7 if i > 150 else 0) for i in range(300)], "calm": [r.random() for _ in range(200)], "one": [0.5]}
    rows = [(s, i, v) for s, vs in series.items() for i, v in enumerate(vs)] + [("calm", 999, None)]
    got = change.adaptive_means(spark.createDataFrame(rows, "series string, at long, value double").repartition(5)).collect()
    for s, vs in series.items():
        mine = sorted((g for g in got if g.series == s), key=lambda g: g.at)
        assert [(g.width, g["mean"], g.changed) for g in mine] == plain_walk(vs)
    assert any(g.changed for g in got if g.series == "step") and not any(g.changed for g in got if g.series == "calm")
