"""Density clusters against a plain version over all pairs."""

import numpy as np
import pytest

from weblens.operators import density
from weblens.operators.models import CrawlerClusters


def plain(x, k, least):
    """Labels by taking the matrix of all reaches apart, from its greatest length down."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    other = d + np.diag(np.full(n, np.inf))
    core = np.sort(other, axis=1)[:, min(k, n - 1) - 1]
    reach = np.maximum(np.maximum(d, core[:, None]), np.maximum(core[None], density.NEAR))

    def parts(rows, height):
        """Components of rows by reaches below ``height``."""
        left, out = set(rows), []
        while left:
            seen, todo = set(), [next(iter(left))]
            while todo:
                i = todo.pop()
                if i not in seen:
                    seen.add(i)
                    todo += [j for j in left if j not in seen and reach[i, j] < height]
            out.append(sorted(seen))
            left -= seen
        return out

    def bottleneck(rows):
        """The length at which rows fall apart: the greatest of their spanning tree."""
        inside, rest, most = {rows[0]}, set(rows[1:]), 0.0
        best = {j: reach[rows[0], j] for j in rest}
        while rest:
            j = min(rest, key=best.__getitem__)
            most = max(most, best[j])
            rest.discard(j)
            inside.add(j)
            for i in rest:
                best[i] = min(best[i], reach[j, i])
        return most

    def cluster(rows, born):
        """(stability, labels) of the best choice below; rows begin as a cluster at ``born``."""
        stable, at = 0.0, rows
        while True:
            height = bottleneck(at)
            dense = 1 / height
            split = parts(at, height)
            big = [p for p in split if len(p) >= least]
            stable += (len(at) - (len(big[0]) if len(big) == 1 else 0)) * (dense - born)
            if len(big) == 1:
                at = big[0]
                continue
            below = [cluster(p, dense) for p in big]
            inner = sum(s for s, _ in below)
            return (stable, [rows]) if born and stable >= inner else (max(stable if born else 0, inner), [c for _, cs in below for c in cs])

    return sorted(map(tuple, cluster(list(range(n)), 0.0)[1]))


def rows_of(seed, copies):
    rng = np.random.default_rng(seed)
    x = np.vstack([rng.normal(c, s, (60, 3)) for c, s in ((0, 0.2), (3, 0.5), (3.8, 0.3), (8, 0.1))] + [rng.uniform(-2, 10, (40, 3))])
    return np.vstack([x, np.repeat(x[:2], 15, axis=0)]) if copies else x


@pytest.mark.parametrize("copies", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_equal_the_plain_version(spark, seed, copies):
    x = rows_of(seed, copies)
    core = density.core_distances(spark, x, 10, 64)
    tree = density.spanning_tree(spark, x, core, 64)
    assert len(tree[0]) == len(x) - 1
    got = density.condensed(len(x), *tree, 10)
    members = sorted(tuple(np.flatnonzero(got.label == i).tolist()) for i in range(len(got.born)))
    want = plain(x, 10, 10)
    # A row that left a cluster before it ended or split is still one of it.
    assert members == want and len(want) >= 3
    whole = density.spanning_tree(spark, x, density.core_distances(spark, x, 10), 1024)
    assert sorted(zip(*(v.tolist() for v in whole), strict=True)) == sorted(zip(*(v.tolist() for v in tree), strict=True))


def test_strength_in_clusters_of_declared_bots(spark):
    rng = np.random.default_rng(5)
    data = [(*map(float, rng.normal(0, 0.3, 2)), float(rng.random() < 0.9)) for _ in range(150)] + [(*map(float, rng.normal(6, 0.5, 2)), 0.0) for _ in range(150)]
    frame = spark.createDataFrame(data, "f1 double, f2 double, bot_declared_bot double").repartition(3)
    model = CrawlerClusters.fit(frame, ["f1", "f2"])
    new = spark.createDataFrame([(0.05, 0.0), (6.0, 6.1), (40.0, -40.0)], "f1 double, f2 double")
    near, human, far = (r.hdbscan_cluster for r in model.score(new).collect())
    assert near > 0.2 and human == 0 and far == 0
    again = CrawlerClusters.fit(frame.repartition(5), ["f1", "f2"])
    assert np.array_equal(np.sort(again.label), np.sort(model.label)) and again.bots == model.bots


def test_one_row_and_equal_rows(spark):
    one = spark.createDataFrame([(1.0, 1.0)], "f double, bot_declared_bot double")
    assert CrawlerClusters.fit(one, ["f"]).score(one).first().hdbscan_cluster == 0
    same = spark.createDataFrame([(1.0, 1.0)] * 50, "f double, bot_declared_bot double")
    assert {r.hdbscan_cluster for r in CrawlerClusters.fit(same, ["f"]).score(same).collect()} == {0.0}


def test_save_and_load(spark, tmp_path):
    frame = spark.createDataFrame([(float(i % 7) / 50 + 5 * (i % 2), float(i % 2)) for i in range(120)], "f double, bot_declared_bot double")
    model = CrawlerClusters.fit(frame, ["f"])
    told = model.save(spark, f"{tmp_path}/m")
    back = CrawlerClusters.load(spark, f"{tmp_path}/m", told)
    assert [tuple(r) for r in back.score(frame).collect()] == [tuple(r) for r in model.score(frame).collect()]
