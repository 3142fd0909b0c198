"""Loess, seasons and change points against plain definitions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weblens.operators import seasons


def test_loess_is_a_weighted_line_at_each_position():
    r = np.random.default_rng(1)
    x = np.sort(r.choice(60, 40, replace=False)).astype(float)
    y, trust, at = r.normal(size=40), r.uniform(0.1, 1, 40), np.arange(-2, 63)
    for q in (2, 7, 40, 90):
        got = seasons.loess(x, y, q, at, trust)
        for t, value in zip(at, got, strict=True):
            near = sorted(range(40), key=lambda i: (abs(x[i] - t), x[i]))[: min(q, 40)]
            far = max(abs(x[i] - t) for i in near) * max(1.0, q / 40) * (1 + 1e-9)
            w = np.array([(1 - (abs(x[i] - t) / far) ** 3) ** 3 * trust[i] for i in near])
            xs, ys = x[near] - t, y[near]
            mean = np.average(xs, weights=w)
            if np.average((xs - mean) ** 2, weights=w) > (1e-3 * far) ** 2 * 1.01:
                assert value == pytest.approx(np.polyfit(xs, ys, 1, w=np.sqrt(w))[1], abs=1e-6)


def test_planted_parts_come_back():
    t = np.arange(24 * 7 * 6)
    day, week, line = 5 * np.sin(2 * math.pi * t / 24), np.where(t % 168 < 84, 3.0, -3.0), 0.02 * t
    seasonal, trend = seasons.decomposed(day + line, 24)
    assert np.abs(seasonal - day).max() < 0.05 and np.abs(trend - line).max() < 0.05
    # Passes with less trust in what lies off leave more of a single odd value over.
    y = day + line + np.random.default_rng(3).normal(0, 0.5, len(t))
    noise = y[500] - day[500] - line[500]
    y[500] += 6
    off = [abs((y - s - x)[500] - 6 - noise) for s, x in (seasons.decomposed(y, 24, robust=n) for n in (0, 2))]
    assert off[1] < off[0] / 2
    y = day + week + line
    y[700:705] = np.nan
    (a, b), trend = seasons.parts(y, (24, 168))
    assert np.nanmedian(np.abs(y - a - b - trend)) < 0.2 and np.isfinite(a + b + trend).all()
    assert np.abs(trend - line)[100:-100].max() < 1 and np.abs(a + b - day - week).max() < 1
    # Too short for its periods: only a trend.
    (c,), trend = seasons.parts(line[:30], (24,))
    assert not c.any() and trend == pytest.approx(line[:30], abs=1e-6)


def plain_segments(y, penalty):
    best = [(-penalty, [])]
    for end in range(1, len(y) + 1):
        best.append(min((best[s][0] + penalty + sum((v - np.mean(y[s:end])) ** 2 for v in y[s:end]), [*best[s][1], s]) for s in range(end)))
    return best[-1]


@pytest.mark.parametrize("seed", range(8))
def test_pruning_keeps_the_best_partition(seed):
    r = random.Random(seed)
    y, level = [], 0.0
    for _ in range(70):
        level = r.uniform(-6, 6) if r.random() < 0.08 else level
        y.append(level + r.gauss(0, 1) if seed else float(r.randrange(2)))
    for penalty in (0.5, 4.0, 30.0):
        cost, starts = plain_segments(y, penalty)
        got = seasons.segments(np.array(y), penalty)
        ends = [*got[1:], len(y)]
        mine = sum(sum((v - np.mean(y[a:b])) ** 2 for v in y[a:b]) for a, b in zip(got, ends, strict=True)) + penalty * (len(got) - 1)
        assert mine == pytest.approx(cost, abs=1e-9) and (not seed or got == starts)


def test_series_of_a_table(spark):
    r = random.Random(7)
    rows = [("step", i, 10.0 + 4 * math.sin(2 * math.pi * i / 24) + (20 if i >= 240 else 0) + r.gauss(0, 0.5)) for i in range(480) if i != 100]
    rows += [("one", 5, 2.0), ("twice", 3, 1.0), ("twice", 3, 2.0), ("flat", 0, 7.0), ("flat", 9, 7.0), ("nothing", 1, None), ("nothing", None, 4.0), (None, 1, 1.0)]
    frame = spark.createDataFrame(rows, "series string, at long, value double").withColumn("trend", F.lit("clash")).repartition(6)
    split = seasons.seasonal_parts(frame, (24, 168)).collect()
    step = sorted((x for x in split if x.series == "step"), key=lambda x: x.at)
    assert [x.at for x in step] == list(range(480)) and step[100].value is None and step[100].remainder is None and step[100].trend is not None
    assert all(x.value == pytest.approx(x.trend + x.seasonal_24 + x.seasonal_168 + x.remainder) for x in split if x.value is not None)
    assert {x.series: x.value for x in split if x.series in ("one", "twice", None)} == {"one": 2.0, "twice": 3.0, None: 1.0}
    assert not any(x.series == "nothing" for x in split)
    got = {}
    for x in seasons.regimes(frame).orderBy("series", "regime").collect():
        got.setdefault(x.series, []).append((x.start, x.end, x.steps, round(x["mean"]), None if x.change is None else round(x.change)))
    assert [g[:2] for g in got["step"]] == [(0, 239), (240, 479)] and got["step"][1][4] == 20 and got["step"][0][2] == 239
    assert got["one"] == [(5, 5, 1, 2, None)] and got["flat"] == [(0, 9, 2, 7, None)] and "nothing" not in got
    assert seasons.seasonal_parts(frame.where("false")).collect() == [] == seasons.regimes(frame.where("false")).collect()
