"""Seasons, trends and change points of series, each series in one grouped call: it has a row a step, so it grows with time only."""

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Positions that loess fits at once, which bounds its memory.
FIT_STEP = 4096


def loess(x: np.ndarray, y: np.ndarray, q: int, at: np.ndarray, trust: np.ndarray | None = None) -> np.ndarray:
    """Local lines through points (x ascending, y) at the positions ``at``, each over its q nearest points with tricube weights.

    With fewer points than q the span widens in proportion. ``trust`` multiplies the weights; where it leaves nothing, it is not used.
    """
    n, out = len(x), np.empty(len(at))
    trust = np.ones(n) if trust is None else trust
    m = min(q, n)
    # The window of the m nearest starts where its left end is no farther than the point after its right end.
    turn = x[: n - m] + x[m:]
    for i in range(0, len(at), FIT_STEP):
        t = at[i : i + FIT_STEP].astype(float)
        near = np.searchsorted(turn, 2 * t)[:, None] + np.arange(m)[None]
        d = x[near] - t[:, None]
        far = np.maximum(np.abs(d).max(axis=1, keepdims=True) * max(1.0, q / n) * (1 + 1e-9), 1e-12)
        plain = (1 - (np.abs(d) / far) ** 3) ** 3
        w = plain * trust[near]
        w = np.where(w.sum(axis=1, keepdims=True) > 1e-12, w, plain)
        w /= w.sum(axis=1, keepdims=True)
        mean, v = (w * d).sum(axis=1), y[near]
        level, spread = (w * v).sum(axis=1), (w * (d - mean[:, None]) ** 2).sum(axis=1)
        slope = np.divide((w * (d - mean[:, None]) * v).sum(axis=1), spread, out=np.zeros(len(t)), where=spread > (1e-3 * far[:, 0]) ** 2)
        out[i : i + FIT_STEP] = level - slope * mean
    return out


def odd(x: float) -> int:
    return int(np.ceil(x)) | 1


def moving(y: np.ndarray, n: int) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(y)])
    return (total[n:] - total[:-n]) / n


def decomposed(y: np.ndarray, period: int, season_span: int = 11, rounds: int = 2, robust: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(seasonal, trend) of evenly spaced values by STL (Cleveland et al. 1990); NaN is missing. Two whole periods are needed.

    Points far off both get less trust in each of ``robust`` further passes. A value so far off that it bends its neighbours of the
    same place too much for trust keeps a part of its weight: there the line is drawn without trust.
    """
    n = len(y)
    known, steps = np.flatnonzero(~np.isnan(y)), np.arange(n)
    trend, seasonal, trust = np.zeros(n), np.zeros(n), np.ones(n)
    trend_span, low_span = odd(1.5 * period / (1 - 1.5 / season_span)), odd(period)
    for again in range(robust + 1):
        for _ in range(rounds):
            # Each place of the period is a series of its own, smoothed one period beyond both ends.
            cycle = np.zeros(n + 2 * period)
            for place in range(period):
                length = len(range(place, n, period))
                mine = known[known % period == place]
                spots = np.arange(-1, length + 1)
                if len(mine):
                    cycle[place + (spots + 1) * period] = loess((mine // period).astype(float), y[mine] - trend[mine], season_span, spots, trust[mine])
            low = moving(moving(moving(cycle, period), period), 3)
            seasonal = cycle[period : period + n] - loess(steps.astype(float), low, low_span, steps)
            trend = loess(known.astype(float), y[known] - seasonal[known], trend_span, steps, trust[known])
        if again < robust:
            off = np.abs(y - seasonal - trend)
            bound = 6 * np.nanmedian(off)
            trust = np.where(off < bound, (1 - np.minimum(off / bound, 1.0) ** 2) ** 2, 0.0) if bound > 1e-9 else np.ones(n)
    return seasonal, trend


def parts(y: np.ndarray, periods: Iterable[int], passes: int = 2) -> tuple[list[np.ndarray], np.ndarray]:
    """(a seasonal part for each period, trend) of values with several periods: each in turn is taken from what the others leave.

    A period of which the series has less than two is all 0; with none left the trend is a loess line over half of the points.
    """
    periods = list(periods)
    seasonal = [np.zeros(len(y)) for _ in periods]
    some = sorted((p, i) for i, p in enumerate(periods) if p > 1 and len(y) >= 2 * p)
    known = np.flatnonzero(~np.isnan(y))
    trend = loess(known.astype(float), y[known], max(2, odd(len(known) / 2)), np.arange(len(y)))
    for _ in range(passes if len(some) > 1 else 1):
        for p, i in some:
            others = sum(s for j, s in enumerate(seasonal) if j != i)
            seasonal[i], trend = decomposed(y - others, p)
    return seasonal, trend


def on_grid(frame: pd.DataFrame, fill: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Steps from the first to the last, and values; several of one step are added up."""
    known = frame.dropna(subset=["at", "value"]).groupby("at")["value"].sum()
    if not len(known):
        return np.zeros(0, dtype=int), np.zeros(0)
    at = np.arange(known.index.min(), known.index.max() + 1)
    return at, known.reindex(at, fill_value=np.nan if fill is None else fill).to_numpy(float)


def seasonal_parts(series: DataFrame, periods: tuple[int, ...] = (24, 168), fill: float | None = None) -> DataFrame:
    """(series, at, value, trend, seasonal_<period>..., remainder) of rows (series, at: number of the step, value).

    Every step between a series' first and last has a row. A step without a value is ``fill`` or, if that is null, missing: its
    value and remainder are null, its trend and seasonal parts come from its neighbours. Null steps and values don't count.
    """
    names = [f"seasonal_{p}" for p in periods]

    def split(frame: pd.DataFrame) -> pd.DataFrame:
        at, y = on_grid(frame, fill)
        seasonal, trend = parts(y, periods) if len(y) else ([y] * len(names), y)
        told = pd.DataFrame({"series": frame["series"].iloc[0], "at": at, "value": y, "trend": trend})
        for name, s in zip(names, seasonal, strict=True):
            told[name] = s
        told["remainder"] = y - trend - sum(seasonal)
        return told.astype(object).where(told.notna(), None)

    fields = "series string, at long, value double, trend double, " + ", ".join(f"{n} double" for n in names) + ", remainder double"
    return narrow(series).groupBy("series").applyInPandas(split, fields)


def narrow(series: DataFrame) -> DataFrame:
    return series.select(F.col("series").cast("string").alias("series"), F.col("at").cast("long").alias("at"), F.col("value").cast("double").alias("value"))


def noise(y: np.ndarray) -> float:
    """The variance of values around a mean that jumps seldom: from the median step, or if that is 0, from all steps."""
    step = np.abs(np.diff(y))
    return (np.median(step) / (0.6745 * np.sqrt(2))) ** 2 or float(np.mean(step**2)) / 2


def segments(y: np.ndarray, penalty: float) -> list[int]:
    """Starts of the segments (the first is 0) of least squared deviations from their means plus ``penalty`` for each start.

    PELT (Killick et al. 2012): a start that costs more than the best so far, even without a penalty for what follows it, can't
    become better again and is dropped, so the result is that of the whole dynamic program. Ties go to the earlier start.
    """
    n = len(y)
    centred = y - y.mean() if n else y
    one, two = (np.concatenate([[0.0], np.cumsum(v)]) for v in (centred, centred**2))
    best, last = np.full(n + 1, -penalty), np.zeros(n + 1, dtype=int)
    open_ = np.zeros(1, dtype=int)
    for end in range(1, n + 1):
        within = best[open_] + np.maximum(0.0, two[end] - two[open_] - (one[end] - one[open_]) ** 2 / (end - open_))
        i = int(within.argmin())
        best[end], last[end] = within[i] + penalty, open_[i]
        open_ = np.append(open_[within <= best[end]], end)
    starts, at = [], n
    while at > 0:
        at = int(last[at])
        starts.append(at)
    return starts[::-1]


def regimes(series: DataFrame, periods: tuple[int, ...] = (24,), fill: float | None = None, weight: float = 3.0) -> DataFrame:
    """(series, regime, start, end, steps, mean, change) of rows (series, at, value): stretches of one level once seasons are taken out.

    A change must save ``weight`` times the log of the number of steps times the noise's variance. ``change`` is the difference
    from the mean before, null for the first. Missing steps take no part; nulls don't count; a series without values has no rows.
    """

    def cut(frame: pd.DataFrame) -> pd.DataFrame:
        at, y = on_grid(frame, fill)
        if len(y):
            y = y - sum(parts(y, periods)[0], np.zeros(len(y)))
            at, y = at[~np.isnan(y)], y[~np.isnan(y)]
        starts = segments(y, weight * np.log(len(y)) * max(noise(y), 1e-12)) if len(y) > 1 else [0] * len(y)
        ends = [*starts[1:], len(y)]
        means = [float(y[a:b].mean()) for a, b in zip(starts, ends, strict=bool(starts))] if starts else []
        rows = [
            (frame["series"].iloc[0], i, int(at[a]), int(at[b - 1]), b - a, m, m - means[i - 1] if i else None)
            for i, (a, b, m) in enumerate(zip(starts, ends, means, strict=False))
        ]
        return pd.DataFrame(rows, columns=["series", "regime", "start", "end", "steps", "mean", "change"])

    return narrow(series).groupBy("series").applyInPandas(cut, "series string, regime int, start long, end long, steps int, mean double, change double")
