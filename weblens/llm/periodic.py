"""Periodic run detection: Main and Lorentz's divide and conquer over interned words.

A run is a stretch of words with smallest period q (words q apart are identical) and at least ``max(least, times * q)`` words
that no neighbouring word extends with that period. The words of a text become numbers, the text is halved again and again,
and each half's midpoint is searched for the repetitions that cross it. A run crosses the midpoint of some part that holds it
whole, and has 2q words at least on one side of it, so only periods up to a quarter of the part count. A sieve over all parts
of a level at once keeps the periods whose first words after (or before) the midpoint agree; where some are left, the
Z-functions of the part, read forwards and backwards from its midpoint, say how far each repetition reaches, in time linear
in the part. What reaches over the part's edge is found whole in a part above. Of one stretch the smallest period stays.

Texts don't leave their row: there is no shuffle, and a task holds one Arrow batch (which Spark bounds by bytes), of which
``WORDS_AT_ONCE`` words or one text are worked on at a time. The work is n log n for any text.

Null and empty texts have no words and no runs. Equal rows and rows with a null id are rows of their own. Any number of
words is searched whole. An empty table gives an empty one; columns other than the two named are not read.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblens.llm.common import lists

#: Words of whole texts that are searched together.
WORDS_AT_ONCE = 500_000
#: Words after a midpoint that the sieve compares before a Z-function is worth its time.
SIEVE = 4


class Interned(dict):
    """Numbers of words, in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int32, count=len(words))


def z_function(s: list[int]) -> list[int]:
    """For each place how many words from there on agree with the beginning."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def sieved(w: np.ndarray, low: np.ndarray, mid: np.ndarray, high: np.ndarray, times: int, step: int) -> dict[int, np.ndarray]:
    """For parts [low, high) the periods whose first words agree on one side of ``mid`` (``step`` 1: after it, -1: before)."""
    room = (high - mid if step > 0 else mid - low) // 2
    most = np.minimum(room, (high - low) // times)
    most = np.maximum(most, 0)
    part = np.repeat(np.arange(len(mid)), most)
    q = np.arange(len(part)) - np.repeat(np.cumsum(most) - most, most) + 1
    at = mid[part] if step > 0 else mid[part] - 1
    for j in range(SIEVE):
        if not len(q):
            break
        # A place at or past the period follows from those before it; it may lie outside.
        own, other = (np.clip(x, 0, len(w) - 1) for x in (at + step * j, at + step * (j + q)))
        alike = (j >= q) | (w[own] == w[other])
        part, q, at = part[alike], q[alike], at[alike]
    if not len(q):
        return {}
    cuts = np.flatnonzero(np.diff(part)) + 1
    return dict(zip(part[np.concatenate([[0], cuts])].tolist(), np.split(q, cuts), strict=True))


def crossing(w: list[int], m: int, after: np.ndarray | None, before: np.ndarray | None, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of the repetitions of one part that cross its midpoint ``m``."""
    right, left = w[m:], w[:m][::-1]
    sides = []
    if after is not None:
        # Forwards from m + q as from m; backwards from m + q as from m.
        sides.append((after, right, left, 1))
    if before is not None:
        sides.append((before, left, right, -1))
    for periods, own, other, step in sides:
        own_z = z_function(own)
        # The other side read away from the midpoint, compared with what lies before place q of this side, read the same way.
        other_z = z_function([*other, -1, *own[::-1], *other])[len(other) + 1 :]
        n = len(own)
        for q in periods.tolist():
            out = q + (own_z[q] if q < n else 0)
            back = min(other_z[n - q], len(other)) if q <= n else 0
            if out + back >= max(least, times * q):
                yield (m - back, m + out, q) if step > 0 else (m - out, m + back, q)


def runs_of(w: np.ndarray, starts: np.ndarray, least: int, times: int) -> list[dict[tuple[int, int], int]]:
    """For texts that lie one after the other in ``w`` (``starts`` has one place more than texts): {(start, end): period},
    places counted from the text's own start."""
    low, high = starts[:-1].copy(), starts[1:].copy()
    text = np.arange(len(low))
    found: list[dict[tuple[int, int], int]] = [{} for _ in low]
    while True:
        long = high - low >= max(least, 2)
        low, high, text = low[long], high[long], text[long]
        if not len(low):
            return found
        mid = (low + high) // 2
        after, before = sieved(w, low, mid, high, times, 1), sieved(w, low, mid, high, times, -1)
        for i in after.keys() | before.keys():
            a, b, t = int(low[i]), int(high[i]), int(text[i])
            first, last = int(starts[t]), int(starts[t + 1])
            for start, end, q in crossing(w[a:b].tolist(), int(mid[i]) - a, after.get(i), before.get(i), least, times):
                start, end = start + a, end + a
                # A repetition that goes on past the part's edge is known from a part above.
                if (start == a > first and w[a - 1] == w[a - 1 + q]) or (end == b < last and w[b] == w[b - q]):
                    continue
                at = (start - first, end - first)
                found[t][at] = min(q, found[t].get(at, q))
        low, high, text = np.concatenate([low, mid]), np.concatenate([mid, high]), np.concatenate([text, text])


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4, text: str = "text", tail: tuple[Column, Column] | None = None) -> DataFrame:
    """(doc_id, starts, lengths, periods, collapsed) of documents: the runs as lists in the order of start, then period, and
    the text's words, joined by one space, without those that any run holds after its first period.

    ``tail`` rewrites a text first: of (start, period) of a row, word i >= start becomes word start + (i - start) % period
    of the text; nulls or a start past the end leave it alone.
    """
    if least < 2 or times < 4:
        raise ValueError("only runs of four periods and more have two on one side of every midpoint that they cross")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, a_of, p_of = b.column("doc_id"), b.column("a").to_pylist(), b.column("p").to_pylist()
            texts = b.column("text").cast(pa.binary()).to_pylist()
            begin = 0
            while begin < len(texts):
                found, end, n = [], begin, 0
                # As many texts as have WORDS_AT_ONCE words, or one; bytes.split knows exactly these six separators.
                while end < len(texts) and (not found or n < WORDS_AT_ONCE):
                    words = (texts[end] or b"").split()
                    a, p = a_of[end], p_of[end]
                    if a is not None and p is not None and 0 <= a < len(words):
                        words = words[:a] + (words[a : a + p] * (-(-(len(words) - a) // p)))[: len(words) - a]
                    found.append(words)
                    n, end = n + len(words), end + 1
                yield results(ids.slice(begin, end - begin), found)
                begin = end

    def results(ids: pa.Array, found: list[list[bytes]]) -> pa.RecordBatch:
        starts = np.cumsum([0, *map(len, found)])
        interned = Interned()
        w = np.concatenate([np.zeros(0, np.int32), *map(interned.of, found)])
        begins, lengths, periods, kept = [], [], [], []
        for words, runs in zip(found, runs_of(w, starts, least, times), strict=True):
            rows = sorted((s, q, e - s) for (s, e), q in runs.items())
            if rows:
                edges = np.zeros(len(words) + 1, dtype=np.int32)
                for s, q, n in rows:
                    edges[s + q] += 1
                    edges[s + n] -= 1
                words = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
            kept.append(b" ".join(words))
            for column, i in ((begins, 0), (lengths, 2), (periods, 1)):
                column.append(np.array([r[i] for r in rows], dtype=np.int64))
        columns = [ids, *(lists(c, pa.int64()) for c in (begins, lengths, periods)), pa.array(kept, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "starts", "lengths", "periods", "collapsed"])

    a, p = tail or (F.lit(None), F.lit(None))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), a.cast("long").alias("a"), p.cast("long").alias("p"))
    got = slim.mapInArrow(search, "doc_id long, starts array<long>, lengths array<long>, periods array<long>, collapsed binary")
    return got.withColumn("collapsed", F.col("collapsed").cast("string"))
