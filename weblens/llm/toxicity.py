"""Toxicity by maximum-scoring segments.

Tokens score by log-odds between toxic and other labelled documents. A token is seen as its word and as two beginnings of
it, so that unseen inflections of a toxic stem still score; counts fall into a table of fixed size. Each log-odds has a
Dirichlet prior whose strength follows the feature's frequency in the whole corpus, and is drawn in by a multiple of its
deviation. The feature with the surest estimate speaks for the token, less a constant drift.

The scan of Ruzzo and Tompa finds all maximal segments of positive score in linear time. Under clean text the best score
S of n tokens follows an extreme-value law, ``P(S >= s) = 1 - exp(-K n exp(-lambda s))``: lambda solves
``E[exp(lambda score)] = 1`` and K is its maximum-likelihood value, both on clean labelled documents that the log-odds
have not seen. A segment is significant if it is expected less than once in a document of that length. The sum of the
significant segments' log expectations, or the best segment's if there is none, becomes a score by a logistic curve
fitted on the same documents.

Tokens are split at white space, their words at what is no letter or digit, whatever their length. Null and empty texts have no tokens and get the score of no evidence. One row comes out for
each row that goes in. Labels of unknown ids are ignored. Without labels of both kinds all scores are 0.
"""

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weblens.llm.common import WORD_CACHE, chunk_rows, keep, summed_chunks, texts_in_batches
from weblens.llm.labelled import sample

#: Features fall into 2**BITS counters.
BITS = 18
#: Characters of text that are counted at once.
TOGETHER = 2_000_000
#: Most labelled documents that the model is fitted on.
SAMPLE = 20_000
#: Lengths of a word's beginnings that count as features.
STEMS = (5, 4)
#: Least strength of a prior in documents, and the strength that the whole corpus shares among its features.
PRIOR, CORPUS_PRIOR = 2.0, 2000.0
#: Deviations by which an estimate is drawn in, and what each token loses.
DOUBT, DRIFT = 1.28, 0.3


def features(token: str) -> list[int]:
    """Buckets of a token's words, the runs of its letters and digits, and of their beginnings; none for other tokens."""
    words = "".join(c if c.isalnum() else " " for c in token.lower()).split()
    forms = [form for word in words for form in (word, *(word[:n] + "~" for n in STEMS if len(word) >= n))]
    return [crc32(f.encode("utf-8", "surrogatepass")) >> (32 - BITS) for f in forms]


class Features(dict):
    def __missing__(self, token: str) -> list[int]:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[token] = got = features(token)
        return got


class Tally(dict):
    """Numbers of tokens: each known token has a place, and its count goes to its features when the places are used up."""

    def __init__(self) -> None:
        self.seen = np.zeros(WORD_CACHE, dtype=np.int64)
        self.counts = np.zeros(1 << BITS, dtype=np.int64)

    def __missing__(self, token: str) -> int:
        self[token] = place = len(self)
        return place

    def add(self, text: str) -> None:
        tokens = text.split()
        for i in range(0, len(tokens), WORD_CACHE // 4):
            part = tokens[i : i + WORD_CACHE // 4]
            if len(self) + len(part) > WORD_CACHE:
                self.flush()
            places = np.fromiter(map(self.__getitem__, part), dtype=np.int64, count=len(part))
            if len(part) > 2000:
                self.seen += np.bincount(places, minlength=WORD_CACHE)
            else:
                np.add.at(self.seen, places, 1)

    def flush(self) -> None:
        pairs = [(f, place) for token, place in self.items() for f in features(token)]
        if pairs:
            at, place = np.array(pairs, dtype=np.int64).T
            np.add.at(self.counts, at, self.seen[place])
        self.clear()
        self.seen[:] = 0


def corpus_counts(docs: DataFrame) -> np.ndarray:
    """How often each feature occurs in all documents."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, held, size = Tally(), [], 0
        for b in batches:
            for t in b.column("text").to_pylist():
                if t:
                    held.append(t)
                    size += len(t)
                    if size > TOGETHER:
                        tally.add(" ".join(held))
                        held, size = [], 0
        tally.add(" ".join(held))
        tally.flush()
        yield from chunk_rows(tally.counts)

    return summed_chunks(docs.select("text").mapInArrow(read, "chunk int, blob binary"), 1 << BITS)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, most: int) -> DataFrame:
    """(label, calibrate, text) of the sample, one of each group of near copies; a quarter is for calibration."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            least = []
            for t in b.column("text").to_pylist():
                w = t.lower().split()
                grams = {" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))}
                least.append(min(int.from_bytes(blake2b(g.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "little") for g in grams))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "label", "text")), pa.array(least, pa.int64())], names=["doc_id", "label", "text", "gram"])

    rows = keep(sample(docs, labels, label, held_out, most).mapInArrow(read, "doc_id long, label int, text string, gram long"))
    one = rows.groupBy("gram", "label").agg(F.min("doc_id").alias("doc_id"))  # no more rows than the sample
    return rows.join(F.broadcast(one), ["gram", "label", "doc_id"]).select("label", (F.pmod(F.xxhash64("gram"), F.lit(4)) == 0).alias("calibrate"), "text")


def label_counts(rows: DataFrame) -> np.ndarray:
    """Documents of label 0 and 1 that have each feature; their numbers stand last."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = Features(), np.zeros((2, (1 << BITS) + 1), dtype=np.int64)
        for b in batches:
            for y, t in zip(b.column("label").to_pylist(), b.column("text").to_pylist(), strict=True):
                counts[y, list({f for token in set(t.split()) for f in known[token]})] += 1
                counts[y, -1] += 1
        yield from chunk_rows(counts.ravel())

    size = 2 * ((1 << BITS) + 1)
    return summed_chunks(rows.select("label", "text").mapInArrow(read, "chunk int, blob binary"), size).reshape(2, -1)


def log_odds(corpus: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each feature's drawn-in log-odds and how sure it is, in deviations."""
    share = counts[1, -1] / counts[:, -1].sum()
    prior = PRIOR + CORPUS_PRIOR * corpus / max(1, corpus.sum())
    yes, no = counts[1, :-1] + prior * share, counts[0, :-1] + prior * (1 - share)
    delta = np.log(yes / no) - math.log(share / (1 - share))
    deviation = np.sqrt(1 / yes + 1 / no)
    return np.sign(delta) * np.maximum(0, np.abs(delta) - DOUBT * deviation), np.abs(delta) / deviation


class Scores(dict):
    """Tokens' scores."""

    def __init__(self, odds: np.ndarray, sure: np.ndarray):
        self.odds, self.sure = odds, sure

    def __missing__(self, token: str) -> float:
        if len(self) >= WORD_CACHE:
            self.clear()
        f = features(token)
        self[token] = got = float(self.odds[max(f, key=self.sure.__getitem__)]) - DRIFT if f else -DRIFT
        return got

    def of(self, text: str | None) -> np.ndarray:
        tokens = (text or "").split()
        return np.fromiter(map(self.__getitem__, tokens), dtype=np.float64, count=len(tokens))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), end exclusive, in linear time."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    held: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum at the end, the nearest earlier with a smaller sum before
    for i in np.flatnonzero(scores > 0).tolist():
        start, end, before, at = i, i + 1, float(total[i]), float(total[i + 1])
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= before:
                j = held[j][4]
            if j < 0 or held[j][3] >= at:
                held.append((start, end, before, at, j))
                break
            start, before = held[j][0], held[j][2]
            del held[j:]
    return [(s, e, at - before) for s, e, before, at, _ in held]


@dataclass
class Model:
    odds: np.ndarray
    sure: np.ndarray
    rate: float = 1.0
    k: float = 1.0
    curve: tuple[float, ...] = (1.0, 1.0, 0.0, 0.0, 0.0)
    known: bool = True

    def evidence(self, found: list[tuple[int, int, float]], n: int) -> float:
        """Log expectations of the significant segments, or of the best one; without segments never above 0."""
        expected = math.log(self.k * max(n, 1))
        logs = [self.rate * s - expected for _, _, s in found] or [min(0.0, -expected)]
        return sum(x for x in logs if x > 0) or max(logs)

    def score(self, evidence: float, n: int) -> float:
        z = sum(w * x for w, x in zip(self.curve, shape(evidence, n), strict=True))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z)))) if self.known else 0.0


def shape(evidence: float, n: int) -> tuple[float, ...]:
    """Terms of the curve: significant evidence, how dense it is among n tokens, and the lack of it count apart, so that toxic
    documents without any known token do not flatten the curve where there is evidence."""
    more = max(evidence, 0.0)
    return math.asinh(more), math.asinh(min(evidence, 0.0)), math.log1p(100 * more / (n + 20)), float(evidence > 0), 1.0


def karlin_rate(values: np.ndarray, counts: np.ndarray) -> float:
    """The positive solution of the mean of exp(rate * value) = 1, or 1 if there is none."""
    p = counts / counts.sum()
    if p @ values >= 0 or not (values > 0).any():
        return 1.0
    low, high = 1e-6, 1.0
    while p @ np.exp(high * values) < 1 and high < 8:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if p @ np.exp(middle * values) < 1 else (low, middle)
    return high


def logistic(a: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Weights of the columns of ``a``, by damped Newton steps with a weak prior that keeps them finite; none but the last is below 0."""
    pull, start = np.array([0.05, 0.05, 0.05, 0.05, 0.01]), np.array([1.0, 1.0, 0.0, 0.0, 0.0])

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float((np.logaddexp(0, z) - y * z).sum() + (pull * (w - start) ** 2).sum() / 2)

    w = start
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a.T * (p * (1 - p))) @ a + np.diag(pull), a.T @ (p - y) + pull * (w - start))
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return (*np.maximum(w[:-1], 0).tolist(), float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, most: int = SAMPLE) -> Model:
    """The model from labelled rows outside ``held_out``; held_out is a condition on doc_id."""
    rows = keep(training_rows(docs, labels, label, held_out, most))
    counts = label_counts(rows.where("not calibrate"))
    if not counts[:, -1].all():
        return Model(np.zeros(1 << BITS), np.zeros(1 << BITS), known=False)
    corpus = corpus_counts(docs)
    model = Model(*log_odds(corpus, counts))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known = Scores(m.odds, m.sure)
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                s = known.of(t)
                value, times = np.unique(np.round(s, 1), return_counts=True)
                out.append((len(s), [x[2] for x in segments(s)], value.tolist(), times.tolist()))
            yield pa.RecordBatch.from_arrays([b.column("label"), *map(pa.array, zip(*out, strict=True))] if out else [b.column("label"), pa.array([], pa.int64()), *[pa.array([], pa.list_(k)) for k in (pa.float64(), pa.float64(), pa.int64())]], names=["label", "n", "found", "value", "times"])

    got = rows.where("calibrate").select("label", "text").mapInArrow(measure, "label int, n long, found array<double>, value array<double>, times array<long>").collect()  # no more rows than the sample
    got.sort(key=lambda r: (r.label, r.n, r.found, r.value, r.times))  # sums do not depend on the order of tasks
    clean = [r for r in got if not r.label and r.n]
    if clean and any(r.label for r in got):
        tally: Counter = Counter()
        for r in clean:
            tally.update(dict(zip(r.value, r.times, strict=True)))
        model.rate = karlin_rate(np.array(list(tally)), np.array(list(tally.values())))
        model.k = len(clean) / sum(r.n * math.exp(-model.rate * max([0.0, *r.found])) for r in clean)
        x = np.array([shape(model.evidence([(0, 0, s) for s in r.found], r.n), r.n) for r in got])
        model.curve = logistic(x, np.array([float(r.label) for r in got]))
    # The curve holds for log-odds of unseen documents; the log-odds themselves then take in all of the sample.
    model.odds, model.sure = log_odds(corpus, counts + label_counts(rows.where("calibrate")))
    return model


def scored(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """The columns ``carry`` of documents with ``score`` and the significant ``passages`` (start, end, score), in tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known = Scores(m.odds, m.sure)
        for b in batches:
            score, passages = [], []
            for t in b.column("text_").to_pylist():
                s = known.of(t)
                found = segments(s)
                score.append(m.score(m.evidence(found, len(s)), len(s)))
                passages.append([{"start": a, "end": e, "score": x} for a, e, x in found if m.rate * x > math.log(m.k * len(s))])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(score, pa.float64()), pa.array(passages, kind)], names=["doc", "score", "passages"])

    rows = docs.select(F.struct(*carry).alias("doc"), F.col("text").alias("text_"))
    more = T.StructType.fromDDL("score double, passages array<struct<start:int,end:int,score:double>>")
    return rows.mapInArrow(read, T.StructType([rows.schema["doc"], *more]))


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted, passages) of documents (doc_id, text)."""
    texts_in_batches(docs.sparkSession)
    out = scored(docs, fit(docs, labels, "toxic", held_out), ["doc_id"])
    return out.select("doc.doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages").select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted", "passages")


def clean(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.7) -> DataFrame:
    """The documents that are not predicted to be toxic, with their columns."""
    texts_in_batches(docs.sparkSession)
    return scored(docs, fit(docs, labels, "toxic", held_out), docs.columns).where(F.col("score") < threshold).select("doc.*")
