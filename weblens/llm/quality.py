"""Quality by nearest-neighbour voting among labelled documents in a latent-semantic space.

A document's terms are of two kinds: its words, and the surface of its tokens (letters by case, digits and other signs,
and whether a token repeats the one before). Both fall into tables of fixed size, are weighted by ``log(1 + tf) * idf`` with
document frequencies over the whole corpus, and each kind is brought to its share of the length, so that long texts do not
drown their surface. Latent axes are the leading right singular vectors of a bounded sample of labelled rows, found by
subspace iteration over the sample's rows in tasks. The sample's projected and normalised vectors are broadcast: their
number and width are fixed. Every document is compared with all of them, block by block: products in single precision name
all that may be among the nearest, whose cosines are then computed in double precision, so that blocks don't change a score.
The nearest ones vote, weighted by a power of their similarity; equal cosines go by the order of the sample's vectors.

Null and empty texts, and texts that share nothing with the sample, get the sample's share of label 1. One row comes out for
each row that goes in. Without labels that share is 0.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblens.llm.common import WORD_CACHE, blobs, chunk_rows, keep, lists, summed_chunks, texts_in_batches
from weblens.llm.labelled import sample

#: Counters of words and of surfaces; the surfaces' share of a vector's squared length.
WORDS, SURFACES, SURFACE_SHARE = 8192, 1024, 0.6
#: Most labelled documents that are broadcast, the width of their vectors, and the rounds that find the axes.
SAMPLE, WIDTH, ROUNDS = 6000, 64, 3
#: Tasks over the sample: each sends one matrix of the axes' size a round, and the sample does not grow with the input.
SAMPLE_TASKS = 8
#: Voting neighbours and the power of their similarity.
NEAREST, POWER = 24, 4
#: Documents in a block of cosines, and a bound of what single precision may get wrong in one.
BLOCK, DOUBT = 256, 2e-5


def hashed(term: str, size: int) -> int:
    return int.from_bytes(blake2b(term.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") % size


def surface(token: str) -> str:
    """Runs of capital, small and other letters and of digits as one sign each; other characters as they are."""
    out = ""
    for c in token:
        sign = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        out += "" if out[-1:] == sign and sign in "Aa0" else sign
    return out


class Signs(dict):
    """The sign of each code point in a surface."""

    def __missing__(self, point: int) -> str:
        self[point] = got = surface(chr(point))
        return got


class Forms(dict):
    """The counter of the surface of tokens whose characters are replaced by their signs: many tokens share a form."""

    def __missing__(self, form: str) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[form] = got = hashed(surface(form), SURFACES - 1) + 1
        return got


class Terms(dict):
    """For each token the counter of its word, and the one of its surface."""

    def __init__(self):
        super().__init__()
        self.signs, self.forms = Signs(), Forms()

    def __missing__(self, token: str) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        low = token.lower()
        word = low if low.isalnum() else "".join(filter(str.isalnum, low))
        self[token] = got = hashed(word, WORDS) * SURFACES + self.forms[token.translate(self.signs)]
        return got

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Counters and how often each occurs; surface 0 counts repeated tokens."""
        tokens = (text or "").split()
        both = np.fromiter(map(self.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        again = int((both[1:] == both[:-1]).sum())
        words, tf = np.unique(both // SURFACES, return_counts=True)
        forms, tf2 = np.unique(both % SURFACES, return_counts=True)
        at, n = np.concatenate([words, forms + WORDS]), np.concatenate([tf, tf2])
        return (np.concatenate([at, [WORDS]]), np.concatenate([n, [again]])) if again else (at, n)


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """For each counter the documents that have it; the number of documents stands last."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts = Terms(), np.zeros(WORDS + SURFACES + 1, dtype=np.int64)
        for b in batches:
            for t in b.column("text").to_pylist():
                counts[terms.of(t)[0]] += 1
                counts[-1] += 1
        yield from chunk_rows(counts)

    return summed_chunks(docs.select("text").mapInArrow(read, "chunk int, blob binary"), WORDS + SURFACES + 1)


def weighted(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """A document's weights, each kind with its share of the squared length 1."""
    w = np.log1p(n) * idf[at]
    for of, share in ((at < WORDS, 1 - SURFACE_SHARE), (at >= WORDS, SURFACE_SHARE)):
        length = np.sqrt((w[of] ** 2).sum())
        w[of] *= np.sqrt(share) / length if length else 0
    return w


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    share: float

    def projected(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros((len(rows), self.axes.shape[1]))
        for i, (at, n) in enumerate(rows):
            if len(at):
                v = weighted(at, n, self.idf) @ self.axes[at]
                length = np.sqrt(v @ v)
                out[i] = v / length if length > 1e-9 else 0
        return out

    def nearest(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place in the sample, cosine) of the nearest of each row, the nearest first."""
        k = min(NEAREST, len(self.labels))
        about = own.astype(np.float32) @ self.vectors.astype(np.float32).T
        edge = np.partition(about, -k, axis=1)[:, -k]
        row, at = np.nonzero(about >= edge[:, None] - np.float32(DOUBT))
        cosine = np.einsum("ij,ij->i", own[row], self.vectors[at])
        order = np.lexsort((at, -cosine, row))
        row, at, cosine = row[order], at[order], cosine[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        return row[first], at[first], cosine[first]

    def votes(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The share of label 1 among the nearest, weighted by similarity."""
        if not len(self.labels):
            return np.full(len(rows), self.share)
        row, at, cosine = self.nearest(self.projected(rows))
        weights = np.maximum(cosine, 0) ** POWER
        total, ones = (np.bincount(row, weights=w, minlength=len(rows)) for w in (weights, weights * self.labels[at]))
        # A thousandth of a full vote for the sample's share settles the case of no similarity.
        return (ones + 1e-3 * self.share) / (total + 1e-3)


def axes(rows: DataFrame, idf: np.ndarray) -> np.ndarray:
    """Leading right singular vectors of the sample (at, n): each round multiplies by the sample and its transpose in tasks."""
    context = rows.sparkSession.sparkContext
    basis = np.linalg.qr(np.random.default_rng(11).standard_normal((len(idf), WIDTH)))[0]
    for _ in range(ROUNDS):
        shared = context.broadcast((idf, basis))

        def read(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            weights, b = shared.value
            total = np.zeros(b.shape, dtype=np.int64)
            for batch in batches:
                for at, n in zip(batch.column("at").to_pylist(), batch.column("n").to_pylist(), strict=True):
                    at = np.array(at, dtype=np.int64)
                    if len(at):
                        w = weighted(at, np.array(n, dtype=np.int64), weights)
                        total[at] += np.rint(np.outer(w, w @ b[at]) * SCALE).astype(np.int64)
            yield from chunk_rows(total.ravel())

        summed = summed_chunks(rows.select("at", "n").mapInArrow(read, "chunk int, blob binary"), basis.size)
        basis = np.linalg.qr(summed.reshape(basis.shape) / SCALE)[0]
    return basis


#: Products are summed as integers of this unit, so that sums do not depend on the order of rows.
SCALE = 1e9


def fit(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, most: int = SAMPLE) -> Model:
    counts = document_frequencies(docs)
    idf = np.log((1 + counts[-1]) / (1 + counts[:-1])) + 0.01

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for b in batches:
            got = [terms.of(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("label"), lists([x for x, _ in got], pa.int64()), lists([n for _, n in got], pa.int64())], names=["label", "at", "n"])

    # Texts that are alike to the letter are one neighbour.
    rows = sample(docs, labels, label, held_out, most).dropDuplicates(["text", "label"]).coalesce(SAMPLE_TASKS)
    rows = keep(rows.mapInArrow(read, "label int, at array<long>, n array<long>"))
    model = Model(idf, axes(rows, idf), np.zeros((0, WIDTH)), np.zeros(0), 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [(np.array(x, dtype=np.int64), np.array(n, dtype=np.int64)) for x, n in zip(b.column("at").to_pylist(), b.column("n").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("label"), blobs(list(shared.value.projected(pairs)))], names=["label", "vector"])

    got = sorted((r.vector, r.label) for r in rows.mapInArrow(project, "label int, vector binary").collect())  # no more rows than the sample
    if got:
        model.vectors = np.stack([np.frombuffer(bytes(v)) for v, _ in got])
        model.labels = np.array([float(y) for _, y in got])
        model.share = float(model.labels.mean())
    return model


def quality(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of documents (doc_id, text)."""
    texts_in_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, "quality", held_out))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, model = Terms(), shared.value
        for b in batches:
            texts = b.column("text").to_pylist()
            scores = [model.votes([terms.of(t) for t in texts[i : i + BLOCK]]) for i in range(0, len(texts), BLOCK)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(read, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
