"""Quality classifier: ridge regression on random Fourier features of document statistics, then isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_TABLE, Words, delimiters, materialise, scratch, slices, small_batches

#: Classes of bytes that are counted.
CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r", b"\n", b".", b",;:", b"!?", b"|", b"#$%&*@^~=<>_\\/+", b"'\"()[]{}-`", bytes(range(128, 256)))
LINES = delimiters(b"\n")
FEATURES = len(CLASSES) + 11


@dataclass(frozen=True)
class Params:
    """size: number of random features. ridge: penalty per row. bins: of raw scores that calibration counts.

    threshold: least calibrated score of a good text. seed: of the random features.
    """

    size: int = 256
    ridge: float = 1e-3
    bins: int = 400
    threshold: float = 0.3
    seed: int = 11


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def expand(self, x: np.ndarray) -> np.ndarray:
        """cos(xW + b) and a constant: inner products near those of a Gaussian kernel."""
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.phase)) * np.cos(z @ self.weights + self.phase), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.round(np.interp(self.raw(x), self.knots, self.values), 9)


def _repeats(keys: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each document, and the count of its most frequent one."""
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(k)))
    top = np.zeros(n, dtype=np.int64)
    np.maximum.at(top, d[at], size)
    return np.bincount(d[at], minlength=n), top


def statistics(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of FEATURES numbers per text; an empty text has finite ones too."""
    n = len(off) - 1
    table = np.full(256, len(CLASSES), dtype=np.int64)
    for k, chars in enumerate(CLASSES):
        table[list(chars)] = k
    size = np.diff(off)
    doc = np.repeat(np.arange(n), size)
    kinds = np.bincount(doc * (len(CLASSES) + 1) + table[buf], minlength=n * (len(CLASSES) + 1)).reshape(n, -1)[:, : len(CLASSES)]
    some = np.maximum(size, 1)[:, None]
    w = Words(buf, off, SPACE_TABLE)
    words = np.diff(w.doc_at)
    of = w.doc_of_words()
    many = np.maximum(words, 1)
    distinct, top = _repeats(w.hashes, of, n)
    length = (w.ends - w.starts).astype(float)
    total, square = np.bincount(of, length, minlength=n), np.bincount(of, length**2, minlength=n)
    twice = np.bincount(of[1:], (w.hashes[1:] == w.hashes[:-1]) & (of[1:] == of[:-1]), minlength=n) if len(of) > 1 else np.zeros(n)
    three, ok = w.runs(3), w.whole(3)
    triples = np.bincount(of[: len(ok)][ok], minlength=n)
    new_triples, _ = _repeats(three[ok], of[: len(ok)][ok], n)
    lines = Words(buf, off, LINES)
    line_of = lines.doc_of_words()
    line_n = np.maximum(np.diff(lines.doc_at), 1)
    new_lines, _ = _repeats(lines.hashes, line_of, n)
    single = np.bincount(of, length <= 2, minlength=n)
    parts = [
        np.sqrt(kinds / some),
        np.log1p(size)[:, None] / 10,
        np.log1p(words)[:, None] / 10,
        (total / many)[:, None],
        np.sqrt(np.maximum(square / many - (total / many) ** 2, 0))[:, None],
        (distinct / many)[:, None],
        (distinct / many**0.75)[:, None],
        (top / many)[:, None],
        np.sqrt(twice / many)[:, None],
        (new_triples / np.maximum(triples, 1))[:, None],
        (new_lines / line_n)[:, None],
        (single / many)[:, None],
    ]
    return np.hstack(parts)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, buf, off in slices(batches):
            x = statistics(buf, off)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * FEATURES), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _summed(rows: DataFrame, per_partition) -> np.ndarray:
    """The sum over partitions of a matrix that per_partition makes of (x, y): one number per cell is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                own = per_partition(_matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False))
                total = own if total is None else total + own
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.reshape(-1).astype(np.int32)), pa.array(j.reshape(-1).astype(np.int32)), pa.array(total.reshape(-1))], names=["i", "j", "v"])

    cells = rows.select("x", "y").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    if not len(cells):
        return np.zeros((0, 0))
    out = np.zeros((cells["i"].max() + 1, cells["j"].max() + 1))
    out[cells["i"], cells["j"]] = cells["v"]
    return out


def pool(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators: the blocks' mean places and rising values."""
    blocks: list[list[float]] = []
    for a, b, w in zip(x, y, weight, strict=True):
        blocks.append([a * w, b * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def train(found: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    """A model of the labelled rows of found (doc_id, x) that are not held out.

    labels has doc_id and quality; a doc_id with several labels counts with their mean, and null
    labels not at all. Three quarters of the rows, by a hash of their statistics, fit the ridge scores, the rest calibrates them.
    Without labels every score is 0.5.
    """
    mean = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    rows = found.join(mean, "doc_id").where(~held_out()).withColumn("fold", F.pmod(F.xxhash64("x"), F.lit(4)))
    with scratch() as keep:
        return _fitted(keep(materialise(rows.select("x", "y", "fold"), "labelled")), p)


def _fitted(rows: DataFrame, p: Params) -> Model:
    fit, rest = rows.where("fold > 0"), rows.where("fold = 0")
    moments = _summed(fit, lambda x, y: np.vstack([np.full(x.shape[1], float(len(x))), x.sum(0), (x**2).sum(0)]))
    rng = np.random.Generator(np.random.PCG64(p.seed))
    weights = rng.normal(size=(FEATURES, p.size)) / np.sqrt(FEATURES)
    phase = rng.uniform(0, 2 * np.pi, p.size)
    if not moments.size:
        return Model(np.zeros(FEATURES), np.ones(FEATURES), weights, phase, np.zeros(p.size + 1), np.array([0.0]), np.array([0.5]))
    centre = moments[1] / moments[0]
    scale = np.sqrt(np.maximum(moments[2] / moments[0] - centre**2, 1e-8))
    model = Model(centre, scale, weights, phase, np.zeros(p.size + 1), np.array([0.0]), np.array([0.0]))

    def normal(x, y):
        z = model.expand(x)
        return np.hstack([z.T @ z, (z.T @ y)[:, None]])

    equations = _summed(fit, normal)
    penalty = np.eye(p.size + 1) * p.ridge * moments[0][0]
    penalty[-1, -1] = 0
    model.beta = np.linalg.solve(equations[:, :-1] + penalty, equations[:, -1])

    def counted(x, y):
        place = np.clip(((model.raw(x) + 0.5) * p.bins / 2).astype(int), 0, p.bins - 1)
        return np.vstack([np.bincount(place, minlength=p.bins), np.bincount(place, y, minlength=p.bins)])

    bins = _summed(rest, counted)
    if not bins.size:
        bins = _summed(fit, counted)
    used = np.flatnonzero(bins[0])
    model.knots, model.values = pool((used + 0.5) * 2 / p.bins - 0.5, bins[1][used] / bins[0][used], bins[0][used])
    return model


def apply(found: DataFrame, model: Model, p: Params = Params()) -> DataFrame:
    """(doc_id, x) -> (doc_id, score, predicted)."""
    sent = found.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                score = sent.value.score(_matrix(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= p.threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return found.select("doc_id", "x").mapInArrow(run, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs.

    Every text is scored, whole; null and empty ones have the statistics of no words. Rows that
    repeat a doc_id are scored one by one, and each labelled one is learned from. A null doc_id is
    not held out and has no label. An empty docs gives no rows. Other columns are not looked at.
    """
    found = materialise(features(docs), "features")
    model = train(found, labels, p)
    return apply(found, model, p).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of docs that the classifier accepts, with all their columns."""
    model = train(features(docs), labels, p)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            flat = pa.RecordBatch.from_arrays([whole.column(0), whole.column(0).field("text")], names=["row", "text"])
            for b, buf, off in slices([flat]):
                good = sent.value.score(statistics(buf, off)) >= p.threshold
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good))], names=["row"])

    small_batches(docs.sparkSession)
    packed = docs.select(F.struct("*").alias("row"))
    return packed.mapInArrow(run, packed.schema).select("row.*")
