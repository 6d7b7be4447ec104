"""Licence scan: a paragraph classifier on sparse word n-grams, calibrated with an unknown class, confirmed by templates."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, as_long, column_bytes, delimiters, run_hashes, slices, small_batches
from .license_templates import OTHERS, TEMPLATES

#: Bytes that part words (digits part them too, so versions do not matter), and words that tell nothing.
DELIM_TABLE = delimiters(bytes([*range(0x00, 0x61), *range(0x7B, 0x80)]))
COMMON = frozenset("a an and any are as at be been by can for from has have he if in is it its may no not of on or shall she should so that the their them they this to was will with you your".split())
UNKNOWN = "unknown"


@dataclass(frozen=True)
class Params:
    """gap: words without a known bigram that end a paragraph. copies: training variants of each template.

    probability: least calibrated probability of a family. similarity: least share of a paragraph's
    bigrams that the family's templates together must have, which confirms it. words: fewest in a paragraph.
    """

    gap: int = 6
    copies: int = 24
    probability: float = 0.6
    similarity: float = 0.5
    words: int = 3
    seed: int = 5


def _words(text: str) -> Words:
    buf, off = column_bytes(pa.array([text]))
    return Words(buf, off, DELIM_TABLE, lower=True)


def _plain(text: str) -> list[str]:
    return re.findall(r"[a-z\x80-\U0010ffff]+", text.lower())


class Model:
    """n-gram vocabulary of the templates, softmax weights, temperature, and each family's bigrams."""

    def __init__(self, p: Params):
        self.p = p
        self.families = [*TEMPLATES, UNKNOWN]
        grams: set[int] = set()
        self.own: list[np.ndarray] = []
        bigrams: set[int] = set()
        for texts in TEMPLATES.values():
            own: set[int] = set()
            for t in texts:
                w = _words(t)
                names = _plain(t)
                two = run_hashes(w.hashes, 2)
                telling = np.array([not (COMMON >= set(names[i : i + 2])) for i in range(len(two))], dtype=bool)
                bigrams |= set(two[telling].tolist())
                own |= set(two.tolist())
                grams |= {int(h) for h, n in zip(w.hashes, names, strict=True) if n not in COMMON}
                grams |= set(two.tolist()) | set(run_hashes(w.hashes, 3).tolist())
            self.own.append(np.sort(np.array(list(own), dtype=np.uint64)))
        self.bigrams = np.sort(np.array(list(bigrams), dtype=np.uint64))
        self.grams = np.sort(np.array(list(grams), dtype=np.uint64))
        self._fit()

    def features(self, hashes: np.ndarray) -> tuple[np.ndarray, float]:
        """Places of a paragraph's known n-grams, and the value each has."""
        own = np.concatenate([hashes, run_hashes(hashes, 2), run_hashes(hashes, 3)])
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        at = np.unique(at[self.grams[at] == own])
        return at, 1.0 / np.sqrt(max(len(own), 1))

    def _fit(self) -> None:
        """Softmax regression by full gradient steps with momentum on variants of the templates; one in four calibrates."""
        rng = random.Random(self.p.seed)
        texts: list[tuple[str, int]] = []
        for f, own in enumerate(TEMPLATES.values()):
            for t in own:
                for c in range(self.p.copies):
                    texts.append((_variant(t, rng, light=c % 2 == 0), f))
        everything = [w for own in TEMPLATES.values() for t in own for w in t.split()]
        none = len(self.families) - 1
        for t in OTHERS:
            texts += [(_variant(t, rng, light=True), none) for _ in range(self.p.copies)]
        for _ in range(len(OTHERS) * self.p.copies):
            texts.append((" ".join(rng.choice(everything) for _ in range(rng.randrange(2, 25))), none))
        rows, y = [], []
        for t, f in texts:
            h = _words(t).hashes
            if len(h):
                rows.append(self.features(h))
                y.append(f)
        x = np.zeros((len(rows), len(self.grams) + 1))
        for i, (at, value) in enumerate(rows):
            x[i, at] = value
        x[:, -1] = 1.0
        y = np.array(y)
        hold = np.arange(len(y)) % 4 == 3
        w, step = np.zeros((x.shape[1], len(self.families))), np.zeros((x.shape[1], len(self.families)))
        xt, target = x[~hold], np.eye(len(self.families))[y[~hold]]
        for _ in range(250):
            z = xt @ w
            z = np.exp(z - z.max(1, keepdims=True))
            gradient = xt.T @ (z / z.sum(1, keepdims=True) - target) / len(xt) + 1e-5 * w
            step = 0.9 * step - 20.0 * gradient
            w += step
        self.weights, self.temperature = w, 1.0
        z = x[hold] @ w
        losses = {}
        for t in np.geomspace(0.25, 8, 31):
            e = z / t - (z / t).max(1, keepdims=True)
            losses[t] = -np.mean(e[np.arange(len(e)), y[hold]] - np.log(np.exp(e).sum(1)))
        self.temperature = min(losses, key=losses.get)
        self.held_out_accuracy = float(np.mean(z.argmax(1) == y[hold]))

    def classify(self, hashes: np.ndarray) -> tuple[str, float, float, bool]:
        """Family or unknown, its calibrated probability, the similarity to its templates together, and whether that confirms."""
        at, value = self.features(hashes)
        z = (self.weights[at].sum(0) * value + self.weights[-1]) / self.temperature
        prob = np.exp(z - z.max())
        prob /= prob.sum()
        f = int(prob.argmax())
        two = np.unique(run_hashes(hashes, 2))
        none = len(self.families) - 1
        alike = len(np.intersect1d(two, self.own[f], assume_unique=True)) / max(1, len(two)) if f < none else 0.0
        known = f < none and prob[f] >= self.p.probability and len(hashes) >= self.p.words
        return self.families[f] if known else UNKNOWN, float(prob[f]), alike, known and alike >= self.p.similarity

    def paragraphs(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """First and end words of the stretches whose known bigrams are less than `gap` words apart."""
        two = w.runs(2)
        if not len(two):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.bigrams, two), len(self.bigrams) - 1)
        hit = np.flatnonzero((self.bigrams[at] == two) & w.whole(2))
        if not len(hit):
            return hit, hit
        doc = w.doc_of_words()[hit]
        new = np.ones(len(hit), dtype=bool)
        new[1:] = (np.diff(hit) > self.p.gap) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        return hit[first], hit[np.append(first[1:], len(hit)) - 1] + 2


def _variant(text: str, rng: random.Random, light: bool) -> str:
    """A text with other versions and some words gone, and if not light a stretch of it with a word changed."""
    words = [w for w in re.sub(r"\d", lambda m: str(rng.randrange(10)), text).split() if rng.random() > 0.04]
    if not light and len(words) > 12:
        n = rng.randrange(8, len(words))
        at = rng.randrange(0, len(words) - n + 1)
        words = words[at : at + n]
        words[rng.randrange(len(words))] = rng.choice(["file", "project", "author", "tool", "name"])
    return " ".join(words) or text


@lru_cache(maxsize=2)
def load(p: Params) -> Model:
    return Model(p)


def scan(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_words, families, n_confirmed, n_unknown and found for each row of docs.

    A paragraph is a stretch of text whose known telling bigrams lie close together, across lines. found has all of
    them as (start, end, family, probability, similarity, confirmed); start and end are byte places in the
    UTF-8 text. families are the confirmed ones, sorted, comma-joined. Whole texts count. Null and empty
    texts have none. Repeated rows get equal results; an empty table gives no rows. Other columns are not looked at.
    The model is made from the templates, once, and sent to the executors; it does not grow with docs.
    """
    sent = docs.sparkSession.sparkContext.broadcast(load(p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b, buf, off in slices(batches):
            w = Words(buf, off, DELIM_TABLE, lower=True)
            found: list[list] = [[] for _ in range(b.num_rows)]
            for first, end in zip(*model.paragraphs(w), strict=True):
                d = int(np.searchsorted(w.doc_at, first, side="right")) - 1
                family, prob, alike, sure = model.classify(w.hashes[first:end])
                found[d].append({"start": int(w.starts[first] - off[d]), "end": int(w.ends[end - 1] - off[d]), "family": family, "probability": round(prob, 9), "similarity": alike, "confirmed": bool(sure)})
            sure = [sorted({x["family"] for x in f if x["confirmed"]}) for f in found]
            kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64()), ("confirmed", pa.bool_())])
            cols = [b.column(0), as_long(np.diff(w.doc_at)), pa.array([",".join(x) for x in sure]), pa.array([sum(x["confirmed"] for x in f) for f in found], pa.int64()), pa.array([sum(not x["confirmed"] for x in f) for f in found], pa.int64()), pa.array(found, pa.list_(kind))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "families", "n_confirmed", "n_unknown", "found"])

    schema = "doc_id long, n_words long, families string, n_confirmed long, n_unknown long, found array<struct<start: long, end: long, family: string, probability: double, similarity: double, confirmed: boolean>>"
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def confirmed(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, family): each family that a document confirms."""
    return scan(docs, p).select("doc_id", F.explode("found").alias("f")).where("f.confirmed").select("doc_id", "f.family").distinct()
