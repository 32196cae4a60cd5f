"""Toxicity by non-negative positive-unlabelled learning, in numpy.

The learner sees confirmed toxic texts and unlabelled ones, never confirmed clean
ones.  With class prior ``pi`` the risk of a classifier g is

    pi * E_toxic[loss(g, 1)] + max(0, E_unlabelled[loss(g, 0)] - pi * E_toxic[loss(g, 0)])

where the second term estimates the risk on clean text; when it falls below zero
the step goes the other way, so that unlabelled toxic texts are not learned as
clean.  A text is the set of its lower-cased words and of its byte strings of
``GRAMS`` lengths; the classifiers are linear in those that confirmed texts hold
clearly more often than unlabelled ones.  Several of them, each with its own part
of the unlabelled texts, are averaged.  Only rows are sampled to fit: of each
sampled text all features are counted.

Rows: one per input row, repeated rows too.  Null and empty texts have no words
and get the score of the bare intercept.  Without confirmed toxic texts every
score is the prior (0 without labels).
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspan.llm.arrays import mix, words
from auditspan.llm.samples import labelled_sample, texts_of
from auditspan.llm.tasks import kept_table, map_rows, utf8

#: confirmed texts, and unlabelled texts, that the classifiers are fitted on
FIT_TOXIC = 1500
FIT_UNLABELLED = 4500
CLASSIFIERS = 3
#: a feature stands in at least this share of the confirmed texts, and in at least 3
MIN_SHARE = 0.005
#: how many standard errors its share must lie above that of unlabelled texts
MIN_SCORE = 6.0
GRAMS = (6, 8)
#: bytes whose strings are taken at once
PIECE = 1 << 20
#: features of several texts that are counted at once
COUNTED = 1 << 20
STEPS = 400
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += np.uint64(32)
_FOLD[9:14] = 32


def feature_parts(data: bytes) -> Iterator[np.ndarray]:
    """Hashes of the words and byte strings of a text, with repeats, part by part."""
    yield words(data, lower=True, signs=True)[0]
    for at in range(0, len(data), PIECE):
        piece = _FOLD[np.frombuffer(data[max(0, at - max(GRAMS)):at + PIECE], np.uint8)]
        piece = np.concatenate([[np.uint64(32)], piece]) if at == 0 else piece
        gram = piece
        for width in range(2, max(GRAMS) + 1):
            if len(piece) < width:
                break
            gram = (gram[:-1] << np.uint64(8)) | piece[width - 1:]
            if width in GRAMS:
                yield mix(gram + np.uint64(width))


def feature_set(data: bytes) -> np.ndarray:
    """The distinct words and byte strings of a text, as sorted hashes."""
    return np.unique(np.concatenate([np.unique(part) for part in feature_parts(data)]))


class Places:
    """Finds which of some sorted hashes a text holds; a small table passes over most others."""

    BITS = np.uint64((1 << 20) - 1)

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.table = np.zeros(int(self.BITS) + 1, bool)
        self.table[hashes & self.BITS] = True

    def of(self, data: bytes) -> np.ndarray:
        found = np.unique(np.concatenate([np.unique(p[self.table[p & self.BITS]]) for p in feature_parts(data)]))
        return matches(found, self.hashes)


@dataclass
class Rows:
    """Sparse 0/1 rows: the features of row i are cells[starts[i]:starts[i + 1]]."""

    cells: np.ndarray
    starts: np.ndarray

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The features of some rows, and which of them each belongs to."""
        sizes = self.starts[rows + 1] - self.starts[rows]
        owner = np.repeat(np.arange(len(rows)), sizes)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.cells[self.starts[rows][owner] + within], owner


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(toxic: Rows, unlabelled: Rows, dims: int, prior: float, seed: int, steps: int = STEPS,
          rate: float = 0.05, ridge: float = 0.002) -> np.ndarray:
    """Weights of a linear classifier, the intercept last."""
    rng = np.random.default_rng(seed)
    w = np.zeros(dims + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros(dims + 1), np.zeros(dims + 1)
    n_toxic, n_other = len(toxic.starts) - 1, len(unlabelled.starts) - 1
    # each classifier leaves out a third of the unlabelled texts
    pool = np.flatnonzero(rng.random(n_other) < 2 / 3) if n_other > 30 else np.arange(n_other)

    def answer(rows: Rows, picked: np.ndarray):
        cells, owner = rows.take(picked)
        return cells, owner, np.bincount(owner, w[cells], len(picked)) + w[-1]

    def spread(cells, owner, d):
        out = np.bincount(cells, d[owner], dims + 1)
        out[-1] += d.sum()
        return out

    for step in range(1, steps + 1):
        a = rng.choice(n_toxic, min(n_toxic, 512), replace=False)
        b = rng.choice(pool, min(len(pool), 2048), replace=False)
        ca, oa, za = answer(toxic, a)
        cb, ob, zb = answer(unlabelled, b)
        clean_risk = np.logaddexp(0, zb).mean() - prior * np.logaddexp(0, za).mean()
        # gradients of the logistic loss for label 1 and label 0
        up = spread(ca, oa, prior * (_sigmoid(za) - 1) / len(a))
        clean = spread(cb, ob, _sigmoid(zb) / len(b)) - spread(ca, oa, prior * _sigmoid(za) / len(a))
        g = up + clean if clean_risk >= 0 else -clean
        g[:-1] += ridge * w[:-1] / dims ** 0.5
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return w


@dataclass
class Model:
    features: np.ndarray  # sorted word hashes
    weights: np.ndarray  # one row per classifier, the intercept last
    constant: float

    def score(self, data: bytes, places: Places | None = None) -> float:
        if not len(self.weights):
            return self.constant
        at = (places or Places(self.features)).of(data)
        return float(_sigmoid(self.weights[:, at].sum(1) + self.weights[:, -1]).mean())


def matches(found: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Places in the sorted ``features`` of those that are in ``found``."""
    at = np.minimum(np.searchsorted(features, found), len(features) - 1)
    return at[features[at] == found]


def _rows(kept: list[np.ndarray]) -> Rows:
    return Rows(np.concatenate(kept), np.concatenate([[0], np.cumsum([len(k) for k in kept])]).astype(np.int64))


def _gathered(texts: DataFrame, key: str, places: Places) -> list[np.ndarray]:
    """Which of some features each text holds, an array each, in the order of ``key``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [places.of(t).astype(np.int32).tobytes() for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(sets, pa.binary())], [key, "found"])

    kind = dict(texts.dtypes)[key]
    rows = map_rows(texts.select(key, "text"), run, f"{key} {kind}, found binary").toArrow()
    rows = rows.sort_by([(key, "ascending"), ("found", "ascending")])
    return [np.frombuffer(x, np.int32) for x in rows.column("found").to_pylist()]


def _without_copies(texts: DataFrame) -> DataFrame:
    """(mark, text): one text of each set of features."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [hashlib.blake2b(feature_set(t).tobytes(), digest_size=16).digest()
                     for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(marks, pa.binary()), batch.column("text")], ["mark", "text"])

    return map_rows(texts.select("text"), run, "mark binary, text string").groupBy("mark").agg(
        F.min("text").alias("text"))


def _counted(texts: DataFrame, pick) -> DataFrame:
    """(feature, n): how many texts have each of the distinct numbers that ``pick(bytes)`` gives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(sets):
            found, n = np.unique(np.concatenate(sets), return_counts=True)
            for at in range(0, len(found), COUNTED):
                yield pa.RecordBatch.from_arrays([pa.array(x[at:at + COUNTED].astype(np.int64)) for x in (found, n)],
                                                 ["feature", "n"])
        sets, held = [], 0
        for batch in batches:
            for t in utf8(batch.column("text")):
                sets.append(pick(t).view(np.int64))
                held += len(sets[-1])
                if held >= COUNTED:
                    yield from counted(sets)
                    sets, held = [], 0
        if sets:
            yield from counted(sets)

    rows = map_rows(texts.select("text"), run, "feature long, n long")
    return rows.groupBy("feature").agg(F.sum("n").alias("n"))


def _collected(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = counts.select("feature", "n").toArrow()
    return tuple(rows.column(c).to_numpy().astype(np.int64) for c in ("feature", "n"))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", prior: float | None = None,
        fit_toxic: int = FIT_TOXIC, fit_unlabelled: int = FIT_UNLABELLED,
        classifiers: int = CLASSIFIERS) -> Model:
    """Fit on bounded samples; ``docs`` and ``labels`` are the rows that may be learned from.

    ``prior`` is the share of toxic texts; by default that of the labels.  Features
    are counted in Spark over the whole sampled texts; those that stand in enough
    confirmed texts reach the driver, and which telling ones each row holds.
    """
    counts = {int(r[0]): r[1] for r in labels.filter(f"{label} is not null").groupBy(label).count().collect()}
    total = sum(counts.values())
    if prior is None:
        prior = counts.get(1, 0) / total if total else 0.0
    none = Model(np.zeros(0, np.uint64), np.zeros((0, 1)), prior)
    if not counts.get(1) or not 0 < prior < 1:
        return none
    toxic = labelled_sample(labels.filter(f"{label} = 1"), label, fit_toxic).select("doc_id", F.lit(1).alias("label"))
    other = labelled_sample(docs.filter("text is not null").withColumn("label", F.lit(0)), "label", fit_unlabelled)

    sample = kept_table(texts_of(docs, toxic.union(other)), "toxicity")
    # copies of one text would make all of its words look typical
    confirmed = kept_table(_without_copies(sample.filter("label = 1")), "confirmed")
    unlabelled = sample.filter("label = 0")
    n_confirmed, n_unlabelled = confirmed.count(), unlabelled.count()
    if not n_confirmed or not n_unlabelled:
        return none
    least = min(max(3, MIN_SHARE * n_confirmed), n_confirmed)
    seen, texts = _collected(_counted(confirmed, feature_set).filter(F.col("n") >= least))
    order = np.argsort(seen.view(np.uint64))
    seen, texts = seen.view(np.uint64)[order], texts[order]
    if not len(seen):
        return none
    at, n = _collected(_counted(unlabelled, Places(seen).of))
    held = np.zeros(len(seen), np.int64)
    held[at] = n
    low = (held + 0.5) / (n_unlabelled + 1)
    telling = (texts / n_confirmed - low) / np.sqrt(low * (1 - low) / n_confirmed) >= MIN_SCORE
    if not telling.any():
        return none
    features = seen[telling]
    places = Places(features)
    inputs = _rows(_gathered(confirmed, "mark", places)), _rows(_gathered(unlabelled, "doc_id", places))
    return Model(features, np.stack([train(*inputs, len(features), prior, seed) for seed in range(classifiers)]),
                 prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score): the probability that a whole text is toxic."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(model.features)
        for batch in batches:
            scores = [model.score(t or b"", places) for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())],
                                             ["doc_id", "score"])

    return map_rows(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double")


__all__ = ["Model", "fit", "score", "train", "feature_set"]
