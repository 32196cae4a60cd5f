"""Language identification by nearest centroid.

A text is lower-cased, everything but letters becomes one space, and runs of one
to three characters (their code points hashed into ``DIMS`` cells) are counted.
Counts are damped, weighted by inverse document frequency and scaled to unit
length.  Each language keeps several centroids, found by spherical k-means of
its sample; a text takes the language of the centroid with the greatest cosine.
A text farther from that centroid than nearly all of its own members is
rejected.

Rows: one per input row, repeated rows too.  Null texts and texts without a
letter get ``und`` with score 0.  Nothing but the text enters a prediction.  With
no labelled text at all every text is ``und``.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from auditspan.llm.samples import labelled_sample, texts_of
from auditspan.llm.tasks import map_rows

DIMS = 1 << 13
LONGEST_GRAM = 3
CENTROIDS = 4
#: rows of each language that the centroids are fitted on
FIT_ROWS = 800
#: share of a cluster's own members that its distance bound turns away
REJECT_SHARE = 0.002
#: characters counted at once
CHUNK = 1 << 18
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def gram_counts(text: str) -> np.ndarray | None:
    """Counts of the hashed n-grams of a whole text, or None if it has no letter."""
    counts, seen = np.zeros(DIMS, np.float32), False
    for at in range(0, len(text), CHUNK):
        piece = text[max(0, at - LONGEST_GRAM):at + CHUNK].lower()
        points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[points]
        if not letter.any():
            continue
        seen = True
        points = np.where(letter, points, np.uint32(32))
        keep = np.ones(len(points), bool)
        keep[1:] = letter[1:] | letter[:-1]
        points = points[keep]
        gram = np.zeros(len(points), np.uint32)
        for width in range(1, LONGEST_GRAM + 1):
            gram = (gram[:-1] if width > 1 else gram) * np.uint32(0x01000193) + points[width - 1:]
            cells = ((gram + np.uint32(width)) * np.uint32(2654435769)) >> np.uint32(32 - DIMS.bit_length() + 1)
            counts += np.bincount(cells, minlength=DIMS)
    return counts if seen else None


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray  # one row each, unit length
    owner: np.ndarray  # index into languages
    bound: np.ndarray  # least cosine that is accepted
    languages: list[str]

    def vector(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf
        return v / max(float(np.linalg.norm(v)), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine, rejected)."""
        counts = gram_counts(text) if text and self.languages else None
        if counts is None:
            return UNKNOWN, 0.0, True
        near = self.centroids @ self.vector(counts)
        best = int(near.argmax())
        cosine = min(1.0, max(0.0, float(near[best])))
        return self.languages[self.owner[best]], cosine, cosine < self.bound[best]


def _clusters(vectors: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first seeds: centroids and each row's cluster."""
    mean = vectors.mean(0)
    seeds = [int((vectors @ mean).argmax())]
    while len(seeds) < min(k, len(vectors)):
        seeds.append(int((vectors @ vectors[seeds].T).max(1).argmin()))
    centers = vectors[seeds]
    for _ in range(rounds):
        own = (vectors @ centers.T).argmax(1)
        used = np.unique(own)
        centers = np.stack([vectors[own == c].mean(0) for c in used])
        centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
    return centers, (vectors @ centers.T).argmax(1)


def fit(docs: DataFrame, *, label: str = "lang", fit_rows: int = FIT_ROWS, most_rows: int = 20_000,
        centroids: int = CENTROIDS) -> Model:
    """Fit on at most ``fit_rows`` rows of a language and ``most_rows`` rows in all.

    Only n-gram counts of the sample reach the driver.
    """
    labelled = docs.filter(f"text is not null and {label} is not null")
    languages = max(1, labelled.select(label).distinct().count())
    sample = labelled_sample(labelled, label, max(1, min(fit_rows, most_rows // languages)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, cells = [], []
            for lang, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist()):
                counts = gram_counts(text)
                if counts is not None:
                    labels.append(lang)
                    cells.append(np.log1p(counts).astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(cells, pa.binary())],
                                             ["label", "cells"])

    rows = map_rows(texts_of(docs, sample).select("label", "text"), count, "label string, cells binary").toArrow()
    names = rows.column("label").to_pylist()
    if not names:
        none = np.zeros(0)
        return Model(none, np.zeros((0, DIMS)), none.astype(int), none, [])
    damped = np.stack([np.frombuffer(c, np.float16) for c in rows.column("cells").to_pylist()]).astype(np.float32)
    idf = np.log((1 + len(names)) / (1 + (damped > 0).sum(0))).astype(np.float32) + 1
    vectors = damped * idf
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    order = np.lexsort((vectors @ vectors.mean(0), names))  # the order of arrival does not matter
    vectors, names = vectors[order], np.array(names, object)[order]
    found, owner, bound, languages = [], [], [], sorted(set(names))
    for i, lang in enumerate(languages):
        own = vectors[names == lang]
        centers, cluster = _clusters(own, centroids)
        found.append(centers)
        owner += [i] * len(centers)
        near = (own * centers[cluster]).sum(1)
        bound += [float(np.quantile(near[cluster == c], REJECT_SHARE)) if (cluster == c).any() else 0.0
                  for c in range(len(centers))]
    return Model(idf, np.concatenate(found).astype(np.float32), np.array(owner), np.array(bound), languages)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected): nearest language, its cosine, and whether it is too far away."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t) for t in batch.column("text").to_pylist()]
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(list(c), k) for c, k in
                                           zip(columns, (pa.string(), pa.float64(), pa.bool_()))]],
                ["doc_id", "lang_pred", "score", "rejected"])

    return map_rows(docs.select("doc_id", "text"), run,
                    f"doc_id {kind}, lang_pred string, score double, rejected boolean")
