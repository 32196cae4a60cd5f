"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it.  Every
byte has a learned vector; learned filters look at ``WIDTH`` neighbouring bytes,
and their greatest answer in a chunk is kept.  The greatest and the mean answer over
the chunks of a document go through one logistic unit.  Training is plain
back-propagation with Adam on a bounded sample of labelled rows.

Rows: one per input row, repeated rows too.  Null and empty texts are one chunk of
padding and get a score like any other.  Nothing but the text enters a score.
With no labelled row, or with one label only, the score is that label's share (0.5 without labels).
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from auditspan.llm.samples import labelled_sample, texts_of
from auditspan.llm.tasks import map_rows, utf8

CHUNK = 512
OVERLAP = 64
WIDTH = 6
STRIDE = 2
BYTE_DIMS = 8
FILTERS = 24
#: rows of each label that the network is fitted on, and chunks drawn from each
FIT_ROWS = 1500
FIT_CHUNKS = 6
EPOCHS = 8
PAD = 256


def chunk_starts(length: int) -> np.ndarray:
    return np.arange(0, max(1, length - OVERLAP), CHUNK - OVERLAP)


def chunks(data: bytes, starts: np.ndarray | None = None) -> np.ndarray:
    """Rows of CHUNK byte numbers; PAD after the end of the text."""
    whole = np.frombuffer(data, np.uint8)
    starts = chunk_starts(len(whole)) if starts is None else starts
    padded = np.full(int(starts[-1]) + CHUNK if len(whole) < int(starts.max()) + CHUNK else len(whole), PAD, np.int16)
    padded[:len(whole)] = whole
    return padded[starts[:, None] + np.arange(CHUNK)]


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {
            "byte": rng.normal(0, 0.5, (PAD + 1, BYTE_DIMS)), "filter": rng.normal(0, 0.3, (WIDTH * BYTE_DIMS, FILTERS)),
            "bias": np.zeros(FILTERS), "out": rng.normal(0, 0.1, 2 * FILTERS), "shift": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.constant: float | None = None

    def _patches(self, cut: np.ndarray) -> np.ndarray:
        """(chunks, places, WIDTH * BYTE_DIMS)."""
        vectors = self.p["byte"][cut]
        places = np.arange(0, CHUNK - WIDTH + 1, STRIDE)
        return vectors[:, places[:, None] + np.arange(WIDTH)].reshape(len(cut), len(places), -1)

    def answers(self, cut: np.ndarray) -> np.ndarray:
        """The greatest answer of every filter in every chunk."""
        # one table per place in the filter: a byte's share of each filter's answer
        share = np.einsum("bd,wdf->wbf", self.p["byte"], self.p["filter"].reshape(WIDTH, BYTE_DIMS, FILTERS))
        n = (CHUNK - WIDTH) // STRIDE + 1
        total = share[0][cut[:, 0:STRIDE * n:STRIDE]]
        for w in range(1, WIDTH):
            total += share[w][cut[:, w:w + STRIDE * n:STRIDE]]
        return np.maximum(total.max(1) + self.p["bias"], 0)

    def score(self, data: bytes) -> float:
        if self.constant is not None:
            return self.constant
        starts, top, total = chunk_starts(len(data)), np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float32)
        for at in range(0, len(starts), 64):  # bounded memory for any length
            part = starts[at:at + 64]
            found = self.answers(chunks(data[part[0]:part[-1] + CHUNK], part - part[0]))
            top, total = np.maximum(top, found.max(0)), total + found.sum(0)
        z = float(np.concatenate([top, total / len(starts)]) @ self.p["out"] + self.p["shift"][0])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def train(self, docs: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, epochs: int = EPOCHS,
              batch: int = 32, rate: float = 0.004, seed: int = 11) -> None:
        """``docs``: the drawn chunks of each document."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = 0
        for epoch in range(epochs):
            for picked in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // batch)):
                grads = self._gradients([docs[i] for i in picked], labels[picked], weights[picked])
                step += 1
                for k, g in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    move = rate * (0.5 if epoch >= epochs // 2 else 1) * (m[k] / (1 - 0.9 ** step))
                    self.p[k] -= (move / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)

    def _gradients(self, docs: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> dict:
        cut = np.concatenate(docs)
        sizes = np.array([len(d) for d in docs])
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        patches = self._patches(cut)
        answers = patches @ self.p["filter"]
        where = answers.argmax(1)  # (chunks, FILTERS)
        best = np.maximum(np.take_along_axis(answers, where[:, None], 1)[:, 0] + self.p["bias"], 0)
        top = np.maximum.reduceat(best, first)
        mean = np.add.reduceat(best, first) / sizes[:, None]
        features = np.concatenate([top, mean], 1)
        p = 1 / (1 + np.exp(-np.clip(features @ self.p["out"] + self.p["shift"], -30, 30)))
        dz = ((p - labels) * weights / len(docs)).astype(np.float32)
        back = dz[:, None] * self.p["out"]
        owner = np.repeat(np.arange(len(docs)), sizes)
        dbest = (back[:, FILTERS:] / sizes[:, None])[owner]
        is_top = best == top[owner]
        dbest = (dbest + back[:, :FILTERS][owner] * is_top) * (best > 0)
        # only the winning place of each filter and chunk gets a share
        won = np.take_along_axis(patches[:, :, :, None].reshape(len(cut), patches.shape[1], -1), where[:, :, None], 1)
        dfilter = np.einsum("cfk,cf->kf", won, dbest)
        dwon = dbest[:, :, None] * self.p["filter"].T[None]
        rows = cut[np.arange(len(cut))[:, None, None], where[:, :, None] * STRIDE + np.arange(WIDTH)]
        dbyte = np.zeros_like(self.p["byte"])
        np.add.at(dbyte, rows.reshape(-1), dwon.reshape(-1, BYTE_DIMS))
        return {"byte": dbyte, "filter": dfilter, "bias": dbest.sum(0), "out": features.T @ dz,
                "shift": np.array([dz.sum()], np.float32)}


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", fit_rows: int = FIT_ROWS,
        fit_chunks: int = FIT_CHUNKS) -> Network:
    """Fit on at most ``fit_rows`` rows of each label and ``fit_chunks`` random chunks of each.

    ``labels`` holds (doc_id, label) of the rows that may be learned from.  Only
    the drawn chunks reach the driver.  Weights undo the equal shares of the
    labels in the sample, so that a score is a probability.
    """
    counts = {int(r[0]): r[1] for r in labels.filter(f"{label} is not null").groupBy(label).count().collect()}
    network = Network()
    total = sum(counts.values())
    if len(counts) < 2:
        network.constant = 0.5 if not total else float(next(iter(counts)))
        return network
    sample = labelled_sample(labels, label, fit_rows)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kinds, drawn = batch.column("doc_id"), batch.column("label"), []
            for doc_id, data in zip(ids.to_pylist(), utf8(batch.column("text"))):
                starts = chunk_starts(len(data))
                if len(starts) > fit_chunks:
                    starts = np.sort(np.random.default_rng(doc_id % (1 << 63)).choice(starts, fit_chunks, replace=False))
                drawn.append(chunks(data, starts).astype(np.int16).tobytes())
            yield pa.RecordBatch.from_arrays([ids, kinds.cast(pa.int32()), pa.array(drawn, pa.binary())],
                                             ["doc_id", "label", "chunks"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = map_rows(texts_of(docs, sample).select("doc_id", "label", "text"), draw,
                    f"doc_id {kind}, label int, chunks binary").toArrow().sort_by("doc_id")
    y = np.array(rows.column("label").to_pylist(), np.float32)
    if len(set(y.tolist())) < 2:
        network.constant = sum(k * n for k, n in counts.items()) / total
        return network
    drawn = [np.frombuffer(c, np.int16).reshape(-1, CHUNK) for c in rows.column("chunks").to_pylist()]
    share = {k: float((y == k).mean()) for k in counts}
    weights = np.array([counts[int(k)] / total / max(share[int(k)], 1e-9) for k in y], np.float32)
    network.train(drawn, y, weights)
    return network


def with_score(docs: DataFrame, network: Network) -> DataFrame:
    """``docs`` with a column ``score``, the probability of label 1 for every whole text.

    A column of that name is replaced.
    """
    docs = docs.drop("score")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [network.score(t or b"") for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())],
                                             [*batch.schema.names, "score"])

    return map_rows(docs, run, ", ".join([*fields, "score double"]))


def score(docs: DataFrame, network: Network) -> DataFrame:
    """(doc_id, score) of every row."""
    return with_score(docs.select("doc_id", "text"), network).select("doc_id", "score")
