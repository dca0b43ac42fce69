"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Random indexing: every word has a fixed sparse random index vector; a word's vector is the sum of
the index vectors of its neighbours (``WINDOW`` on each side) over the whole corpus. Words are
hashed to the rows from 1 of a table of ``1 << BITS``; row 0 is no word's and stands between texts. So each task
holds one matrix of bounded size whatever the corpus is, and the matrices are added up by row. A document is the mean of its words' unit vectors, of their squares
and of the products of neighbours, and its length. A network with one hidden layer is trained in
numpy; its logit is divided by a temperature, and shifted to the labels' own shares, both fitted on
labelled texts that were held back.

Words keep their case, and signs are words too, because shouting and debris matter for quality.

Defined results: null and empty texts pool to the zero vector and get the network's score of it.
Texts are pooled whole, whatever their length. Equal texts get equal scores, repeated rows too. Columns besides id and text are not read,
whatever their names. An empty table gives an empty result; without labels of both kinds every score is 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import labelled_sample
from keyloom.llm.tokens import WordHasher

BITS, DIM, ONES, WINDOW, HIDDEN = 16, 48, 6, 2, 24
PATTERN = r"\w+|[^\w\s]+"


def index_vectors(seed: int = 11) -> np.ndarray:
    """Sparse ternary vectors, one for each hashed word: ONES entries of +1 or -1; row 0 is no word's and all zero."""
    rng = np.random.default_rng(seed)
    out = np.zeros((1 << BITS, DIM), np.float32)
    at = np.argsort(rng.random((len(out), DIM)), axis=1)[:, :ONES]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.float32), at.shape), axis=1)
    out[0] = 0
    return out


class RowHasher(WordHasher):
    """Rows 1 to 2**BITS - 1."""

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        got = self[word] = 1 + zlib.crc32(word.encode("utf-8", "surrogatepass")) % ((1 << BITS) - 1)
        return got


def hasher() -> RowHasher:
    return RowHasher(PATTERN, BITS, lower=False)


def _add_contexts(total: np.ndarray, ids: np.ndarray, index: np.ndarray) -> None:
    """Add to each word's row the index vectors of its neighbours, for a run of words."""
    if len(ids) < 2:
        return
    around = np.zeros((len(ids), DIM), np.float32)
    for k in range(1, WINDOW + 1):
        if len(ids) > k:
            around[k:] += index[ids[:-k]]
            around[:-k] += index[ids[k:]]
    for j in range(DIM):
        total[:, j] += np.bincount(ids, weights=around[:, j], minlength=len(total))


def word_vectors(docs: DataFrame, text: str = "text", block: int = 1 << 17) -> np.ndarray:
    """Unit vectors of all hashed words, gathered over every text of ``docs``.

    Each task emits at most ``1 << BITS`` rows, and so does the sum: what reaches the driver does
    not grow with the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, index, total = hasher(), index_vectors(), np.zeros((1 << BITS, DIM))
        gap = np.zeros(WINDOW, dtype=np.int64)  # the row of no word, between texts
        for batch in batches:
            held, n = [], 0
            for t in batch.column(0).to_pylist():
                ids = h.ids(t)
                held += [ids, gap]
                n += len(ids)
                if n > block:
                    _add_contexts(total, np.concatenate(held), index)
                    held, n = [], 0
            if held:
                _add_contexts(total, np.concatenate(held), index)
        rows = np.nonzero(total[1:].any(axis=1))[0] + 1
        for part in np.array_split(rows, max(1, len(rows) // 8192)) if len(rows) else ():
            flat = pa.array(total[part].astype(np.float32).reshape(-1))  # sums of ones: exact up to 2**24 in a task
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, DIM, dtype=np.int32)), flat)], names=["w", "v"])

    parts = docs.select(F.col(text)).where(F.col(text).isNotNull()).mapInArrow(run, "w int, v array<float>")
    summed = parts.groupBy("w").agg(*(F.sum(F.col("v")[j]).alias(f"v{j}") for j in range(DIM))).toArrow()
    out = np.zeros((1 << BITS, DIM))
    if summed.num_rows:
        out[summed.column(0).to_numpy()] = np.stack([summed.column(j + 1).to_numpy() for j in range(DIM)], axis=1)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0).astype(np.float32)


POOLED = 3 * DIM + 1


def pool(vectors: np.ndarray, ids: np.ndarray, block: int = 1 << 15) -> np.ndarray:
    """Mean and mean square of the words' vectors, mean product of neighbours', and log length.

    Products tell texts that say each word over and over from those that use the same words in
    sentences. The first two go by distinct words, the products by blocks, so memory is bounded.
    """
    out = np.zeros(POOLED, np.float32)
    if not len(ids):
        return out
    words, n = np.unique(ids, return_counts=True)
    share = (n / len(ids)).astype(np.float32)
    v = vectors[words]
    out[:DIM], out[DIM : 2 * DIM] = share @ v, share @ (v * v)
    for at in range(0, len(ids) - 1, block):
        v = vectors[ids[at : at + block + 1]]
        out[2 * DIM : 3 * DIM] += np.einsum("ij,ij->j", v[:-1], v[1:])
    out[2 * DIM : 3 * DIM] /= max(1, len(ids) - 1)
    out[-1] = np.log1p(len(ids)) / 10
    return out


@dataclass
class QualityModel:
    vectors: np.ndarray
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    w1: np.ndarray | None = None
    b1: np.ndarray | None = None
    w2: np.ndarray | None = None
    b2: float = 0.0
    temperature: float = 1.0
    shift: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        if self.w1 is None:
            return np.full(len(x), -30.0)
        return np.tanh(((x - self.centre) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature + self.shift, -30, 30)))


def fit(model: QualityModel, x: np.ndarray, y: np.ndarray, epochs: int = 150, rate: float = 0.01, batch: int = 64, decay: float = 1e-3, seed: int = 5) -> None:
    """Two layers by Adam on the logistic loss, classes weighted to equal sums."""
    rng = np.random.default_rng(seed)
    model.centre, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-4
    z = (x - model.centre) / model.scale
    p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    step, epochs = 0, max(10, min(epochs, 400_000 // len(y)))
    for _ in range(epochs):
        for idx in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            step += 1
            hidden = np.tanh(z[idx] @ p[0] + p[1])
            out = hidden @ p[2] + p[3]
            d = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[idx]) * weight[idx] / len(idx)
            back = np.outer(d, p[2]) * (1 - hidden**2)
            for k, g in enumerate([z[idx].T @ back + decay * p[0], back.sum(axis=0), hidden.T @ d + decay * p[2], np.array([d.sum()])]):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model.w1, model.b1, model.w2, model.b2 = p[0], p[1], p[2], float(p[3][0])


def fit_temperature(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Temperature and shift with the least weighted logistic loss on held-back labels, on a fine grid.

    Weights give the kinds of labels the shares they have among all labelled texts; the shift moves
    probabilities from the balanced sample to those shares.
    """
    best = (np.inf, 1.0, 0.0)
    for t in np.geomspace(0.2, 20, 60):
        for b in np.linspace(-4, 4, 81):
            loss = float(np.average(np.logaddexp(0, np.where(y == 1, -1, 1) * (z / t + b)), weights=weight))
            best = min(best, (loss, float(t), float(b)))
    return best[1], best[2]


def train(docs: DataFrame, labelled: DataFrame, label: Column, per_label: int = 2_500, text: str = "text", counts: dict[int, int] | None = None) -> QualityModel:
    """Word vectors from all of ``docs``; the network from at most ``per_label`` labelled texts of each kind.

    ``counts``: labels of each kind in all, if ``labelled`` is a sample already.
    """
    model, h = QualityModel(word_vectors(docs, text)), hasher()
    found: dict[int, list[np.ndarray]] = {0: [], 1: []}
    for y, t in labelled_sample(labelled, label, per_label, text=text):
        if y in found:
            found[y].append(pool(model.vectors, h.ids(t)))
    take = lambda held: [(x, y) for y, xs in found.items() for i, x in enumerate(xs) if (i % 4 == 3) == held]
    part, rest = take(False), take(True)
    y = np.array([b for _, b in part], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return model
    fit(model, np.array([a for a, _ in part], dtype=np.float64), y)
    if rest:
        z, y = model.logits(np.array([a for a, _ in rest], dtype=np.float64)), np.array([b for _, b in rest])
        total = counts or {r["y"]: r["n"] for r in labelled.groupBy(label.alias("y")).agg(F.count("*").alias("n")).collect()}
        weight = np.where(y == 1, total[1] / max(1, (y == 1).sum()), total[0] / max(1, (y == 0).sum()))
        model.temperature, model.shift = fit_temperature(z, y, weight)
    return model


def score(df: DataFrame, model: QualityModel, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, score) of each whole text. The model's size is fixed by its layers: 13 MB."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, h = shared.value, hasher()
        for batch in batches:
            x = np.array([pool(m.vectors, h.ids(t)) for t in batch.column(1).to_pylist()], dtype=np.float64).reshape(batch.num_rows, POOLED)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.probabilities(x), pa.float64())], names=["id", "score"])

    return df.selectExpr(f"`{id_col}` AS id", f"`{text}` AS text").mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
