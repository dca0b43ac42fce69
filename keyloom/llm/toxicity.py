"""Toxicity by a convolutional text classifier, trained in numpy.

Words are hashed to rows of an embedding, a word being the sum of its own row and that of its
first letters, so that rare forms share what is learnt of their stem; filters one, two and three words wide slide over the whole
text; each filter's largest response enters a logistic layer. Gradients pass only through the
windows that won the maximum. Decision thresholds are calibrated for each language group on
labelled texts that were held back from fitting, and the score is shifted so that the group's
threshold lies at 0.5. The group is told from the text itself, by the words of each language that the
labelled texts hold; a text few of whose words they hold is of no group.

Defined results: null and empty texts have no windows and get the score of the bias alone. Texts are read whole,
whatever their length. Equal texts get equal scores, repeated rows too. Columns besides id and text are not read for scores, whatever
their names. An empty table gives an empty result; without labels of both kinds every score is 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import labelled_sample
from keyloom.llm.tokens import WordHasher

BITS, DIM, FILTERS, WIDTHS = 16, 12, 8, (1, 2, 3)
PREFIX = 4

@dataclass
class ToxicityModel:
    embedding: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, DIM), np.float32))
    filters: dict[int, np.ndarray] = field(default_factory=dict)
    bias: dict[int, np.ndarray] = field(default_factory=dict)
    out: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, np.float32))
    out_bias: float = -30.0
    thresholds: dict[str, float] = field(default_factory=dict)
    steepness: float = 1.0
    groups: "LanguageGroups | None" = None


class PairHasher(WordHasher):
    """Rows of a word and of its first letters, side by side in an n x 2 array."""

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        hashed = lambda x: zlib.crc32(x.encode("utf-8", "surrogatepass")) & self.mask
        got = self[word] = hashed(word) << BITS | hashed(f"^{word[:PREFIX]}")
        return got

    def ids(self, text: str | None) -> np.ndarray:
        packed = super().ids(text)
        return np.stack([packed >> BITS, packed & self.mask], axis=1)


def hasher() -> PairHasher:
    return PairHasher(r"\w+", BITS, lower=True)


def _embed(model: "ToxicityModel", ids: np.ndarray) -> np.ndarray:
    return model.embedding[ids[:, 0]] + model.embedding[ids[:, 1]]


class LanguageGroups:
    """Naive Bayes over hashed words: in how many labelled texts of each language a word is found."""

    #: Least share of a text's words that labelled texts hold, to tell its language.
    KNOWN = 0.5

    def __init__(self, rows: list[tuple[str, np.ndarray]]):
        self.names = sorted({name for name, _ in rows})
        seen = np.zeros((1 << BITS, len(self.names)), dtype=np.float64)
        texts = np.zeros(len(self.names))
        for name, ids in rows:
            j = self.names.index(name)
            seen[np.unique(ids[:, 0]), j] += 1
            texts[j] += 1
        self.known = seen.sum(axis=1) > 1  # in more than one text
        self.log = np.log((seen + 0.1) / (texts + 1)).astype(np.float32)

    def guess(self, ids: np.ndarray) -> str:
        if not len(ids) or not self.names:
            return "none"
        words = ids[:, 0][self.known[ids[:, 0]]]
        if len(words) < self.KNOWN * len(ids):
            return "none"
        return self.names[int(self.log[words].sum(axis=0, dtype=np.float64).argmax())]


def _windows(model: ToxicityModel, x: np.ndarray, width: int) -> np.ndarray:
    """Responses of the filters of one width at every position of the embedded words ``x``."""
    w = model.filters[width]
    n = len(x) - width + 1
    got = x[:n] @ w[0]
    for k in range(1, width):
        got += x[k : n + k] @ w[k]
    return got


def _pool(model: ToxicityModel, ids: np.ndarray, block: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """For each filter the largest response (at least 0) and where it was (-1: nowhere)."""
    best = np.zeros((len(WIDTHS), FILTERS), model.embedding.dtype)
    where = np.full((len(WIDTHS), FILTERS), -1)
    for start in range(0, len(ids), block):  # blocks overlap by the widest filter, so all windows are seen
        x = _embed(model, ids[start : start + block + max(WIDTHS) - 1])
        for i, width in enumerate(WIDTHS):
            if len(x) < width:
                continue
            got = _windows(model, x, width) + model.bias[width]
            at = got.argmax(axis=0)
            top = got[at, np.arange(FILTERS)]
            better = top > best[i]
            best[i][better], where[i][better] = top[better], at[better] + start
    return best.reshape(-1), where.reshape(-1)


def logit(model: ToxicityModel, ids: np.ndarray) -> float:
    if not model.filters:
        return model.out_bias
    return float(_pool(model, ids)[0] @ model.out + model.out_bias)


def _contrast(samples: list[tuple[int, np.ndarray]], certain: float) -> np.ndarray:
    """How surely each hashed word is of one kind of text: its z value beyond ``certain``, else 0."""
    n, rows = np.zeros(2), np.zeros((2, 1 << BITS))
    for y, ids in samples:
        n[y] += 1
        rows[y, np.unique(ids)] += 1
    share = (rows[0] + rows[1]) / n.sum()
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-6) * (1 / n[0] + 1 / n[1]))
    z = (rows[1] / n[1] - rows[0] / n[0]) / spread
    return np.sign(z) * np.maximum(np.abs(z) - certain, 0)


def gradients(model: ToxicityModel, samples: list[tuple[int, np.ndarray]], weight: np.ndarray) -> tuple:
    """Of the weighted logistic loss: by output, its bias, filters and their biases by width, and rows of the embedding."""
    grad_out, grad_bias = np.zeros_like(model.out), 0.0
    grads, grad_b = {w: np.zeros_like(model.filters[w]) for w in WIDTHS}, {w: np.zeros_like(model.bias[w]) for w in WIDTHS}
    rows, values = [np.zeros(0, np.int64)], [np.zeros((0, DIM), model.embedding.dtype)]
    for (y, ids), own in zip(samples, weight):
        best, where = _pool(model, ids)
        d = float(1 / (1 + np.exp(-np.clip(best @ model.out + model.out_bias, -30, 30))) - y) * own
        grad_out += d * best
        grad_bias += d
        for j in np.nonzero(where >= 0)[0]:  # only the windows that won
            w, f, g, at = WIDTHS[j // FILTERS], j % FILTERS, d * model.out[j], where[j]
            win = ids[at : at + w]
            grads[w][:, :, f] += g * _embed(model, win)
            grad_b[w][f] += g
            rows += [win[:, 0], win[:, 1]]
            values += [g * model.filters[w][:, :, f]] * 2
    used, inverse = np.unique(np.concatenate(rows), return_inverse=True)
    g_rows = np.zeros((len(used), DIM), model.embedding.dtype)
    np.add.at(g_rows, inverse, np.concatenate(values))
    return grad_out, grad_bias, grads, grad_b, used, g_rows


def fit(samples: list[tuple[int, np.ndarray]], epochs: int = 6, rate: float = 0.01, batch: int = 32, decay: float = 0.02, certain: float = 3.5, seed: int = 7) -> ToxicityModel:
    """Adam on the logistic loss, classes weighted to equal sums.

    The embedding's first dimension starts at each word's contrast between the classes, so that few
    labels suffice; words without a certain contrast start at 0 and learn only through windows.
    """
    model, rng = ToxicityModel(), np.random.default_rng(seed)
    labels = np.array([y for y, _ in samples], dtype=np.float32)
    if not len(labels) or labels.min() == labels.max():
        return model
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    for w in WIDTHS:
        model.filters[w] = rng.normal(0, 0.4, (w, DIM, FILTERS)).astype(np.float32)
        model.bias[w] = np.full(FILTERS, 0.05, np.float32)
    contrast = _contrast(samples, certain)
    model.embedding[:, 0] = np.clip(contrast / 2, -2, 2)
    for w in WIDTHS:  # filters first listen to that dimension
        model.filters[w][:, 0, :] = np.abs(model.filters[w][:, 0, :]) + 0.5
    counts = np.zeros(1 << BITS)
    for _, ids in samples:
        counts[np.unique(ids)] += 1
    learns = (counts >= max(5, len(samples) // 200)).astype(np.float32)[:, None]
    model.out = np.abs(rng.normal(0, 0.3, model.out.shape)).astype(np.float32)
    model.out_bias = 0.0
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in [("e", model.embedding), ("o", model.out), *((f"f{w}", model.filters[w]) for w in WIDTHS), *((f"b{w}", model.bias[w]) for w in WIDTHS)]}
    step = 0
    for _ in range(epochs):
        for idx in np.array_split(rng.permutation(len(samples)), max(1, len(samples) // batch)):
            step += 1
            grad_out, grad_bias, grads, grad_b, used, g_rows = gradients(model, [samples[i] for i in idx], weight[idx] / len(idx))

            def adam(key: str, x: np.ndarray, g: np.ndarray, at=slice(None), t: int = step) -> None:
                m, v = state[key]
                m[at] = 0.9 * m[at] + 0.1 * g
                v[at] = 0.999 * v[at] + 0.001 * g * g
                x[at] -= rate * (m[at] / (1 - 0.9**t)) / (np.sqrt(v[at] / (1 - 0.999**t)) + 1e-6) + rate * decay * x[at]

            adam("o", model.out, grad_out)
            model.out_bias -= rate * grad_bias
            for w in WIDTHS:
                adam(f"f{w}", model.filters[w], grads[w])
                adam(f"b{w}", model.bias[w], grad_b[w])
            if len(used):
                adam("e", model.embedding, g_rows * learns[used], used)
    return model


def _best_threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The cut between logits with the highest F1; the middle of the best range."""
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][z[:-1] == z[1:]] = -1
    i = int(f1.argmax())
    return float((z[i] + z[i + 1]) / 2) if i + 1 < len(z) else float(z[i] - 1)


def train(rows: DataFrame, label: Column, per_label: int = 300, least: int = 12, text: str = "text", lang: str | None = "lang") -> ToxicityModel:
    """From at most ``per_label`` labelled texts of each kind and language; one in four only calibrates.

    A language has a threshold of its own if it has ``least`` held-back texts of each kind. Languages
    come from the labelled rows' column ``lang``; scores need the text alone.
    """
    h = hasher()
    name = F.coalesce(F.col(lang).cast("string"), F.lit("")) if lang else F.lit("")
    both = F.when(label.isNotNull(), F.concat(label.cast("int").cast("string"), F.lit("|"), name))
    found: dict[tuple[int, str], list[np.ndarray]] = {}
    for key, t in labelled_sample(rows, both, per_label, text=text):
        y, _, own = key.partition("|")
        if y in ("0", "1"):
            found.setdefault((int(y), own), []).append(h.ids(t))
    part = lambda held: [(y, own, x) for (y, own), xs in sorted(found.items()) for i, x in enumerate(xs) if (i % 4 == 3) == held]
    fitted, held = part(False), part(True)
    model = fit([(y, x) for y, _, x in fitted])
    model.groups = LanguageGroups([(own, x) for _, own, x in fitted if own])
    y = np.array([a for a, _, _ in held])
    if not model.filters or not len(y) or y.min() == y.max():
        return model
    z, groups = np.array([logit(model, x) for _, _, x in held]), np.array([model.groups.guess(x) for _, _, x in held])
    model.thresholds["any"] = _best_threshold(z, y)
    for one in sorted(set(groups)):
        own = groups == one
        if min(y[own].sum(), (1 - y[own]).sum()) >= least:
            model.thresholds[str(one)] = _best_threshold(z[own], y[own])
    model.steepness = float(min(1.0, 4.0 / max(1e-6, np.abs(z - model.thresholds["any"]).mean())))
    return model


class Scorer:
    def __init__(self, model: ToxicityModel):
        self.model, self.hasher = model, hasher()

    def score(self, text: str | None) -> float:
        ids = self.hasher.ids(text)
        m = self.model
        group = m.groups.guess(ids) if m.groups else "none"
        z = logit(m, ids) - m.thresholds.get(group, m.thresholds.get("any", 0.0))
        return float(1 / (1 + np.exp(-np.clip(m.steepness * z, -30, 30))))


def score(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, score) of each whole text. The model's size is fixed by its layers, and a column for each language: about 5 MB."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scorer.score(t) for t in batch.column(1).to_pylist()], pa.float64())], names=["id", "score"])

    return df.selectExpr(f"`{id_col}` AS id", f"`{text}` AS text").mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
