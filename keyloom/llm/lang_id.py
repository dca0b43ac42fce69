"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds all substrings of a labelled sample. A text is parsed
into phrases, each the longest match in the automaton that starts where the last phrase ended; a letter
that the sample doesn't have is a phrase of its own. The language that needs the fewest phrases for each
symbol wins; ties go to the first name.

Texts are folded to lower-case letters, with one blank for each run of anything else. Every letter of
every script is a symbol of its own. Texts are parsed whole: many of them advance side by side, one symbol a
step, and the last few, which are long, one by one.

The sample is ``per_language`` whole labelled texts of each language, chosen by hash; only of a text with more than
``longest`` symbols no more than these are used, so the automata are bounded. As many others of each
language calibrate the score: a softmax of the logarithms of phrases a symbol, times a factor that grows with a power
of the text's length. Both are chosen by the likelihood of the true language.

Defined results: a null text, or one without letters, is ``und`` with score 0. Equal texts get
equal results, repeated rows too. An empty table gives an empty result. Without labelled texts all is ``und``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import held, labelled_sample, tidy

#: Symbols with a column of the tables at most: the most frequent letters. Arcs of all others are in a sorted list.
DENSE = 56
#: A letter that no sample has.
UNKNOWN = (1 << 21) - 1
#: Texts that advance together, until so few are left that each is parsed on its own.
FEW = 24
#: Rows that are folded and parsed together, and bytes of their texts; a longer text is parsed alone. A symbol takes eight bytes.
ROWS, BYTES = 4000, 4 << 20


@dataclass(frozen=True)
class LanguageModel:
    """The bounded sample, as code points by language: automata are built from it where they are used."""

    languages: tuple[str, ...]
    alphabet: str
    samples: tuple[bytes, ...]
    sharpness: float = 8.0
    power: float = 0.0


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Folder:
    """Code points to symbols: 0 blank, 1.. the alphabet's letters in its order, UNKNOWN any other letter."""

    def __init__(self, alphabet: str):
        self.known = {c: i + 1 for i, c in enumerate(alphabet)}
        self.table = np.full(0x110000, -1, dtype=np.int32)

    def fold(self, text: str) -> np.ndarray:
        codes = _letters(text)
        got = self.table[codes]
        if (got < 0).any():  # code points met for the first time
            for c in np.unique(codes[got < 0]):
                ch = chr(c)
                self.table[c] = self.known.get(ch, UNKNOWN if ch.isalpha() else 0)
            got = self.table[codes]
        blank = got == 0
        keep = ~blank
        keep[1:] |= ~blank[:-1]
        got = got[keep]
        return got[1:] if len(got) and got[0] == 0 else got


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Arcs of the suffix automaton, one dictionary for each state."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def arcs_of(automaton: list[dict[int, int]]) -> tuple[int, np.ndarray]:
    """The number of states, and of every arc its state, symbol and target (rows)."""
    degree = np.fromiter(map(len, automaton), np.int32, len(automaton))
    arcs = np.empty((3, int(degree.sum())), dtype=np.int32)
    arcs[0] = np.repeat(np.arange(len(automaton), dtype=np.int32), degree)
    arcs[1] = np.fromiter(chain.from_iterable(automaton), np.int32, arcs.shape[1])
    arcs[2] = np.fromiter(chain.from_iterable(a.values() for a in automaton), np.int32, arcs.shape[1])
    return len(automaton), arcs


class CrossParser:
    def __init__(self, model: LanguageModel):
        self.model = model
        self.folder = Folder(model.alphabet)
        # one automaton's dictionaries at a time; of the others their arcs, 12 bytes each
        found, root, base = [], [], 0
        for s in model.samples:
            root.append(base)
            states, arcs = arcs_of(suffix_automaton(np.frombuffer(s, np.int32).tolist()))
            arcs[0] += base
            arcs[2] += base
            found.append(arcs)
            base += states
        self.root = np.array(root, dtype=np.int64)
        # one table for all languages; a missing arc is -1, and the last state has none: there a phrase starts
        self.new = base
        self.width = min(DENSE, len(model.alphabet) + 1)  # a short alphabet needs fewer columns
        self.flat = np.full((base + 1) * self.width, -1, dtype=np.int32)
        keys, targets = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for state, symbol, target in found:
            dense = symbol < self.width
            self.flat[state[dense] * np.int64(self.width) + symbol[dense]] = target[dense]
            keys.append(state[~dense].astype(np.int64) << 21 | symbol[~dense])
            targets.append(target[~dense].astype(np.int64))
        self.rare_keys, self.rare_next = np.concatenate(keys), np.concatenate(targets)
        order = np.argsort(self.rare_keys)
        self.rare_keys, self.rare_next = self.rare_keys[order], self.rare_next[order]
        self.rare = dict(zip(self.rare_keys.tolist(), self.rare_next.tolist()))

    def _arc(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        got = self.flat.take(state * self.width + np.minimum(symbol, self.width - 1)).astype(np.int64)
        odd = np.nonzero(symbol >= self.width)
        if len(odd[0]):
            key = state[odd] << 21 | symbol[odd]
            if len(self.rare_keys):
                at = np.minimum(np.searchsorted(self.rare_keys, key), len(self.rare_keys) - 1)
                got[odd] = np.where(self.rare_keys[at] == key, self.rare_next[at], -1)
            else:
                got[odd] = -1
        return got

    def _rest(self, symbols: list[int], state: int, root: int) -> int:
        """Phrases that begin in ``symbols``, read from ``state``."""
        flat, width, rare, new, n = self._view, self.width, self.rare, self.new, 0
        for c in symbols:
            state = flat[state * width + c] if c < width else rare.get(state << 21 | c, -1)
            if state < 0:
                n += 1
                state = flat[root * width + c] if c < width else rare.get(root << 21 | c, -1)
                if state < 0:
                    state = new
        return n

    def phrases(self, texts: list[np.ndarray], few: int = FEW) -> np.ndarray:
        """Phrases of each text (rows) by language (columns)."""
        n, k = len(texts), len(self.root)
        total = np.zeros((n, k), dtype=np.int64)
        order = sorted(range(n), key=lambda i: -len(texts[i]))
        while order and not len(texts[order[-1]]):
            order.pop()
        if not order:
            return total
        lengths = np.array([len(texts[i]) for i in order])
        every = np.concatenate([texts[i] for i in order])
        start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        count, state = np.zeros((k, len(order)), dtype=np.int64), np.full((k, len(order)), self.new, dtype=np.int64)
        upto = int(lengths[few]) if len(order) > few else 0  # so far more than ``few`` texts go on
        active = np.searchsorted(-lengths, -np.arange(upto), side="left")  # texts longer than the step's index
        root = np.broadcast_to(self.root[:, None], state.shape)
        for step in range(upto):
            m = active[step]
            c = np.broadcast_to(every[start[:m] + step], (k, m))
            got = self._arc(state[:, :m], c)
            miss = got < 0
            if miss.any():
                count[:, :m] += miss
                again = self._arc(root[:, :m][miss], c[miss])
                got[miss] = np.where(again < 0, self.new, again)
            state[:, :m] = got
        self._view = memoryview(self.flat)
        for j in range(min(few, len(order))):
            if lengths[j] > upto:
                left = every[start[j] + upto : start[j] + lengths[j]].tolist()
                for i in range(k):
                    count[i, j] += self._rest(left, int(state[i, j]), int(self.root[i]))
        total[order] = count.T
        return total

    def rates(self, texts: list[str | None]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Which texts have letters, their phrases a symbol by language, and their lengths."""
        folded = [self.folder.fold(t) if t else np.zeros(0, np.int32) for t in texts]
        found = [i for i, f in enumerate(folded) if f.any()]
        size = np.array([len(folded[i]) for i in found], dtype=np.float64)
        return found, self.phrases([folded[i] for i in found]) / size[:, None], size

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not len(self.root):
            return names, scores
        found, rate, size = self.rates(texts)
        if found:
            p = shares(rate, size, self.model.sharpness, self.model.power)
            for i, b, o in zip(found, rate.argmin(axis=1), p.max(axis=1)):
                names[i], scores[i] = self.model.languages[b], float(o)
        return names, scores


def shares(rate: np.ndarray, size: np.ndarray, sharpness: float, power: float) -> np.ndarray:
    """Probability of each language (columns) from phrases a symbol and lengths."""
    z = -np.log(rate) * (sharpness * size**power)[:, None]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def calibrated(model: LanguageModel, held: list[tuple[str, str]]) -> LanguageModel:
    """Sharpness and power with the highest likelihood of the languages of ``held`` (language, text)."""
    rows = [(model.languages.index(name), t) for name, t in held if name in model.languages]
    parser = CrossParser(model)
    # pieces of texts stand for short ones, where the languages are hard to tell
    texts = [x for y, t in rows for x in ((y, t), (y, t[:12]), (y, t[: max(1, len(t) // 2)]), (y, t[40:70]))]
    found, rate, size = parser.rates([t for _, t in texts])
    if not found:
        return model
    y = np.array([texts[i][0] for i in found])
    best = max((float(np.log(np.maximum(shares(rate, size, a, b)[np.arange(len(y)), y], 1e-6)).mean()), a, b) for a in np.geomspace(0.2, 60, 30) for b in (0.0, 0.25, 0.5, 0.75, 1.0))
    return LanguageModel(model.languages, model.alphabet, model.samples, float(best[1]), float(best[2]))


def train(rows: DataFrame, per_language: int = 20, longest: int = 200_000, lang: str = "lang", text: str = "text") -> LanguageModel:
    """From at most ``per_language`` labelled texts of each language; as many calibrate."""
    found: dict[str, list[str]] = {}
    for name, t in labelled_sample(rows, F.col(lang), 2 * per_language, text=text):
        found.setdefault(str(name), []).append(t)
    fitted = {name: texts[: max(1, min(per_language, (len(texts) + 1) // 2))] for name, texts in found.items()}
    counts: Counter[str] = Counter()
    for texts in fitted.values():
        for t in texts:
            counts.update(c for c in t.lower() if c.isalpha())
    alphabet = "".join(c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0])))
    folder, names, samples = Folder(alphabet), [], []
    for name in sorted(fitted):
        parts = [x for t in fitted[name] for x in (folder.fold(t)[:longest], np.zeros(1, np.int32))]
        if any(p.any() for p in parts):
            names.append(name)
            samples.append(np.concatenate(parts).astype(np.int32).tobytes())
    model = LanguageModel(tuple(names), alphabet, tuple(samples))
    if names:
        model = calibrated(model, [(name, t) for name, texts in found.items() for t in texts[len(fitted[name]) :]])
        tidy()  # the driver's own automata are gone
    return model


def slices(batch: pa.RecordBatch, at: int, rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """All rows of a batch in parts of at most ``rows`` rows and ``size`` bytes in column ``at``, one row at least."""
    upto = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(upto, upto[start] + size, side="right")) - 1
        end = min(max(end, start + 1), start + rows, batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def identify(df: DataFrame, model: LanguageModel, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``df`` with the predicted language and its score, from the whole text alone.

    Columns of the two names that ``df`` has already are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = df.drop(lang_out, score_out)
    names = kept.columns
    at = names.index(text)
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(kept.schema.fields)) + ", l string, s double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        parser = held(("languages", hash(found)), lambda: CrossParser(found))
        for batch in batches:
            for part in slices(batch, at):
                langs, scores = parser.predict(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*(f"c{i}" for i in range(len(names))), "l", "s"])
        tidy()

    return kept.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(run, schema).toDF(*names, lang_out, score_out)
