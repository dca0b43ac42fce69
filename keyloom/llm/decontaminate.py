"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words.

1. Every word n-gram of an item is a seed, however many documents hold it.
2. One pass looks the seeds up in every document. Hits whose diagonals (position in the document
   less position in the item) lie near each other give a window; one hit is enough. Near is as
   far as an alignment can shift before gaps take it below the threshold, and the window reaches as
   far beyond the hits: an alignment that holds a seed lies in one window.
3. An upper bound, which no alignment exceeds, rules out items and windows with too few of the
   item's words. The others are aligned by Smith-Waterman over words: match +1, mismatch and gap
   -0.5. The best score divided by the item's length is the similarity; from ``threshold`` on the
   document is reported. A copy that shares no n words in a row with its item is not seen.

Documents are not shuffled. The benchmark is worked through in blocks of at most ``block_words`` words, each a bounded
broadcast; only an item that is larger by itself makes a larger block, so one item's size is a bound too.

Defined results: null or empty texts and items match nothing. An item shorter than an n-gram is a
seed as a whole. Repeated rows give repeated results; equal items each get their own rows. Texts of any length
are scanned whole; an alignment takes memory in proportion to its window. Of equal scores the first window is reported. Rows
without an id are found too, and cleaned row by row. Only id and text are read, whatever other columns are named. Empty
tables give an empty result. Words are runs of letters, digits and underscores in lower case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import tidy
from keyloom.llm.tokens import WideHasher, quick_ngrams


@dataclass
class Benchmark:
    """One block of items: words by item, and seeds in order of their hash."""

    ids: list
    words: list[np.ndarray]
    seeds: np.ndarray  # distinct hashes, ascending
    first: np.ndarray  # seeds[i] occurs in entries first[i]:first[i + 1]
    item: np.ndarray
    at: np.ndarray

    def __post_init__(self) -> None:
        """Sizes of items, and a bit for the leading bits of each seed: most n-grams of a text are ruled out by it."""
        self.size = np.array([len(w) for w in self.words], dtype=np.int64)
        self.shift = np.uint64(64 - max(16, min(27, 5 + len(self.seeds).bit_length())))
        self.some = np.zeros(1 << (64 - int(self.shift)), dtype=bool)
        self.some[(self.seeds >> self.shift).astype(np.int64)] = True


def block_of(rows: list[tuple[object, str | None]], n: int, hasher: WideHasher) -> Benchmark:
    ids, words, grams, item, at = [], [], [], [], []
    for key, text in rows:
        w = hasher.ids(text)
        if not len(w):
            continue
        g = quick_ngrams(w, n)
        grams.append(g)
        item.append(np.full(len(g), len(ids)))
        at.append(np.arange(len(g)))
        ids.append(key)
        words.append(w)
    if not ids:
        z = np.zeros(0, dtype=np.int64)
        return Benchmark([], [], np.zeros(0, np.uint64), np.zeros(1, np.int64), z, z)
    g, item_, at_ = np.concatenate(grams), np.concatenate(item), np.concatenate(at)
    order = np.argsort(g, kind="stable")
    seeds, first = np.unique(g[order], return_index=True)
    return Benchmark(ids, words, seeds, np.append(first, len(g)), item_[order], at_[order])


def lookup(b: Benchmark, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``grams`` that are seeds, and which."""
    if not len(b.seeds) or not len(grams):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.nonzero(b.some[(grams >> b.shift).astype(np.int64)])[0]
    own = grams[at]
    i = np.minimum(np.searchsorted(b.seeds, own), len(b.seeds) - 1)
    hit = b.seeds[i] == own
    return at[hit], i[hit]


def align(item: np.ndarray, doc: np.ndarray, match: float = 1.0, mismatch: float = -0.5, gap: float = -0.5) -> tuple[float, int, int]:
    """Smith-Waterman: best local score, and where in ``doc`` it starts and ends (exclusive).

    Row by row over the item; gaps along the document are a running maximum, which numpy does for a
    whole row at once because the gap cost is linear.
    """
    m = len(doc)
    steps = np.arange(m + 1) * gap
    row, start = np.zeros(m + 1), np.arange(m + 1)
    best, where = 0.0, (0, 0)
    for w in item:
        diagonal = row[:-1] + np.where(doc == w, match, mismatch)
        above = row + gap
        got, origin = np.zeros(m + 1), np.arange(m + 1)
        better = diagonal > 0
        got[1:][better], origin[1:][better] = diagonal[better], start[:-1][better]
        better = above > got
        got[better], origin[better] = above[better], start[better]
        run = got - steps  # a gap along the row costs the same for each step
        top = np.maximum.accumulate(run)
        from_ = np.maximum.accumulate(np.where(run == top, np.arange(m + 1), 0))
        start = origin[from_]
        row = np.maximum(top + steps, 0)
        k = int(row.argmax())
        if row[k] > best:
            best, where = float(row[k]), (int(start[k]), k)
    return best, *where


def bound(item: np.ndarray, there: np.ndarray, mismatch: float = -0.5) -> float:
    """No alignment of ``item`` scores more with words of which ``there`` are the distinct ones, ascending.

    A word of the item that is there adds at most 1; another one is a mismatch or a gap, or lies outside.
    """
    if not len(there):
        return 0.0
    found = there[np.minimum(np.searchsorted(there, item), len(there) - 1)] == item
    total = np.concatenate([[0.0], np.cumsum(np.where(found, 1.0, mismatch))])
    return float((total - np.minimum.accumulate(total)).max())


def matches(b: Benchmark, words: np.ndarray, grams: np.ndarray, threshold: float) -> list[tuple[int, float, int, int]]:
    """(item, similarity, start, end) of items found in a document, each at its best window."""
    at, seed = lookup(b, grams)
    if not len(at):
        return []
    n = b.first[seed + 1] - b.first[seed]
    entry = np.repeat(b.first[seed], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    item, diagonal = b.item[entry], np.repeat(at, n) - b.at[entry]
    order = np.lexsort((diagonal, item))
    item, diagonal = item[order], diagonal[order]
    there = np.unique(words)
    hopeful = np.array([i for i in np.unique(item) if bound(b.words[i], there) >= threshold * len(b.words[i])], dtype=np.int64)
    on = np.isin(item, hopeful)
    item, diagonal = item[on], diagonal[on]
    if not len(item):
        return []
    size = b.size[item]
    reach = np.ceil((1 - threshold) * size / 0.5).astype(np.int64) + 1  # a gap costs 0.5 a word
    cuts = np.nonzero((item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > reach[1:]))[0] + 1
    best: dict[int, tuple[float, int, int]] = {}
    for lo, hi in zip([0, *cuts], [*cuts, len(item)]):
        i, length, pad = int(item[lo]), int(size[lo]), int(reach[lo])
        start = max(0, int(diagonal[lo]) - pad)
        window = words[start : int(diagonal[hi - 1]) + length + pad]
        if bound(b.words[i], np.unique(window)) < threshold * length:
            continue
        score, a, e = align(b.words[i], window)
        score /= length
        if score >= threshold and (i not in best or score > best[i][0]):
            best[i] = (score, start + a, start + e)
    return [(i, *x) for i, x in sorted(best.items())]


def blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int) -> Iterator[list[tuple]]:
    """The benchmark in blocks by their number of words; one block at a time on the driver."""
    held, n, words = [], 0, re.compile(r"\w+")
    for r in benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).toLocalIterator():
        size = sum(1 for _ in words.finditer(r["t"] or "")) + 1
        if held and n + size > block_words:
            yield held
            held, n = [], 0
        held.append((r["i"], r["t"]))
        n += size
    if held:
        yield held


def find(docs: DataFrame, benchmark: DataFrame, n: int = 3, threshold: float = 0.5, block_words: int = 2_000_000, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, start, end): items found in documents, positions in words."""
    spark = docs.sparkSession
    kinds = [docs.schema[doc_id].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()]
    schema = f"d {kinds[0]}, i {kinds[1]}, similarity double, start int, end int"
    texts = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    out = None
    for rows in blocks(benchmark, item_id, text, block_words):
        block = block_of(rows, n, WideHasher())
        kept = spark.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], kept=kept) -> Iterator[pa.RecordBatch]:
            b, hasher = kept.value, WideHasher()
            for batch in batches:
                ids, found = [], []
                for k, t in enumerate(batch.column(1).to_pylist()):
                    words = hasher.ids(t)
                    for hit in matches(b, words, quick_ngrams(words, n), threshold):
                        ids.append(k)
                        found.append(hit)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(ids, pa.int64())), pa.array([b.ids[x[0]] for x in found], schema_i), *(pa.array([x[j] for x in found], kind) for j, kind in ((1, pa.float64()), (2, pa.int32()), (3, pa.int32())))],
                    names=["d", "i", "similarity", "start", "end"],
                )
            tidy()

        from pyspark.sql.pandas.types import to_arrow_type

        schema_i = to_arrow_type(benchmark.schema[item_id].dataType)
        part = texts.mapInArrow(scan, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.withColumnsRenamed({"d": doc_id, "i": item_id})


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 3, threshold: float = 0.5, block_words: int = 2_000_000, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which ``find`` finds nothing; decided row by row, whatever their ids."""
    out, column = docs, docs.columns.index(text)
    for rows in blocks(benchmark, item_id, text, block_words):
        kept = docs.sparkSession.sparkContext.broadcast(block_of(rows, n, WideHasher()))

        def scan(batches: Iterator[pa.RecordBatch], kept=kept) -> Iterator[pa.RecordBatch]:
            b, hasher = kept.value, WideHasher()
            for batch in batches:
                stay = []
                for t in batch.column(column).to_pylist():
                    words = hasher.ids(t)
                    stay.append(not matches(b, words, quick_ngrams(words, n), threshold))
                yield batch.filter(pa.array(stay, pa.bool_()))
            tidy()

        out = out.mapInArrow(scan, docs.schema)
    return out
