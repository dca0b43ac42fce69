"""Byte-level BPE by a lazily determinised finite-state transducer.

A token sequence is the encoding of its bytes exactly if every adjacent pair of tokens is, as a
text of its own, encoded to that pair. So merges compile to a nondeterministic transducer whose
configurations are (last token, node of the vocabulary's trie): a byte moves down the trie, and at
a node that is a token the machine may emit it and return to the root, provided the pair is
compatible. Subsets of configurations with their pending outputs become states of a deterministic
transducer when they are first met; what all pending outputs of a state share is emitted at once.
A pending output ends within the longest token, so lookahead is bounded.

Decoding feeds the bytes of each token to an incremental UTF-8 machine, a table of states and bytes. What a
token does from a state is remembered, so most tokens are one step.

The pattern's classes are those of the Unicode version that the public library has: code points that the
``regex`` package knows and it does not are no letters and no numbers here.

Defined results: null texts are encoded as empty ones, empty texts give no tokens; so do null ids. Texts of any length are
encoded whole, with tables of bounded size. Repeated rows get equal results. Columns that are named pass unread, others are dropped, and
names clash with nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import held, tidy

MAX_VOCABULARY_BYTES = 64 << 20


def read_ranks(path: str) -> bytes:
    """The vocabulary file; its size is checked because it is sent to every executor."""
    with open(path, "rb") as f:
        raw = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return raw


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


class _State:
    """Configurations as one flat tuple of last token, node and pending output; arcs by byte.

    An arc is the next state, or (next state, output) if it emits.
    """

    __slots__ = ("configs", "next")

    def __init__(self, configs: tuple):
        self.configs, self.next = configs, {}


class Transducer:
    """Encodes one piece (a match of the pre-tokenizer's pattern) at a time.

    ``max_states`` and ``max_pieces`` bound the lazily built tables, so memory is bounded whatever
    the texts are: a full table of states is built anew, and of pieces two generations are kept.
    """

    FEW = 24

    def __init__(self, ranks: dict[bytes, int], max_states: int = 200_000, max_pieces: int = 150_000):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary needs all 256 single bytes")
        self.child: dict[int, int] = {}
        self.accept: list[int] = [-1]
        self.first: list[bytes] = [b""]
        for t, i in ranks.items():
            node = 0
            for b in t:
                nxt = self.child.get(node << 8 | b)
                if nxt is None:
                    nxt = self.child[node << 8 | b] = len(self.accept)
                    self.accept.append(-1)
                    self.first.append(t[:1])
                node = nxt
            self.accept[node] = i
        self.max_states, self.max_pieces = max_states, max_pieces
        self._pairs: dict[int, bool] = {}
        self._own: dict[int, tuple | None] = {}
        self._live: dict[int, bool] = {}
        # below each node: the lowest rank at which a token's first byte merges, and the tokens if they are few
        self.low = [1 << 60] * len(self.accept)
        self.few: list[list[int] | None] = [[] for _ in self.accept]
        for t, i in ranks.items():
            spines = self._spines(i)
            if spines is None or len(t) < 2:
                continue
            first, node = spines[0][1], 0
            for b in t[:-1]:
                node = self.child[node << 8 | b]
                if first < self.low[node]:
                    self.low[node] = first
                few = self.few[node]
                if few is not None:
                    if len(few) < self.FEW:
                        few.append(i)
                    else:
                        self.few[node] = None
        self._reset()
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _reset(self) -> None:
        self.states: dict[tuple, _State] = {}
        self.start = self.states[(-1, 0, ())] = _State((-1, 0, ()))

    def _spines(self, t: int) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
        """Tokens along the left and the right edge of the tree that merges build over token ``t``.

        From single byte to whole token, in the order in which they arise; None if merges by rank
        don't make ``t`` of its bytes, or not in rising order of rank.
        """
        if t in self._own:
            return self._own[t]
        raw, ranks = self.token[t], self.ranks
        parts = [(raw[i : i + 1], (ranks[raw[i : i + 1]],), (ranks[raw[i : i + 1]],)) for i in range(len(raw))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i][0] + parts[i + 1][0])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            (x, left, _), (y, _, right) = parts[at : at + 2]
            parts[at : at + 2] = [(x + y, (*left, best), (*right, best))]
        ok = len(parts) == 1 and parts[0][0] == raw
        out = parts[0][1:] if ok and all(list(p[1:]) == sorted(p[1:]) for p in parts[0][1:]) else None
        self._own[t] = out
        return out

    def _compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of ``a`` and ``b`` together encode to just these two tokens.

        Both trees grow in order of rank. Where the tokens that touch at the boundary would merge
        before either merges into its own tree, the pair is not an encoding. Of equal ranks the
        left one comes first.
        """
        left = self._spines(b)
        if a < 0 or left is None:
            return left is not None
        key = a << 32 | b
        ok = self._pairs.get(key)
        if ok is None:
            if len(self._pairs) > 200_000:
                self._pairs.clear()
            xs, ys, i, j, ok = self._spines(a)[1], left[0], 0, 0, True
            end, token, ranks = 1 << 60, self.token, self.ranks
            while True:
                grow_x = xs[i + 1] if i + 1 < len(xs) else end
                grow_y = ys[j + 1] if j + 1 < len(ys) else end
                r = ranks.get(token[xs[i]] + token[ys[j]])
                if r is not None and r < grow_x and r <= grow_y:
                    ok = False
                    break
                if grow_x == end and grow_y == end:
                    break
                if grow_x <= grow_y:
                    i += 1
                else:
                    j += 1
            self._pairs[key] = ok
        return ok

    def _alive(self, last: int, node: int) -> bool:
        """False if surely no token below ``node`` is compatible with ``last``.

        If the bytes at the boundary merge before either side's first merge, none is; where few
        tokens are below the node, each is tried. Configurations that wait in vain would only
        multiply states and delay output.
        """
        key = last << 32 | node
        ok = self._live.get(key)
        if ok is None:
            if len(self._live) > 250_000:
                self._live.clear()
            if last < 0:
                ok = self.low[node] < 1 << 60
            else:
                xs, first = self._spines(last)[1], self.first[node]
                r = self.ranks.get(self.token[xs[0]] + first)
                few = self.few[node]
                if r is not None and r <= self.low[node] and (len(xs) == 1 or r < xs[1]):
                    ok = False
                else:
                    ok = few is None or any(self._compatible(last, t) for t in few)
            self._live[key] = ok
        return ok

    def _step(self, state: _State, byte: int) -> _State | tuple[_State, tuple[int, ...]]:
        """The transition, determinised when first taken: the next state and what is emitted."""
        child, accept, alive, old = self.child, self.accept, self._alive, state.configs
        outs, ends = [], []  # configurations stay in the order of their last token's end; the one at the root is the last
        new, at_root = None, -1
        for i in range(0, len(old), 3):
            last, out = old[i], old[i + 2]
            nxt = child.get(old[i + 1] << 8 | byte)
            if nxt is not None:
                if alive(last, nxt):
                    outs.append(out)
                    ends.append((last, nxt))
                t = accept[nxt]
                if t >= 0 and new is None and self._compatible(last, t):
                    new, at_root = (*out, t), t
        outs.append(new)
        ends.append((at_root, 0))
        first = outs[0]
        shared = len(first)
        if shared:
            for out in outs:
                while first[:shared] != out[:shared]:
                    shared -= 1
        flat: list = []
        for (last, node), out in zip(ends, outs):
            flat += (last, node, out[shared:])
        configs = tuple(flat)
        found = self.states.get(configs)
        if found is None:
            if len(self.states) >= self.max_states:
                self._reset()
            found = self.states[configs] = _State(configs)
        arc = state.next[byte] = (found, first[:shared]) if shared else found
        return arc

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Tokens of one piece whose bytes come in chunks, each as soon as it is certain."""
        state = self.start
        for chunk in chunks:
            for b in chunk:
                state = state.next.get(b) or self._step(state, b)
                if type(state) is tuple:
                    state, out = state
                    yield from out
        yield from state.configs[-1]

    def piece(self, text: str) -> bytes:
        """The tokens of one piece as packed 32-bit integers."""
        got = self.older.get(text)
        if got is None:
            raw = text.encode("utf-8")
            whole = self.ranks.get(raw)
            if whole is not None:  # a piece that is a token is that token, also if no merges lead there
                ids = [whole]
            else:
                state, ids = self.start, []
                for b in raw:
                    state = state.next.get(b) or self._step(state, b)
                    if type(state) is tuple:
                        ids += state[1]
                        state = state[0]
                ids += state.configs[-1]
            got = array("i", ids).tobytes()
            if len(raw) > 64:
                return got
        if len(self.pieces) >= self.max_pieces:
            self.older = dict(self.pieces)
            self.pieces.clear()
        self.pieces[text] = got
        return got


#: Code points that Unicode 17 and later assign as letters and as numbers, which version 16 doesn't have.
NEWER_LETTERS = r"\u0558\u058B-\u058C\u088F\u0C5C\u0CDC\u208F\u209D-\u209F\uA7CE-\uA7CF\uA7D2\uA7D4\uA7DD\uA7E2\uA7F1\uAB6C-\uAB6D\U000107BB-\U000107BF\U00010940-\U00010959\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A\U00011DB0-\U00011DDB\U00011DF1\U00016EA0-\U00016EB8\U00016EBB-\U00016ED3\U00016FF2-\U00016FF3\U000187F8-\U000187FF\U00018CD6-\U00018CDA\U00018D09-\U00018D20\U00018D80-\U00018DF2\U00018E00-\U00019191\U000191A0-\U000191D2\U0001B123-\U0001B128\U0001B168\U0001D6A6\U0001DF1F-\U0001DF24\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96\U0001DFCD-\U0001DFFF\U0001E6C0-\U0001E6DE\U0001E6E0-\U0001E6E2\U0001E6E4-\U0001E6E5\U0001E6E7-\U0001E6ED\U0001E6F0-\U0001E6F4\U0001E6FE-\U0001E6FF\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD\U000323B0-\U00033479\U0003D000-\U0003FC3F"
NEWER_NUMBERS = r"\U00011DE0-\U00011DE9\U0001246F\U00012475-\U0001247F\U00012550-\U00012686\U00016FF4-\U00016FF6"


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.find = regex.compile(pattern).findall
        # the exact classes are slower; few texts hold a code point on which they differ
        self.newer = re.compile(f"[{NEWER_LETTERS}{NEWER_NUMBERS}]").search
        self.find_exact = regex.compile("(?V1)" + pattern.replace(r"\p{L}", rf"[\p{{L}}--[{NEWER_LETTERS}]]").replace(r"\p{N}", rf"[\p{{N}}--[{NEWER_NUMBERS}]]")).findall
        self.machine = Transducer(ranks)

    def packed(self, text: str | None) -> bytes:
        """The ids of a whole text as packed 32-bit integers."""
        known, piece, text = self.machine.pieces.get, self.machine.piece, text or ""
        find = self.find if text.isascii() or not self.newer(text) else self.find_exact
        return b"".join([known(m) or piece(m) for m in find(text)])

    def encode(self, text: str | None) -> list[int]:
        return list(array("i", self.packed(text)))


def _utf8_table() -> list[int]:
    """Next state by state << 8 | byte; -1: malformed. State 0 is between characters.

    States 1 to 3 wait for so many bytes 80 to BF; 4 to 7 follow E0, ED, F0 and F4, whose second byte
    has a narrower range.
    """
    table = [-1] * (8 << 8)

    def put(state: int, lo: int, hi: int, nxt: int) -> None:
        for b in range(lo, hi + 1):
            table[state << 8 | b] = nxt

    put(0, 0x00, 0x7F, 0)
    put(0, 0xC2, 0xDF, 1)
    put(0, 0xE1, 0xEF, 2)
    put(0, 0xF1, 0xF3, 3)
    for first, state in ((0xE0, 4), (0xED, 5), (0xF0, 6), (0xF4, 7)):
        put(0, first, first, state)
    for state in (1, 2, 3):
        put(state, 0x80, 0xBF, state - 1)
    put(4, 0xA0, 0xBF, 1)
    put(5, 0x80, 0x9F, 1)
    put(6, 0x90, 0xBF, 2)
    put(7, 0x80, 0x8F, 2)
    return table


UTF8 = _utf8_table()


class Utf8Machine:
    """Incremental UTF-8: feed bytes, get the text that is complete; an unfinished character waits.

    Malformed bytes give U+FFFD, one for each maximal part of a character, as Unicode advises. ``known``
    may be shared by machines: it remembers what a token's bytes do after those that wait.
    """

    def __init__(self, known: dict[bytes, dict[bytes, tuple[str, bytes]]] | None = None) -> None:
        self.pending = b""
        self.known = {} if known is None else known

    @staticmethod
    def run(pending: bytes, raw: bytes) -> tuple[str, bytes]:
        """The text that ends within ``raw``, read after ``pending``, and the bytes that then wait."""
        table, out, state, code, held = UTF8, [], 0, 0, bytearray()
        for b in pending + raw:
            nxt = table[state << 8 | b]
            if nxt < 0:
                if held:  # the character ends here; the byte may begin another one
                    out.append("\ufffd")
                    held.clear()
                    nxt = table[b]
                if nxt < 0:
                    out.append("\ufffd")
                    state = 0
                    continue
            if held:
                code = code << 6 | b & 0x3F
            else:
                code = b if b < 0x80 else b & (0x1F if b < 0xE0 else 0x0F if b < 0xF0 else 0x07)
            state = nxt
            if state:
                held.append(b)
            else:
                out.append(chr(code))
                held.clear()
        return "".join(out), bytes(held)

    def feed(self, raw: bytes) -> str:
        after = self.known.get(self.pending)
        if after is None:
            after = self.known[self.pending] = {}
        got = after.get(raw)
        if got is None:
            got = self.run(self.pending, raw)
            if len(raw) <= 256:
                after[raw] = got
        self.pending = got[1]
        return got[0]

    def close(self) -> str:
        rest, self.pending = self.pending, b""
        return "\ufffd" if rest else ""


class Decoder:
    """Ids to bytes and text, ``chunk`` tokens at a time."""

    def __init__(self, ranks: dict[bytes, int], chunk: int = 4096):
        self.token = {i: t for t, i in ranks.items()}
        self.chunk = chunk
        self.known: dict[bytes, dict[bytes, tuple[str, bytes]]] = {}  # bounded: waiting bytes of UTF-8, times tokens met after them
        self.plain: dict[int, str | None] = {}  # text of a token that starts and ends between characters

    def stream(self, ids: Iterable[int]) -> Iterator[tuple[bytes, str]]:
        """Bytes and text of ``chunk`` tokens after the other."""
        machine, rest = Utf8Machine(self.known), iter(ids)
        while part := tuple(islice(rest, self.chunk)):
            yield b"".join(map(self.token.__getitem__, part)), self._text(machine, part)
        yield b"", machine.close()

    def _text(self, machine: Utf8Machine, part: Iterable[int]) -> str:
        out, plain, token = [], self.plain, self.token
        if len(self.known) > 20_000:
            self.known.clear()
        for i in part:
            if not machine.pending:
                text = plain.get(i)
                if text is not None:
                    out.append(text)
                    continue
            before = machine.pending
            text = machine.feed(token[i])
            if not before and not machine.pending:
                plain[i] = text
            out.append(text)
        return "".join(out)

    def text(self, ids: Iterable[int]) -> str:
        machine = Utf8Machine(self.known)
        return self._text(machine, ids) + machine.close()

    def decode(self, ids: Iterable[int]) -> tuple[bytes, str]:
        parts = list(self.stream(ids))
        return b"".join([a for a, _ in parts]), "".join([b for _, b in parts])


def _machines(raw: bytes, pattern: str) -> tuple[Encoder, Decoder]:
    """One pair for each Python worker and vocabulary: workers are used again, so are the tables."""

    def make() -> tuple[Encoder, Decoder]:
        ranks = parse_ranks(raw)
        return Encoder(ranks, pattern), Decoder(ranks)

    return held(("bpe", hash(raw), pattern), make)


def _slices(batch: pa.RecordBatch, rows: int = 250) -> Iterator[pa.RecordBatch]:
    """Small parts of a batch, so that a worker holds the Python objects of few texts at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _mapped(df: DataFrame, ranks_path: str, columns: list[str], carry: tuple[str, ...], schema: str, work) -> DataFrame:
    """``work(ranks file, column of the second name as list)`` gives the arrays that follow.

    ``carry`` names columns of ``df`` that pass unread, between the id and what is made.
    """
    raw = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    passed = [columns[0], *carry]
    kinds = [f"c{i} {df.schema[n].dataType.simpleString()}" for i, n in enumerate(passed)]
    names = [*(f"c{i}" for i in range(len(passed))), *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *work(raw.value, part.columns[-1].to_pylist())], names=names)
        tidy()

    out = df.select(*(F.col(n).alias(f"c{i}") for i, n in enumerate(passed)), F.col(columns[1]).alias("x")).mapInArrow(run, ", ".join([*kinds, schema]))
    return out.withColumnsRenamed({f"c{i}": n for i, n in enumerate(passed)})


def _ids(packed: list[bytes]) -> pa.Array:
    offsets = np.cumsum([0, *(len(x) // 4 for x in packed)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), dtype=np.int32)))


def _decoded(coder: Decoder, ids: list[list[int] | None]) -> list[pa.Array]:
    out = [coder.decode(() if x is None else x) for x in ids]
    return [pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.string())]


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, ids array<int>): each whole text encoded, null as empty."""

    def work(raw: bytes, texts: list[str | None]) -> list[pa.Array]:
        coder, _ = _machines(raw, pattern)
        return [_ids([coder.packed(t) for t in texts])]

    return _mapped(df, ranks_path, [id_col, text_col], carry, "ids array<int>", work)


def decode(df: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, decoded binary, decoded_text string) from token ids; null ids as none."""
    return _mapped(df, ranks_path, [id_col, ids_col], carry, "decoded binary, decoded_text string", lambda raw, ids: _decoded(held(("ids", hash(raw)), lambda: Decoder(parse_ranks(raw))), ids))


def encode_decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, ids, decoded_text): both directions in one pass, with one worker a task."""

    def work(raw: bytes, texts: list[str | None]) -> list[pa.Array]:
        coder, back = _machines(raw, pattern)
        ids = [coder.packed(t) for t in texts]
        return [_ids(ids), pa.array([back.text(memoryview(x).cast("i")) for x in ids], pa.string())]

    return _mapped(df, ranks_path, [id_col, text_col], carry, "ids array<int>, decoded_text string", work)
