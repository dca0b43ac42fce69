import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from keyloom.llm import bpe, queries

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.parse_ranks(bpe.read_ranks(RANKS))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def hard_texts():
    r = random.Random(1)
    parts = ["a", "b", "e", "t", "th", "in", " ", "é", "ü", "中", "😀", "0", "!!", "\n", "ing", "er", "Ñ", "=", "---", "'s", "\t", "  ", "<|endoftext|>"]
    yield from ("", " ", "\n\n  \n", "a" * 5000, "ab" * 3000, "😀" * 400, "\x00\x01", "x" * 40 + "é" * 40)
    for _ in range(3000):
        yield "".join(r.choice(parts) for _ in range(r.randint(0, 30)))
    for _ in range(3000):
        yield " " + "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(0, 60)))
    for _ in range(2000):
        yield "".join(chr(r.choice([r.randint(32, 126), r.randint(0xA0, 0x24F), r.randint(0x4E00, 0x9FFF), r.randint(0x1F600, 0x1F64F)])) for _ in range(r.randint(0, 20)))


def test_encoding_equals_the_library(ranks, library):
    coder, back = bpe.Encoder(ranks, public_tokenizers.PATTERN), bpe.Decoder(ranks)
    for t in hard_texts():
        ids = coder.encode(t)
        assert ids == library.encode_ordinary(t), t[:60]
        assert back.decode(ids) == (t.encode(), t)


def test_small_tables_give_the_same(ranks, library):
    coder = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    coder.machine.max_states, coder.machine.max_pieces = 50, 20
    for t in list(hard_texts())[:1500]:
        assert coder.encode(t) == library.encode_ordinary(t)
    assert len(coder.machine.states) <= 51 and len(coder.machine.pieces) <= 20


def test_streamed_bytes_give_the_same_tokens_and_soon(ranks, library):
    machine = bpe.Transducer(ranks)
    piece = " thtionstinghathered"
    got = []
    for k, t in enumerate(machine.stream(piece.encode()[i : i + 1] for i in range(len(piece)))):
        got.append(t)
    assert got == library.encode_ordinary(piece)
    seen = [0]

    def bytes_in():
        for i in range(4000):
            seen[0] = i
            yield b"ab"

    first = next(machine.stream(bytes_in()))
    assert first >= 0 and seen[0] < 130  # bounded lookahead: output long before the end


def test_incremental_utf8_equals_decoding_at_once():
    r = random.Random(2)
    pool = "é😀中a߿ࠀ￿".encode()
    known = {}
    for _ in range(6000):
        raw = bytes(r.randrange(256) if r.random() < 0.3 else r.choice(pool) for _ in range(12))
        m = bpe.Utf8Machine(known)
        cut = sorted(r.sample(range(13), 3))
        parts = [raw[a:b] for a, b in zip([0, *cut], [*cut, 12])]
        assert "".join(m.feed(p) for p in parts) + m.close() == raw.decode("utf-8", "replace")


def test_every_two_bytes_and_every_character():
    for x in range(256):
        for y in range(256):
            m = bpe.Utf8Machine()
            assert m.feed(bytes([x])) + m.feed(bytes([y])) + m.close() == bytes([x, y]).decode("utf-8", "replace")
    for c in [*range(0, 0xD800, 7), *range(0xE000, 0x110000, 997), 0xFFFF, 0x10000, 0x10FFFF]:
        assert bpe.Utf8Machine.run(b"", chr(c).encode()) == (chr(c), b"")


def test_any_tokens_decode_as_their_bytes_do(ranks):
    r, back = random.Random(3), bpe.Decoder(ranks, chunk=7)
    odd = [i for t, i in ranks.items() if any(b >= 0x80 for b in t)]
    for _ in range(1500):  # tokens that cut characters, in orders that no text has
        ids = [r.choice(odd) if r.random() < 0.6 else r.randrange(len(ranks)) for _ in range(r.randint(0, 30))]
        raw = b"".join(back.token[i] for i in ids)
        assert back.decode(ids) == (raw, raw.decode("utf-8", "replace")) and back.text(ids) == raw.decode("utf-8", "replace")


def test_newer_letters_and_numbers_split_as_in_the_library(ranks, library):
    import re

    coder = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    newer = re.compile(f"[{bpe.NEWER_LETTERS}{bpe.NEWER_NUMBERS}]")
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and newer.match(chr(c))]
    assert len(points) > 17_000
    for c in [*points[::37], *points[:40], *range(0xA0, 0x3000, 3), *range(0x10000, 0x20000, 29)]:
        t = f"ab{chr(c)}c {chr(c)}{chr(c)} 1{chr(c)}2"
        assert coder.encode(t) == library.encode_ordinary(t), hex(c)


def test_query_digests(spark, sf, tmp_path, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()} | {10_001: None, 10_002: "", 10_003: "a\n" * 20_000}
    spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op1_byte_bpe(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id] or ""
        ids = library.encode_ordinary(t)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_operators_alone_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "hello there")], "doc_id long, text string")
    ids = bpe.encode(df, RANKS, public_tokenizers.PATTERN)
    assert bpe.decode(ids, RANKS).first().decoded_text == "hello there"
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), RANKS).first().decoded_text == ""
    assert bpe.encode(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    assert bpe.encode_decode(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    both = bpe.encode_decode(spark.createDataFrame([(1, "hello", 5), (1, "hello", 6)], "doc_id long, text string, decoded_text int"), RANKS, public_tokenizers.PATTERN)
    assert [tuple(r) for r in both.select("doc_id", "decoded_text").collect()] == [(1, "hello")] * 2
