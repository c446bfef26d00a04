import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from dialectic.llm import bpe
from tests.llm.helpers import docs, rows

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(codec, texts):
    return [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)]


def test_every_character_as_the_library(library):
    codec = bpe.ByteBpe(PATH)
    texts = [f"a{chr(c)}{chr(c)}b1 {chr(c)} '" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 7 == 0)]
    assert ids_of(codec, texts) == library.encode_ordinary_batch(texts)


def test_random_and_long_texts_as_the_library(library):
    rnd, codec = random.Random(5), bpe.ByteBpe(PATH)
    tokens = list(codec.ranks)
    texts = [b"".join(rnd.choice(tokens) for _ in range(rnd.randint(0, 30))).decode("utf-8", "ignore") for _ in range(3000)]
    texts += ["a" * 100_000, "ab" * 60_000, "=-" * 20_000, " " * 900, "é" * 5000, "<|endoftext|>", UNKNOWN_TEXT]
    assert ids_of(codec, texts) == library.encode_ordinary_batch(texts)
    for t, x in zip(texts, codec.encode(texts)):
        assert codec.decode(x).decode() == t


UNKNOWN_TEXT = bpe.UNKNOWN + " ▁ <unk> \x00"


def test_whole_matches_come_before_merges(tmp_path):
    """``abcd`` is a token that no chain of merges gives; ``bc`` merges first."""
    tokens = [bytes([b]) for b in range(256)] + [b"bc", b"ab", b"cd", b"abcd"]
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    codec = bpe.ByteBpe(str(path))
    own = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(str(path)), special_tokens={})
    texts = ["abcd", "abcdab", "abab abcd", "aabcd"]
    assert ids_of(codec, texts) == own.encode_ordinary_batch(texts)
    assert ids_of(codec, ["abcd"]) == [[259]]
    path.write_bytes(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(ValueError):
        bpe.ByteBpe(str(path))


def test_memo_starts_anew(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_CHARACTERS", 10)
    codec, texts = bpe.ByteBpe(PATH), ["one two three", "two four", "", "one"] * 3
    assert [ids_of(codec, [t])[0] for t in texts] == library.encode_ordinary_batch(texts)
    assert len(codec._memo) < 6


def test_rows_in_rows_out(spark, library):
    texts = [None, "", "Hello, world", "Hello, world", "x" * 30_000, "日本語 and é\r\n\t "]
    d = docs(spark, texts, ids=[4, None, 2, 2, 1, None]).selectExpr("*", "text as ids", "1 as n_tokens", "lang as data")
    want = sorted(((i or -1), library.encode_ordinary(t or "")) for i, t in zip([4, None, 2, 2, 1, None], texts))
    encoded = bpe.encode_texts(d, PATH)
    assert sorted((i or -1, x) for i, x in rows(encoded)) == want
    assert sorted((i or -1, bytes(x).decode()) for i, x in rows(bpe.decode_ids(encoded, PATH))) == sorted(
        ((i or -1), t or "") for i, t in zip([4, None, 2, 2, 1, None], texts))
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert sorted((i or -1, n, a, b) for i, n, a, b in rows(bpe.round_trip(d, PATH))) == sorted(
        (i, len(x), sha(np.array(x, "<u4").tobytes()), sha(library.decode_bytes(x))) for i, x in want)
    assert rows(bpe.round_trip(docs(spark, []), PATH)) == [] == rows(bpe.decode_ids(bpe.encode_texts(docs(spark, []), PATH), PATH))


def test_query_as_the_library(spark, library):
    from dialectic.llm.queries import op12_byte_bpe
    sf = "/root/testdata/sf0.001"
    got = {r[0]: tuple(r)[1:] for r in op12_byte_bpe(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = np.array(library.encode_ordinary(r.text or ""), "<u4")
        assert got.pop(r.doc_id) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(),
                                     hashlib.sha256((r.text or "").encode()).hexdigest())
    assert not got
