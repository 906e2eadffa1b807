import random

import numpy as np
import pytest
import tiktoken
from vecloom.llm import bpe


@pytest.fixture(scope="module")
def encoder():
    return bpe.load()


@pytest.fixture(scope="module")
def theirs(encoder):
    return tiktoken.Encoding("own", pat_str=encoder.pattern, mergeable_ranks=encoder.ranks, special_tokens={})


def texts():
    rng = random.Random(3)
    out = ["", "a" * 3000, "ab" * 2000 + " " + "x" * 300, " \x1c\x85᠎​ a\x1cb  \x1f", "<|endoftext|> 123١ 'll've", "\U0001f600" * 90, "é" * 500]
    for _ in range(150):
        out.append("".join(chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(0x250, 0xD000), rng.randrange(0xE000, 0x1FFFF), 32, 10, 97])) for _ in range(rng.randrange(1, 120))))
    return out


def test_equals_the_library(encoder, theirs):
    for text, ids in zip(texts(), encoder.encode_batch(texts())):
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode_ordinary(text)
        assert encoder.decode(ids) == text.encode()


def test_all_ways_agree(encoder):
    encoder.encode_batch([""])
    rng = random.Random(4)
    pieces = [bytes(rng.choice(b"aeinrst .\xc3\xa9") for _ in range(rng.randrange(33, 64))) for _ in range(40)]
    assert encoder._stack(pieces, 64) == [encoder._alone(p) for p in pieces] == encoder._stack(pieces, 128)


def test_long_text_and_full_memo(encoder, theirs, monkeypatch):
    text = " ".join(texts())
    monkeypatch.setattr(bpe, "_LONG", 1000)
    monkeypatch.setattr(bpe, "MEMO", 50)
    assert np.frombuffer(encoder.encode_batch([None, text, "a b"])[1], "<u4").tolist() == theirs.encode_ordinary(text)


def test_round_trip(spark, encoder, theirs):
    rows = [(1, "Hello there", 5), (1, "Hello there", 5), (None, None, None), (4, "", 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = {(r.doc_id, r.n_tokens, bytes(r.decoded)) for r in bpe.round_trip(table, encoder=encoder).collect()}
    assert got == {(1, len(theirs.encode_ordinary("Hello there")), b"Hello there"), (None, 0, b""), (4, 0, b"")}
    assert bpe.round_trip(table.limit(0), encoder=encoder).count() == 0
