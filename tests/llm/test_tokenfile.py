"""Files of token ids against the tokenizers library and an exact round trip."""

import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from vecloom.llm import queries, tokenfile


def _library():
    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return found


LIBRARY, WORDS = _library(), tokenfile.load()


@pytest.fixture(scope="module")
def library():
    return LIBRARY


@pytest.fixture(scope="module")
def words():
    return WORDS


ODD = [
    "", " ", "  ", "a  b", "a\n b", "a \nb ", " lead", "trail ", "trail\n", "\n\n x", "it's we'll  I'm", "x\x1c y \x1d", "!\x1c z", "  a b", "<|endoftext|> a <|endoftext|>",
    "é ü ß 漢字 カナ", "1 22 333 4444", "tab\tx \t y", "a  b", "🙂 🙂🙂", "a\u0085 b", "é ñ", "\ud800 x",
]


def test_words_equal_the_library_on_odd_texts(words, library):
    clean = [t.encode("utf-8", "replace").decode() for t in ODD]
    got = words.encode_batch([None, *ODD])
    assert got[0] == b"" and [np.frombuffer(g, "<u4").tolist() for g in got[1:]] == [library.encode(t, add_special_tokens=False).ids for t in clean]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sabz1! \x1c"), st.characters(exclude_categories=("Cs",))), max_size=30), max_size=8))
def test_words_equal_the_library(texts):
    assert [np.frombuffer(g, "<u4").tolist() for g in WORDS.encode_batch(texts)] == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_words_are_forgotten_and_learned_anew(words, library, monkeypatch):
    monkeypatch.setattr(tokenfile, "MEMO", 5)
    for t in ["one two three four five six seven", "a b c", "one two"]:
        assert np.frombuffer(words.encode_batch([t])[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(65_000, 66_000), st.integers(2**24 - 5, 2**24 + 5), st.integers(0, 2**32 - 1)), max_size=40))
def test_pack_round_trip(numbers):
    control, data = tokenfile.pack(np.array(numbers, "<u4"))
    assert len(control) == -(-len(numbers) // 4) and len(data) == sum(max(1, (n.bit_length() + 7) // 8) for n in numbers)
    assert tokenfile.unpack(control, data, len(numbers)).tolist() == numbers


def plain(rows, library):
    """(doc_id, start, n_tokens, crc) by a loop in the order of ids."""
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query_against_a_loop(spark, tmp_path, library):
    rng = random.Random(3)
    rows = [(i * 7 % 400 - 50, None if i % 50 == 0 else " ".join(rng.choice(ODD + ["the", "of", "and"]) for _ in range(rng.randrange(60))).replace("\ud800", "")) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_ranked_id_files(spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == sorted(plain(rows, library))


def test_files_are_blocks_in_order_ranked_by_frequency(spark, tmp_path, library):
    rows = [(i, f"the cat {i} and the dog " * (i % 9)) for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id int, text string")
    files = tokenfile.write(table, f"file://{tmp_path}/ids", block_ids=100)
    counts = np.zeros(50_257, int)
    for _, t in rows:
        np.add.at(counts, library.encode(t, add_special_tokens=False).ids + [2], 1)
    assert files.ranked.tolist() == sorted(range(50_257), key=lambda i: (-counts[i], i))
    names = sorted(n for n in os.listdir(tmp_path / "ids") if n != "ranked.ids")
    assert names and all(n.endswith(".ids") for n in names)  # no drafts, nothing under a passing name
    blocks = sorted(files.index.collect(), key=lambda r: (r.part, r.block))
    assert len(blocks) > 10 and blocks[0].start == 0
    assert [b.start for b in blocks[1:]] == list(np.cumsum([b.ids for b in blocks])[:-1])
    assert sum(os.path.getsize(tmp_path / "ids" / n) for n in names) == sum(b.size for b in blocks)
    back = {r.doc_id: r for r in tokenfile.read(files).collect()}
    assert {i: np.frombuffer(bytes(r.ids), "<u4").tolist() for i, r in back.items()} == {i: library.encode(t, add_special_tokens=False).ids + [2] for i, t in rows}
    assert tokenfile.read(files).schema["doc_id"].dataType.simpleString() == "int"


def test_nulls_repeats_long_texts_empty_and_clashing_columns(spark, library):
    long = "word " * 150_000
    rows = [(None, "b", 1, "x"), (None, None, 1, "x"), (1, "same", 1, "x"), (1, "same", 1, "x"), (1, "other", 1, "x"), (-5, long, 1, "x"), (7, "", 1, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, part int, ids string")
    got = sorted((tuple(r) for r in tokenfile.read(tokenfile.token_files(table, block_ids=1000)).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, None, -5, 1, 1, 1, 7]
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)]).tolist()[:-1]
    want = sorted(library.encode(t or "", add_special_tokens=False).ids + [2] for _, t, *_ in rows)
    assert sorted(np.frombuffer(bytes(r[3]), "<u4").tolist() for r in got) == want
    assert tokenfile.read(tokenfile.token_files(table.limit(0))).collect() == []


def test_a_coded_part_is_taken_as_it_is(tmp_path):
    """A task that runs again after its draft is gone finds the coded file."""
    folder = f"file://{tmp_path}"
    block = tokenfile._block(tokenfile.CODED, [3, None], np.array([2, 1]), *tokenfile.pack(np.array([5, 70_000, 1])))
    assert tokenfile._put(folder, "part-000000.ids", iter([block, block])) == [(0, len(block)), (len(block), len(block))]
    assert not tokenfile._exists(folder, "part-000000.draft")
    assert [h[2:] for h in tokenfile._heads(folder, "part-000000.ids")] == [(2, 3), (2, 3)]
    kind, ids, lengths, numbers = tokenfile._parse(tokenfile._get(folder, "part-000000.ids", len(block), len(block)))
    assert (kind, ids, lengths.tolist(), numbers.tolist()) == (tokenfile.CODED, [3, None], [2, 1], [5, 70_000, 1])


def test_any_other_tokenizer_gets_whole_texts(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    own, found = tokenfile.load(path), Tokenizer.from_file(path)
    found.encode_special_tokens = True
    texts = ["Hello  World", "a b", ""]
    assert [np.frombuffer(g, "<u4").tolist() for g in own.encode_batch(texts)] == [found.encode(t, add_special_tokens=False).ids for t in texts] and not own.by_word


def test_words_that_hold_spaces_end_where_the_library_ends_them():
    words = tokenfile.load()
    texts = ["a   b  c", "one\n two \t  three,\n\n four", "  x   y ", "plain words, and more"]
    whole = [np.array(e.ids, "<u4").tobytes() for e in (words._start() or words.library).encode_batch(texts, add_special_tokens=False)]
    assert words.encode_batch(texts) == whole
