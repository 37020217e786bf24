import functools
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kalendarium.llm import catalog, token_store
from kalendarium.llm.common import run_folder
from tests.llm.tables import documents, odd_rows, prose


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 10**12), max_size=300))
def test_elias_fano_round_trip(values):
    values = sorted(values)
    code = token_store.EliasFano.from_bytes(token_store.EliasFano.of(np.array(values, dtype=np.int64)).to_bytes())
    assert code.decode().tolist() == values
    for i in range(0, len(values), 7):
        assert code.select(i) == values[i]
    lo, hi = len(values) // 3, len(values) * 2 // 3
    assert code.decode(lo, hi).tolist() == values[lo:hi]


def test_offsets_take_near_minimal_space():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 600, 50_000))
    assert len(token_store.EliasFano.of(ends).to_bytes()) * 8 / len(ends) < 12.5  # 64 in a table of offsets


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(catalog.tokenizer_path())


def whole_ids(text):
    return tokenizer().encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", " ", "a", " a b", "a  b   c", "a\n b", "it's  'quoted' \n\n x", "w1*** w2%%% <|endoftext|> z", "é è ç̧ ŝ", "漢字 \U0001f600 x", "x\x1c y  z", "a\tb c\r\n d ", "don't can't I'll !!! ?? ...", "\n \nfoo \n bar"])
def test_words_are_cut_where_pieces_begin(text):
    encoder = token_store.Encoder(catalog.tokenizer_path())
    assert np.frombuffer(encoder.encode([text])[0], dtype=encoder.dtype).tolist() == whole_ids(text)


def test_random_texts_like_the_tokenizer():
    encoder, draw = token_store.Encoder(catalog.tokenizer_path()), random.Random(3)
    texts = ["".join(draw.choice("ab  éÄ'.,*1\n\t-s") for _ in range(draw.randrange(60))) for _ in range(400)]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, dtype=encoder.dtype).tolist() == whole_ids(text), repr(text)


def test_file_round_trip(spark, monkeypatch):
    given_rows = odd_rows()
    path = run_folder(spark, "t1")
    token_store.write_tokens(documents(spark, given_rows), path, catalog.tokenizer_path())
    back = token_store.read_tokens(spark, path, with_ids=True).orderBy("start").collect()
    assert [r["doc_id"] for r in back] == sorted((r[0] for r in given_rows), key=lambda d: (d is not None, d or 0))
    expected = sorted((r[0] or 0, r[0] is None, tuple(whole_ids(r[1] or "") + [2])) for r in given_rows)
    assert sorted((r["doc_id"] or 0, r["doc_id"] is None, tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in back) == expected
    at = 0
    for r in back:
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(r["ids"]) // 4, zlib.crc32(r["ids"]))
        at += r["n_tokens"]
    one = token_store.token_ids(spark, path, 9).collect()
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in one] == [whole_ids("one") + [2]]


def test_small_segments(monkeypatch):
    import pyarrow as pa
    from pyspark import TaskContext

    monkeypatch.setattr(token_store, "SEGMENT_TOKENS", 50)
    monkeypatch.setattr(token_store, "SEGMENT_DOCS", 3)
    monkeypatch.setattr(TaskContext, "get", staticmethod(lambda: type("T", (), {"partitionId": lambda self: 5})()))
    ids, texts = [None, 1, 1, 2, 1 << 62, (1 << 63) - 1, (1 << 63) - 1], [prose(i, n) for i, n in enumerate([3, 0, 200, 5, 5, 30, 1])]
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts)], ["doc_id", "text"])
    segments = pa.Table.from_batches(token_store._segments(catalog.tokenizer_path(), 2)([batch]))
    assert segments.column("segment").to_pylist() == list(range(segments.num_rows)) and segments.num_rows > 3
    back = pa.Table.from_batches(token_store._documents(True)(segments.to_batches()))
    assert back.column("doc_id").to_pylist() == ids
    assert [np.frombuffer(i, "<u4").tolist() for i in back.column("ids").to_pylist()] == [whole_ids(t) + [2] for t in texts]


def test_empty_table(spark):
    path = run_folder(spark, "t1")
    token_store.write_tokens(documents(spark, []), path, catalog.tokenizer_path())
    assert token_store.read_tokens(spark, path).collect() == []


def test_words_met_lately_are_not_learned_again():
    encoder = token_store.Encoder(catalog.tokenizer_path())
    text = "a text with Words, marks; and ümläut words again"
    first, asked = encoder.encode([text]), []
    encoder._learn = lambda missing: asked.append(missing) or {}
    encoder._remember = lambda words: asked.append(words)
    assert encoder.encode([text, text]) == first * 2 and asked == []
    encoder = token_store.Encoder(catalog.tokenizer_path())
    encoder.encode([text])
    encoder.words, encoder.older = {}, encoder.words
    assert encoder.encode([text]) == first and set(text.split(" ")[1:]) <= set(encoder.words)
    assert first == encoder.whole([text])


def test_new_words_reach_the_tokenizer_in_short_parts_and_texts_keep_their_order():
    encoder, draw, longest = token_store.Encoder(catalog.tokenizer_path()), random.Random(5), []

    class Asked:
        def encode_batch_fast(self, texts, **how):
            longest.append(max((t.count(" ") for t in texts), default=0))
            return tokenizer().encode_batch_fast(texts, **how)

        def __getattr__(self, name):
            return getattr(tokenizer(), name)

    encoder.tokenizer = Asked()
    # every third text has a blank after white space and is cut another way
    words = ["".join(draw.choices("abcdefg", k=9)) for _ in range(3000)]
    texts = [" ".join(words[at:at + 100]) + ("\n x" if at % 300 == 0 else "") for at in range(0, 3000, 100)]
    found = [np.frombuffer(ids, dtype=encoder.dtype).tolist() for ids in encoder.encode(texts)]
    assert max(longest) < 2 * token_store.PART  # a few words have blanks of their own
    assert found == [whole_ids(t) for t in texts]
