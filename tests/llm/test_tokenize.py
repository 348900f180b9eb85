import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.common import TOKENIZER_DIR
from tidemark.llm.tokenize import PATTERN, PerfectHash, encode_texts, encoder, merge_bytes, token_counts

tiktoken = pytest.importorskip("tiktoken")


def reference(name):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{TOKENIZER_DIR}/{name}.tiktoken", "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def known():
    return reference("byte_bpe_50k")


def test_perfect_hash_is_minimal_and_exact():
    items = {f"k{i}".encode(): i for i in range(5000)}
    h = PerfectHash(items)
    assert len(h.keys) == len(items) and None not in h.keys
    assert all(h.get(k) == v for k, v in items.items()) and h.get(b"other") is None and h.get(b"") is None
    assert PerfectHash({b"a": 7}).get(b"a") == 7


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    e, r = encoder("byte_bpe_50k"), reference_cached()
    assert e.encode(text) == r.encode_ordinary(text)


_R = []


def reference_cached():
    if not _R:
        _R.append(reference("byte_bpe_50k"))
    return _R[0]


@pytest.mark.parametrize("text", ["a" * 20_000, "<|endoftext|>", "ab" * 5000 + "é", " \t\n\x00\x1f  ", "日本語 Привет 😀👩‍💻", "it's they're 12345 x"])
def test_edges(known, text):
    assert encoder("byte_bpe_50k").encode(text) == known.encode_ordinary(text)
    assert encoder("byte_bpe_50k").count(text) == len(known.encode_ordinary(text))


def test_merge_without_ranks():
    assert merge_bytes(b"ab", {b"a": 1, b"b": 2}.get) == [1, 2]


def test_other_vocabularies():
    for name in ("byte_bpe_multi_50k", "word_bpe_49k", "piece_bpe_32k"):
        assert encoder(name).count("Das ist ein Text.") > 0 and encoder(name).count("") == 0 == encoder(name).count(None)
    with pytest.raises(ValueError):
        encoder("none")


def test_frame(spark):
    df = spark.createDataFrame([(1, "Das ist", 5), (1, "Das ist", 6), (2, None, 0), (3, "", 0), (None, " ", 0), (4, "x" * 50_000, 1)], "doc_id long, text string, ids int")
    out = [(r.doc_id, r.ids) for r in encode_texts(df).collect()]
    assert len(out) == 6 and dict(out)[2] == [] == dict(out)[3] and sum(1 for k, _ in out if k == 1) == 2 and dict(out)[None] != []
    assert encode_texts(df.limit(0)).collect() == []
    n = {(r.doc_id, r.tokenizer): r.n_tokens for r in token_counts(df, ["byte_bpe_50k", "byte_bpe_multi_50k"]).collect()}
    assert n[2, "byte_bpe_50k"] == 0 and n[1, "byte_bpe_50k"] == len(dict(out)[1])


def test_whole_table(spark, data, known):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.ids for r in encode_texts(docs).collect()}
    assert got == {k: known.encode_ordinary(t) if t else [] for k, t in texts.items()}
