"""The codec against the library, on texts that try its cuts and on the cases that its docstring defines."""

import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evalloom.llm import bpe_codec, registry

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(text):
    raw = bpe_codec.encoder(PATH).ids(text)
    return list(memoryview(raw).cast("i"))


ODD = [
    "", " \t\r\n", "Hello  world's <|EndOfText|> x<|endoftext|>y <|startoftext|>", "don't I'LL 'S ''s'ss it's", "a" * 5000, "é" * 300 + "語" * 50,
    "ÜNÏ ΑΣ İ 12 á Å ﬁ ǅ ẛ̣", "a<|startoftext|>́b ́c", "one\x1ctwo\x1fthree\x7f\x85four five᠎six​seven\x00",
]


@pytest.mark.parametrize("text", ODD)
def test_encodes_as_the_library(library, text):
    assert ids(text) == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcABC'sdlrtvem019 .,!<|>/wé́각あ漢\U0001f600İΣ  \t\n\x1d", max_size=60) | st.text(max_size=40).filter(lambda s: s.isprintable()))
def test_encodes_any_text(text):
    assert ids(text) == bpe_codec.encoder(PATH).library.encode(text, add_special_tokens=False).ids


def test_cuts_are_certain_and_made():
    merges = bpe_codec.encoder(PATH).merges
    cut = merges.cut("qxzjqvword")
    assert len(cut) > 1 and "".join(cut) == "qxzjqvword "
    for token in list(merges.vocab)[::37]:
        plain = token.removesuffix("</w>") if len(token) > 4 else token
        if token.endswith("</w>") and len(token) > 4:
            assert merges.cut(plain) == [plain + " "]


def test_forgetting_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(bpe_codec, "CACHE", 3)
    own = bpe_codec.Encoder(PATH)
    for text in ["one two three four five six one two", "one two seven eight one nine"] * 3:
        assert list(memoryview(own.ids(text)).cast("i")) == library.encode(text, add_special_tokens=False).ids


def test_query_on_a_table(spark, library):
    got = {r["doc_id"]: r for r in registry.QUERIES["op13_bpe_codec"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        k = library.encode(d["text"] or "", add_special_tokens=False).ids
        said = library.decode(k, skip_special_tokens=False)
        r = got[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(k), hashlib.sha256(" ".join(map(str, k)).encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest())


def test_defined_cases(spark, library):
    rows = [(1, None, "x"), (2, "", None), (2, "", None), (None, "Word words", "y"), (3, "long " * 40_000 + "tail", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded0 string")
    out = bpe_codec.decode_ids(bpe_codec.encode_texts(df, PATH), PATH)
    assert out.columns == ["doc_id", "text", "decoded0", "ids", "decoded"]
    for r in out.collect():
        k = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == k and r["decoded"] == library.decode(k, skip_special_tokens=False)
    assert bpe_codec.encode_texts(df.limit(0), PATH).collect() == []
    lists = spark.createDataFrame([(1, None), (2, []), (3, [0, 10**6, None, -1, 49407, 1])], "k long, ids array<int>")
    assert {r["k"]: r["decoded"] for r in bpe_codec.decode_ids(lists, PATH).collect()} == {1: "", 2: "", 3: library.decode([0, 49407, 1], skip_special_tokens=False)}
    assert bpe_codec.decode_ids(lists, PATH).where(F.col("ids").isNull()).count() == 1
