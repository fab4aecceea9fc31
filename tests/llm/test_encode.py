import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kilnspark.llm import encode

JSON = os.path.join(encode.TOKENIZER_DIR, "byte_bpe_50k.json")
pytestmark = pytest.mark.skipif(not os.path.exists(JSON), reason="no vocabulary")
TEXTS = ["", "a" * 3000, "ab" * 999, "<|endoftext|>", " ​  x\n\n", "日本語 한국어 العربية", "!?" * 300 + " " * 77 + "z", "🚦👩‍🔬 é́"]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize("text", TEXTS)
def test_same_ids(reference, text):
    assert encode.load_encoder(JSON).encode(text) == reference(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(text):
    e = encode.load_encoder(JSON)
    raw, at = e.offsets()
    ids = np.array(e.encode(text), dtype=np.int64)
    assert encode.decode_ids(ids, np.frombuffer(raw, dtype=np.uint8), at).decode() == text


def test_ranks_alone_give_the_same():
    e = encode.load_encoder(JSON.replace(".json", ".tiktoken"))
    assert all(e.encode(t) == encode.load_encoder(JSON).encode(t) for t in TEXTS)


def test_frame(spark):
    df = spark.createDataFrame([(1, "ab cd", 5), (2, None, 6), (3, "", 7)], "doc_id long, text string, ids int")
    got = {r["doc_id"]: r["ids"] for r in encode.encode_corpus(df).collect()}
    assert got[2] == [] and got[3] == [] and len(got[1]) >= 2
    back = encode.decode_corpus(encode.encode_corpus(df)).collect()
    assert {r["doc_id"]: r["text"] for r in back} == {1: "ab cd", 2: "", 3: ""}


def test_long_words_are_not_kept(reference):
    e = encode.load_encoder(JSON)
    before = len(e.memo)
    text = "".join(chr(97 + k % 23) for k in range(5000))
    assert e.encode(text) == reference(text) and len(e.memo) == before
