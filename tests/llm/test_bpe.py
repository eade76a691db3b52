import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kinweave.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
HARD = ["", "a", "a" * 1001, "   x  ", "end\n\n\n  ", "<|endoftext|>a<|endoftext|> <|endoftext", "日本語 123 ½²", "é̀ 🙂🙂", "'s't're I'll", " " * 500 + "b", "ab" * 3000, "x\x1c\x1d y", "Ᲊ ՘"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return bpe.ByteBPE(PATH)


def test_like_the_library(library, encoder):
    rng = random.Random(2)
    texts = HARD + ["".join(rng.choice("ab '\n.1é日 ") for _ in range(rng.randint(1, 200))) for _ in range(200)]
    for text, ids in zip(texts, encoder.encode_batch(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert encoder.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False) == text


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(text):
    encoder = test_round_trip.__dict__.setdefault("encoder", bpe.ByteBPE(PATH))
    assert encoder.decode(encoder.encode_batch([text])[0]) == text


def test_pieces_change_nothing(library, encoder, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE_CHARS", 50)
    text = "The quick  brown fox\n\n jumps over 12 dogs. " * 40
    assert encoder.encode_batch([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_bytes_that_are_no_text(encoder):
    assert encoder.decode(np.array([encoder.byte_id[0xE2]])) == "�"


def test_query_columns(docs, library):
    rows = [(1, "Hello world"), (2, None), (3, ""), (4, "word " * 20_000), (4, "word " * 20_000), (5, "<|endoftext|>")]
    out = {(r["doc_id"], r["n_tokens"]): r for r in bpe.encode(docs(rows), PATH, digests=True, with_text=True, carry=("lang", "id")).collect()}
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        r = out[i, len(ids)]
        assert r["ids"] == ids and r["decoded"] == (text or "") and r["lang"] == "en" and r["id"] == "x"
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_empty_table(docs):
    assert bpe.encode(docs([]), PATH, digests=True).count() == 0
