import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from dispatchlens.llm import pretokens, tokencounts

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(n):
    rnd = random.Random(6)
    words = ["alpha", " the", "über", "42", "\n", "x!", "'s", "qzxv", "日本語", "<|endoftext|>", "internationalisation", "  ", "a" * 40]
    return ["", "<|endoftext|>", " ", "é" * 500, *("".join(rnd.choices(words, k=rnd.randint(0, 200))) for _ in range(n))]


@pytest.mark.parametrize("sample_rows, frequent", [(4000, 1 << 16), (20, 3), (0, 10)])
def test_operator_against_the_library(documents, library, sample_rows, frequent):
    own = texts(60)
    rows = [(1, None), (1, None), (None, "hello"), (None, "hello"), (7, "word " * 40_000), *enumerate(own)]
    got = tokencounts.token_counts(documents(rows), PATH, 100, sample_rows, frequent).collect()
    size = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    want = [(i or -1, len((t or "").encode()), size(t), size(t) > 100) for i, t in rows]
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted(want)


def test_frequent_table_holds_the_most_frequent(library):
    batch = pa.RecordBatch.from_arrays([pa.array(["zz " * 9 + "qqqq " * 5, " zz qqqq" * 3, "rare", "x" * 16])], ["text"])
    lengths = tokencounts.Lengths(open(PATH, "rb").read(), False)
    table = lengths.learn_frequent([batch, batch], 2)
    lo, hi = pretokens.keys_of([b" zz", b" qqqq", b"rare", b"x" * 16])
    size = [len(library.encode(t).ids) for t in (" zz", " qqqq")]
    assert table.find(lo, hi).tolist() == [*size, -1, -1] and table.n == 2


def test_wrong_pre_tokens_never_count(library):
    """The memory is asked by all bytes of a pre-token: a table with other pre-tokens changes nothing."""
    lengths = tokencounts.Lengths(open(PATH, "rb").read(), False)
    lo, hi = pretokens.keys_of([b"alpho", b"alph", b"alpha\x01"])
    lengths.frequent = pretokens.Table(3, np.uint8)
    lengths.frequent.add(lo, hi, np.array([9, 9, 9], np.uint8))
    assert lengths.of(["alpha", "alpha alpha"]).tolist() == [len(library.encode(t).ids) for t in ("alpha", "alpha alpha")]


def test_other_tokenizers(documents):
    own = texts(20)
    for name in ("piece_bpe_32k.model", "word_bpe_49k.json"):
        got = {r.doc_id: r.n_tokens for r in tokencounts.token_counts(documents(list(enumerate(own))), P.path(name)).collect()}
        if name.endswith(".model"):
            want = [len(SentencePieceProcessor(model_file=P.path(name)).encode(t)) for t in own]
        else:
            want = [len(Tokenizer.from_file(P.path(name)).encode(t, add_special_tokens=False).ids) for t in own]
        assert [got[i] for i in range(len(own))] == want


def test_empty(documents):
    assert tokencounts.token_counts(documents([]), PATH).collect() == []
