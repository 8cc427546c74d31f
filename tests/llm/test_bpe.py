import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken

from dispatchlens.llm import bpe
from dispatchlens.llm.pretokens import Memory, Pretokens, Table

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(bpe.read_ranks(PATH))


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def texts(n):
    rnd = random.Random(1)
    signs = "  \n\t'stremvldab.,!?123éÉ²½一あ\x1c\x85\xa0 ñ\x00''́😀"
    return ["", " ", "it's 'tis ''ve  x", "a" * 5000, *("".join(rnd.choices(signs, k=rnd.randint(0, 60))) for _ in range(n))]


def test_same_ids_as_the_library(coder, library):
    own = texts(3000)
    for text, ids in zip(own, coder.encode(own)):
        assert ids.tolist() == library.encode_ordinary(text), repr(text)
        assert coder.decode(ids) == text.encode()


def test_perfect_hash_is_minimal_and_finds_every_key():
    keys = [str(i).encode() for i in range(5000)]
    h = bpe.PerfectHash(keys)
    assert h.find(keys).tolist() == list(range(5000))
    assert sorted(h.key.tolist()) == list(range(5000))


def test_no_texts(coder):
    assert coder.encode([]) == []
    assert len(Pretokens(["", ""])) == 0 and len(Pretokens([])) == 0


def test_split_gives_the_patterns_matches():
    own = [*texts(3000), "a\u3000b", " \u2003 x", "'"]
    got, pattern = Pretokens(own), regex.compile(P.PATTERN)
    for i, t in enumerate(own):
        assert [got.piece(j).decode() for j in range(got.first[i], got.first[i + 1])] == pattern.findall(t), repr(t)


def test_table_finds_what_was_added_and_nothing_else():
    rnd = np.random.default_rng(1)
    lo, hi = rnd.integers(0, 50, 3000).astype(np.uint64), rnd.integers(1, 50, 3000).astype(np.uint64)
    keys = sorted(set(zip(lo.tolist(), hi.tolist())))
    lo, hi = np.array(keys, np.uint64).T
    table = Table(1000)
    table.add(lo[:600], hi[:600], np.arange(600))
    table.add(lo[600:1200], hi[600:1200], np.arange(600, 1200))  # only 400 of them fit
    assert table.find(lo, hi).tolist() == [i if i < 1000 else -1 for i in range(len(keys))]
    assert table.find(np.zeros(3, np.uint64), np.zeros(3, np.uint64)).tolist() == [-1] * 3


def test_memory_gives_the_same_numbers_through_many_generations():
    rnd = random.Random(4)
    number = lambda piece: [len(piece), *piece[:2]]
    memory, asked = Memory(entries=40), 0
    for _ in range(60):
        own = Pretokens([" ".join(str(int(rnd.expovariate(0.03))) for _ in range(rnd.randint(0, 80)))])

        def ask(some):
            nonlocal asked
            asked += len(some)
            return [number(own.piece(i)) for i in some.tolist()]

        flat, begin = memory.of(own.lo, own.hi, ask)
        assert [flat[a:b].tolist() for a, b in zip(begin, begin[1:])] == [number(own.piece(i)) for i in range(len(own))]
    assert 40 < asked < 2400


def test_operator(spark, documents, library):
    rows = [(1, None), (2, ""), (3, "Hello there"), (3, "Hello there"), (None, "x" * 3000)]
    out = bpe.encode_documents(documents(rows), PATH).collect()
    assert len(out) == 5
    for r in out:
        text = {3: "Hello there", None: "x" * 3000}.get(r.doc_id, "")
        assert r.n_tokens == len(library.encode_ordinary(text))
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_documents(documents(rows).limit(0), PATH).collect() == []
