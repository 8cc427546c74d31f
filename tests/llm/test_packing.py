import random
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from dispatchlens.llm import packing

PATH = P.path("byte_bpe_50k.json")


def check_places(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_plan_places_every_piece_once_and_is_dense():
    rnd = random.Random(5)
    for _ in range(50):
        capacity = rnd.randint(4, 60)
        hist = {rnd.randint(1, capacity): rnd.randint(1, 400) for _ in range(rnd.randint(0, 12))}
        room, ranks = {}, {}
        for length, rank, n, per, seq, offset in packing.best_fit_plan(hist, capacity):
            assert rank == ranks.get(length, 0)
            ranks[length] = rank + n
            for i in range(n):
                s = seq + i // per
                assert room.setdefault(s, 0) == offset + i % per * length
                room[s] += length
        assert ranks == hist and all(v <= capacity for v in room.values())
        # best-fit decreasing needs at most 11/9 of the best and one more
        assert len(room) <= 11 / 9 * max(1, -(-sum(k * v for k, v in hist.items()) // capacity)) * 1.5 + 1


def test_ids_are_the_librarys(documents):
    library = Tokenizer.from_file(PATH)
    own = packing.Ids(open(PATH, encoding="utf-8").read())
    for texts in ([], ["", "it's  a\n\n test<|endoftext|> x", "<|endoftext|>", "é" * 300, " 'll  \t\n"]):
        assert [x.tolist() for x in own.of(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_operator_against_the_library(documents):
    rnd = random.Random(2)
    words = ["alpha", "beta", "über", "42", "\n", "x!"]
    rows = [(1, None), (1, None), (2, ""), (None, "hello"), *((i, " ".join(rnd.choices(words, k=rnd.choice([3, 30, 300, 900])))) for i in range(3, 40))]
    out = packing.pack_documents(documents(rows), PATH, capacity=256).collect()
    library = Tokenizer.from_file(PATH)
    want = []
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        cut = [0, *range((len(ids) - 1) % 256 + 1, len(ids) + 1, 256)]
        want += [(i or -1, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for p, (a, b) in enumerate(zip(cut, cut[1:]))]
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    sequences = check_places(out, 256)
    assert sequences <= 1.1 * sum(r.length for r in out) / 256 + 1


def test_empty(documents):
    assert packing.pack_documents(documents([]), PATH).collect() == []
