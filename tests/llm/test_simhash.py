import random

import numpy as np
import xxhash

from dispatchlens.llm import simhash


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    g = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_every_pair_within_two_bits_shares_a_key():
    rnd = random.Random(2)
    for _ in range(500):
        a = b = rnd.getrandbits(64)
        for bit in rnd.sample(range(64), rnd.randint(0, 2)):
            b ^= 1 << bit
        at, keys = simhash.join_keys(np.array([a, b], np.uint64))
        assert set(keys[at == 0]) & set(keys[at == 1])
        assert len(keys) <= 36


def test_links_in_sparse_and_crowded_keys(spark, monkeypatch):
    rnd = random.Random(4)
    prints = set()
    for _ in range(12):
        seed = rnd.getrandbits(64)
        for _ in range(20):
            x = seed
            for bit in rnd.sample(range(64), rnd.randint(0, 4)):
                x ^= 1 << bit
            prints.add(x)
    prints = sorted(prints)
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "fp long")
    want = brute_components(prints)
    for paired in (64, 2):
        monkeypatch.setattr(simhash, "PAIRED", paired)
        found = simhash.common.components(simhash.links(frame), frame, "fp", "a", "b").collect()
        root = {r.fp % (1 << 64): r.root for r in found}
        groups, true = {}, {}
        for x, w in zip(prints, want):
            groups.setdefault(root[x], set()).add(x)
            true.setdefault(w, set()).add(x)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, true.values()))


def test_operator(documents):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(9, text), (4, text + " tail"), (5, "two words"), (6, "Two x  WORDS"), (7, None), (8, ""), (8, ""), (None, text), (3, "TWO words")]
    out = simhash.near_duplicates(documents(rows)).collect()
    want = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(want)
    first = {r: min((i for (i, _), x in zip(rows, roots) if x == r and i is not None), default=None) for r in roots}
    assert sorted((r.doc_id or -1, r.fp % (1 << 64), r.component_id) for r in out) == sorted((i or -1, f, first[x]) for (i, _), f, x in zip(rows, want, roots))
    kept = simhash.one_of_each(documents(rows))
    assert kept.columns == documents(rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({first[x] for x in roots})


def test_empty(documents):
    assert simhash.near_duplicates(documents([])).collect() == []
    assert simhash.one_of_each(documents([])).collect() == []
