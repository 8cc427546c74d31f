import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from dispatchlens.llm import resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def grams(text, longest):
    words = WORD.findall(lower(text))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, longest, buckets, percent, least, seed=2024):
    """Per row (doc_id or None, n_features, weight, score), and the drawn rows' indices in order."""
    hashed = lambda g: zlib.crc32(g.encode()) % buckets
    own = [grams(t, longest) for _, t in rows]
    s, t = Counter(hashed(g) for _, gs in own for g in gs), Counter(hashed(g) for x in target for g in grams(x, longest)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for (i, _), (_, gs) in zip(rows, own):
        weight = sum(gain(hashed(g)) for g in gs) // len(gs) if gs else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(gs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    can = [j for j, (n, _) in enumerate(own) if n >= least]
    can.sort(key=lambda j: (-out[j][3], math.inf if out[j][0] is None else out[j][0]))
    return out, can[: percent * len(can) // 100]


def table(rnd, n):
    words = ["alpha", "Beta", "GAMMA", "éA", "x1", "日本", "--", "…", "d\x00d", "42", "\n\t"]
    text = lambda: rnd.choice([" ", "  ", "-", "_"]).join(rnd.choices(words, k=rnd.choice([0, 1, 5, 30, 60])))
    rows = [(i, text()) for i in range(n)]
    return [*rows, (None, None), (None, "word " * 50), (3, rows[3][1]), (3, rows[3][1]), (n, ""), (n + 1, "long wörd " * 30_000)]


@pytest.mark.parametrize("longest, percent, range_rows", [(1, 10, 1_000_000), (2, 50, 7), (3, 100, 10)])
def test_operator_against_brute_force(spark, documents, monkeypatch, longest, percent, range_rows):
    monkeypatch.setattr(resampling, "RANGE_ROWS", range_rows)
    rnd = random.Random(longest)
    rows = table(rnd, 80)
    target = [None, "", "alpha beta gamma", *("x1 42 " * k for k in range(5))]
    got = resampling.resample(documents(rows), spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string"), longest, 97, percent, 5).collect()
    want, drawn = brute(rows, target, longest, 97, percent, 5)
    null = lambda i: -1 if i is None else i
    assert sorted((null(r.doc_id), r.n_features, r.weight, r.score) for r in got) == sorted((null(i), *x) for i, *x in want)
    first = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in first] == list(range(1, len(drawn) + 1))
    assert [(r.doc_id, r.score) for r in first] == [(want[j][0], want[j][3]) for j in drawn]


def test_ties_go_to_the_smaller_id(spark, documents):
    rows = [(i, "same text here") for i in (5, 3, 9)] + [(4, "same text here")] * 3
    out = resampling.resample(documents(rows), spark.createDataFrame([("same",)], "text string"), 1, 10, 100, 1).collect()
    want, drawn = brute(rows, ["same"], 1, 10, 100, 1)
    assert [r.doc_id for r in sorted(out, key=lambda r: r["rank"])] == [want[j][0] for j in drawn]
    assert resampling.gains(*resampling.np.zeros((2, 4), int)).tolist() == [0] * 4


def test_overlapped_scan_gives_every_run_of_words():
    plain = b"A bb--CCC \xc3\xa9"
    per_n = [[m[0] for m in p.finditer(resampling.SEPARATORS.sub(b" ", plain.lower()), overlapped=True)] for p in resampling.patterns(3)]
    assert per_n == [[b"a", b"bb", b"ccc", b"\xc3\xa9"], [b"a bb", b"bb ccc", b"ccc \xc3\xa9"], [b"a bb ccc", b"bb ccc \xc3\xa9"]]


def test_empty_tables(spark, documents):
    target = spark.createDataFrame([], "text string")
    assert resampling.resample(documents([]), target).collect() == []
    got = resampling.resample(documents([(1, "a " * 30), (2, None)]), target, percent=50).collect()
    assert sorted((r.doc_id, r.n_features, r["rank"]) for r in got) == [(1, 30, None), (2, 0, None)]
