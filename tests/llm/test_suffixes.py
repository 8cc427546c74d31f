import hashlib
import random
from collections import Counter

import numpy as np

import corpus_pipeline
from dispatchlens.llm import common, queries, suffixes


def brute(texts, span):
    seen = Counter(t[i : i + span] for t in texts for i in range(len(t) - span + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - span + 1):
            if seen[t[i : i + span]] > 1:
                gone[i : i + span] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


def made(rnd, n):
    """Texts with shared passages of lengths around the span, a common passage, runs of one byte and copies."""
    word = lambda k: "".join(rnd.choices("abcdefghij é", k=k))
    common = word(500)
    out = []
    for _ in range(n):
        parts = [word(rnd.randint(0, 300))]
        for _ in range(rnd.randint(0, 3)):
            a = rnd.randint(0, 250)
            parts += [rnd.choice([common, common[a : a + rnd.randint(120, 210)], "z" * rnd.randint(100, 400)]), word(rnd.randint(0, 200))]
        out.append("".join(parts))
    return [*out, *out[:3], "", "short"]


def test_merge_gives_order_and_common_prefixes():
    rnd = random.Random(3)
    for _ in range(200):
        runs, every = [], []
        for _ in range(rnd.randint(1, 9)):
            own = sorted(bytes(rnd.choices(b"ab", k=rnd.randint(0, 40))) for _ in range(rnd.randint(0, 12)))
            runs.append(suffixes.front_coded(own) if own else ([], []))
            every += own
        found = list(suffixes.merge(runs))
        assert [x[2] for x in found] == sorted(every)
        for a, b in zip(found, found[1:]):
            n = 0
            while n < min(len(a[2]), len(b[2])) and a[2][n] == b[2][n]:
                n += 1
            assert b[3] == n


def test_every_window_has_one_anchor(monkeypatch):
    rnd = random.Random(6)
    monkeypatch.setattr(suffixes, "BLOCK", 700)
    for _ in range(10):
        data = bytes(rnd.choices(b"abc", k=rnd.randint(150, 3000)))
        found = suffixes.anchors(data, 150)
        assert [w for _, _, low, high in found for w in range(low, high + 1)] == list(range(len(data) - 149))
        assert all(high <= at <= low + 150 - suffixes.GRAM for _, at, low, high in found)


def test_many_suffixes_of_a_gram_as_pairs(monkeypatch):
    rnd = random.Random(8)
    for _ in range(60):
        rights = sorted(bytes(rnd.choices(b"ab", k=rnd.randint(2, 8))) for _ in range(rnd.randint(2, 10)))
        lefts = [bytes(rnd.choices(b"ab", k=rnd.randint(0, 6))) for _ in rights]
        many = [rnd.random() < 0.2 for _ in rights]
        prefix = [0, *(suffixes.shared(a, b, 0) for a, b in zip(rights, rights[1:]))]
        sets = []
        for pairs in (24, 0):
            monkeypatch.setattr(suffixes, "PAIRS", pairs)
            found = suffixes.repeats(lefts, list(map(len, rights)), prefix, many, 8)
            sets.append([{o for a, b in ranges for o in range(a, b + 1)} for ranges in found])
        assert sets[0] == sets[1]


def test_operator(documents, monkeypatch):
    texts = made(random.Random(7), 60)
    rows = [*enumerate(texts), (1, texts[1]), (None, None), (None, texts[5])]
    want = brute([(t or "").encode() for _, t in rows], 150)
    key = lambda i, x: (-1 if i is None else i, *x)
    for crowded in (10_000, 3):
        monkeypatch.setattr(suffixes, "CROWDED", crowded)
        out = suffixes.remove_repeats(documents(rows), 150).collect()
        assert sorted(key(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in out) == sorted(key(i, x) for (i, _), x in zip(rows, want))
    assert sum(x[1] for x in want) > 1000


def test_empty(documents):
    assert suffixes.remove_repeats(documents([])).collect() == []


def test_text_without_a_second_python_step(spark, documents, monkeypatch):
    """What is left is decoded where it is cut out: a task of op6_suffix_dedup or of the pipeline's stage runs one Python worker."""
    rnd = random.Random(9)
    passage = "".join(rnd.choices("abcdefghij ", k=200))
    # the first byte of é and è is the same and goes with the passage
    texts = [*made(rnd, 40), f"one {passage}é", f"two {passage}è"]
    path = common.scratch_path(spark, "suffixes-test")
    documents([*enumerate(texts), (None, None), (3, texts[3])]).write.parquet(f"{path}/documents.parquet")
    docs = common.table(spark, path, "documents")
    for out in (queries.op6_suffix_dedup(spark, path), corpus_pipeline.repeated_strings(spark, docs, path)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan
    # in slices of a few texts, with characters cut by the spans
    monkeypatch.setattr(suffixes, "RUN_BYTES", 900)
    monkeypatch.setattr(suffixes, "OUT_BYTES", 900)
    rows = suffixes.remove_repeats(docs, 150, ["doc_id", "lang"], ("text", "kept", "removed", "kept_sha256")).collect()
    want = {i: w[3] for i, w in enumerate(brute([t.encode() for t in [*texts, "", texts[3]]], 150)) if i < len(texts)}
    assert len(rows) == len(texts) + 2 and all(r.kept_sha256 == want[r.doc_id] and r.lang == "en" for r in rows if r.doc_id is not None)
    assert all(r.text == bytes(r.kept).decode("utf-8", "ignore") for r in rows)
    assert any(len(r.text.encode()) < len(r.kept) for r in rows) and any(r.removed for r in rows)
