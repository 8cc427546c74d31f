"""Operators without SQL against plain re-implementations of their methods: no arrays over texts, no counts instead of documents."""

import math
import random

import numpy as np

from dispatchlens.llm import language, packing, quality


def test_plan_on_counts_uses_as_many_sequences_as_best_fit_by_piece():
    rnd = random.Random(8)
    for _ in range(60):
        capacity = rnd.randint(5, 80)
        histogram = {rnd.randint(1, capacity): rnd.randint(1, 60) for _ in range(rnd.randint(1, 15))}
        rooms: list[int] = []
        for piece in sorted((n for n, times in histogram.items() for _ in range(times)), reverse=True):
            fits = [i for i, room in enumerate(rooms) if room >= piece]
            if fits:
                rooms[min(fits, key=lambda i: rooms[i])] -= piece
            else:
                rooms.append(capacity - piece)
        used = {seq + i // per for _, _, n, per, seq, _ in packing.best_fit_plan(histogram, capacity) for i in range(n)}
        assert len(used) == len(rooms), (capacity, histogram)


def test_ftrl_equals_updates_of_one_weight_at_a_time():
    rnd = random.Random(2)
    words = ["good", "text", "BAD", "bad", "!!", "and", "so", "on", "42"]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(0, 30))) for _ in range(40)] + ["", "good"]
    labels = [rnd.randint(0, 1) for _ in texts]
    rows = quality.features(texts)
    z: dict[int, float] = {}
    n: dict[int, float] = {}

    def weight(i):
        zi, ni = z.get(i, 0.0), n.get(i, 0.0)
        if abs(zi) <= quality.L1:
            return 0.0
        return (math.copysign(quality.L1, zi) - zi) / ((quality.BETA + math.sqrt(ni)) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for (index, value), label in zip(rows, labels):
            pairs = list(zip(index.tolist(), value.tolist()))
            now = {i: weight(i) for i, _ in pairs}
            p = 1 / (1 + math.exp(-sum(now[i] * v for i, v in pairs)))
            for i, v in pairs:
                g = (p - label) * v
                step = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / quality.ALPHA
                z[i] = z.get(i, 0.0) + g - step * now[i]
                n[i] = n.get(i, 0.0) + g * g
    learnt = quality.ftrl(rows, labels)
    assert np.flatnonzero(learnt).size > 5 and set(np.flatnonzero(learnt)) <= set(z)
    assert all(abs(learnt[i] - weight(i)) < 1e-9 for i in z)
    for text, score in zip(texts, quality.scores(texts, learnt)):
        (index, value), = quality.features([text])
        assert abs(score - 1 / (1 + math.exp(-sum(weight(i) * v for i, v in zip(index.tolist(), value.tolist()))))) < 1e-9


def test_nearest_centroid_equals_plain_cosines():
    rnd = random.Random(4)
    texts = ["hello there my friend", "Bonjour à tous", "wie geht es dir", "", "123", "ñandú", "x", "hello " * 500]
    idf = np.array([rnd.uniform(0.5, 3) for _ in range(language.DIMS)], np.float32)

    def vector(text):
        """TF-IDF by bin, one n-gram at a time."""
        b = [x + 1 for x in text.lower().encode()]
        found: dict[int, int] = {}
        for size in (1, 2, 3):
            for i in range(len(b) - size + 1):
                h = 0
                for x, factor in zip(b[i : i + size], language.FACTORS):
                    h = (h + x) * factor & 0xFFFFFFFF
                    h ^= h >> 15
                at = (h * language.FACTORS[0] & 0xFFFFFFFF) >> (32 - language.DIMS.bit_length() + 1)
                found[at] = found.get(at, 0) + 1
        own = {i: math.log1p(c) * float(idf[i]) for i, c in found.items()}
        length = math.sqrt(sum(v * v for v in own.values()))
        return {i: v / length for i, v in own.items()}

    langs = ["de", "en", "en", "fr"]
    train = [vector(t) for t in ("wie geht das denn", "hello friend", "my goodness there", "tous les jours bonjour")]
    centres = np.zeros((4, language.DIMS), np.float32)
    for row, own in zip(centres, train):
        for i, v in own.items():
            row[i] = v
    limits = np.array([0.2, 0.9, 0.1, 0.3])
    got = language.Centroids(idf, langs, centres, limits).predict(texts)
    for text, (lang, score, accepted) in zip(texts, got.itertuples(index=False), strict=True):
        if not any(c.isalpha() for c in text):
            assert (lang, score, accepted) == ("und", 0, False)
            continue
        own = vector(text)
        cosines = [sum(v * c.get(i, 0.0) for i, v in own.items()) for c in train]
        best = max(range(4), key=lambda i: cosines[i])
        assert lang == langs[best] and abs(score - cosines[best]) < 1e-5 and accepted == (cosines[best] >= limits[best])
