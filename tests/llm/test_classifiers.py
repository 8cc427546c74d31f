import base64
import random
import zlib

import numpy as np
import pytest

from dispatchlens.llm import language, quality

WORDS = {"en": "the of and to in that with from house river".split(), "de": "der die und ein nicht mit für über straße fluß".split()}


def prose(rnd, lang="en", n=60):
    return " ".join(rnd.choices(WORDS[lang], k=n)).capitalize() + "."


def junk(rnd):
    return rnd.choice([" ".join(w + "!!" for w in prose(rnd).upper().split()), " ".join([rnd.choice(WORDS["en"])] * 50), " | ".join(rnd.choices(WORDS["de"], k=40))])


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(1)
    good = [(i, prose(rnd, rnd.choice(["en", "de"]))) for i in range(300)]
    return good + [(i, junk(rnd)) for i in range(300, 400)]


def odd():
    return [(None, "the river"), (500, None), (501, ""), (502, "12345 !!"), (0, "the house"), (503, "x" * 50_000)]


def test_quality(spark, documents, rows):
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(400)] + [(None, 1, 0), (3, None, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality.quality_scores(documents(rows + odd()), labels).collect()
    assert len(out) == len(rows) + len(odd())
    held = [r for r in out if r.doc_id is not None and r.doc_id < 400 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out if r.doc_id is not None)
    assert np.mean([r.predicted == (r.doc_id < 300) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    bias = {r.score for r in out if r.doc_id in (500, 501)}
    assert len(bias) == 1
    kept = quality.keep_good(documents(rows), labels)
    assert kept.columns == documents(rows).columns
    assert 290 <= kept.count() <= 310


def test_quality_is_the_same_again(spark, documents, rows):
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(400)], "doc_id long, quality int")
    once, again = (sorted(quality.quality_scores(documents(rows).repartition(n), labels).collect()) for n in (1, 3))
    assert once == again


def test_quality_without_labels(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [(r.score, r.predicted) for r in quality.quality_scores(documents([(1, "x")]), labels).collect()] == [(0.5, 1)]
    assert quality.quality_scores(documents([]), labels).collect() == []


def test_features_are_normalised_sparse_counts():
    (index, value), (none, bias) = quality.features(["a b a b B c", ""])
    assert len(set(index.tolist())) == len(index) and index[-1] == 0 and value[-1] == 1
    assert abs(np.sqrt((value[:-1] ** 2).sum()) - quality.LENGTH) < 1e-9
    assert none.tolist() == [0] and bias.tolist() == [1.0]
    apart = [quality.features([t])[0] for t in ("x y", "y z")]
    together = quality.features(["x y", "y z"])
    assert all((a[0] == b[0]).all() for a, b in zip(apart, together))


def languages(spark, rows):
    rnd = random.Random(2)
    lang = {i: "de" if any(w in t.split() for w in ("und", "der", "die")) else "en" for i, t in rows}
    extra = [(600 + i, prose(rnd, "en"), "en") for i in range(80)] + [(700 + i, prose(rnd, "de"), "de") for i in range(80)] + [(800, prose(rnd), None)]
    return extra, spark.createDataFrame([(i, t, g, "s", 1.0) for i, t, g in extra] + [(i, t, None, "s", 1.0) for i, t in odd()], "doc_id long, text string, lang string, accepted string, score double"), lang


def test_language(spark, rows):
    extra, frame, _ = languages(spark, rows)
    out = language.predicted_languages(frame).collect()
    assert len(out) == len(extra) + len(odd())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out if r.doc_id is not None)
    told = {r.doc_id: r for r in out}
    assert np.mean([told[i].lang_pred == g for i, _, g in extra if g]) > 0.97
    assert all(told[i].lang_pred == "und" and told[i].score == 0 and not told[i].accepted for i in (500, 501, 502))
    assert all(0 <= r.score <= 1 and r.lang_pred in ("en", "de", "und") for r in out)
    kept = language.keep_told(frame)
    assert kept.columns == frame.columns
    assert {500, 501, 502}.isdisjoint(r.doc_id for r in kept.collect())
    assert {i for i, _, _ in extra} <= {r.doc_id for r in kept.collect()}


def test_language_rejects_what_is_far(spark, rows):
    _, frame, _ = languages(spark, rows)
    model = language.fit(frame)
    out = model.predict(["the house of the river and that", "漢字仮名交じり文です", "zq"])
    assert out["accepted"].tolist()[0]
    assert out["score"][0] > 5 * out["score"][1]


def test_language_with_nothing_learnt(documents):
    out = language.predicted_languages(documents([]).select("doc_id", "text", "lang"))
    assert out.collect() == []
    rows = documents([(1, "hello")]).selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert [(r.lang_pred, r.score) for r in language.predicted_languages(rows).collect()] == [("und", 0.0)]


def test_language_limit_separates(spark):
    rnd = random.Random(4)
    parts = {"en": "th the er on an re he in ed nd ha at en es of or".split(), "de": "en er ch de ei ie in te ge un nd st be sch ü ß".split()}
    word = lambda g: "".join(rnd.choices(parts[g], k=rnd.randint(1, 4)))
    text = lambda g, n: " ".join(word(g) for _ in range(n)) + "."
    # every language has one document unlike its others, which becomes a centroid with one member
    rows = [(i, text(g, rnd.randint(20, 90)), g) for i, g in enumerate(["en", "de"] * 90)] + [(1000, "QQQQ " * 30, "en"), (1003, "%% JJ " * 30, "de")]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    kept = [t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(kept) > 20 and model.predict(kept)["accepted"].all()
    letters = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=600))
    packed = base64.b64encode(rnd.randbytes(600)).decode()
    numbers = "a " + " ".join(str(rnd.randint(0, 10**6)) for _ in range(100))
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem."
    far = [letters, packed, numbers, polish, rnd.randbytes(400).hex(), "漢字仮名交じり文です", "يولد جميع الناس أحرارا متساوين"]
    assert not model.predict(far)["accepted"].any()


def test_language_limit_of_few_members():
    rng = np.random.default_rng(2)
    near = np.abs(rng.standard_normal((60, 40))) + 1
    far = np.eye(40)[:2]  # two of one member each
    x = np.concatenate([near, far])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres, limits = language.clustered(x, 3)
    assert max(limits) < language.SLACK * 0.99 and not np.isnan(limits).any()
    assert np.isnan(language.clustered(x[-2:], 3)[1]).all()


def test_language_counts_documents_of_all_rows(spark):
    rnd = random.Random(5)
    rows = [(i, prose(rnd, g, 20), g) for i, g in enumerate(["en", "en", "en", "de"] * 50)] + [(900, "12345 !!", "en"), (901, None, "de"), (902, "the", None)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), fit_rows=10)
    learnt = [t for i, t, g in rows if g and t and language.has_letter(t) and zlib.crc32(str(i).encode()) % 4 != 2]
    df = sum((language.counts(t) > 0).astype(int) for t in learnt)
    assert np.allclose(model.idf, 1 + np.log((1 + len(learnt)) / (1 + df)))
