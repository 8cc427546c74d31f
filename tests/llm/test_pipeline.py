import hashlib
import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from dispatchlens.llm import common

from test_simhash import brute_components, brute_fingerprint
from test_suffixes import brute


@pytest.fixture(scope="module")
def folder(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(2, 9)))
    shared = " ".join(word() for _ in range(120))
    good = [" ".join(word() for _ in range(rnd.randint(30, 200))) for _ in range(120)]
    good = [t + " " + shared if i % 7 == 0 else t for i, t in enumerate(good)] + good[:5]
    bad = [" ".join(w + "!!" for w in t.upper().split()) for t in good[:40]]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate([*good, *bad, "123 !!"])]
    path = common.scratch_path(spark, "pipeline-test")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 125)) for i in range(165)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return path, [t for _, t, *_ in rows]


def test_stages_against_brute_force(spark, folder):
    path, texts = folder
    docs = common.table(spark, path, "documents")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, path), "stage")
        assert docs.columns == columns and dict(docs.dtypes) == dict(common.table(spark, path, "documents").dtypes), name
        seen.append({r.doc_id: r for r in docs.collect()})
    assert set(seen[0]) >= set(range(125)) and len(set(seen[0]) & set(range(125, 165))) <= 2
    assert set(range(125)) <= set(seen[1])
    before = sorted(seen[1])
    roots = brute_components([brute_fingerprint(texts[i]) for i in before])
    assert sorted(seen[2]) == sorted({r: min(i for i, x in zip(before, roots) if x == r) for r in roots}.values())
    left = sorted(seen[2])
    want = brute([texts[i].encode() for i in left], 400)
    got = [hashlib.sha256(seen[3][i].text.encode()).hexdigest() for i in left]
    assert got == [w[3] for w in want] and any(w[1] for w in want)
    assert all(r.n_chars == len(r.text) for r in seen[3].values())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert sum(p.length for p in pieces) == sum(1 + len(library.encode(r.text, add_special_tokens=False).ids) for r in seen[3].values())
    assert sorted(corpus_pipeline.run(spark, path).drop("sequence_id", "offset").collect()) == sorted(tuple(p)[:5] for p in pieces)


def test_empty_tables(spark, folder):
    path = common.scratch_path(spark, "pipeline-test")
    for name in ("documents", "labels"):
        common.table(spark, folder[0], name).limit(0).write.parquet(f"{path}/{name}.parquet")
    assert corpus_pipeline.run(spark, path).collect() == []


CLASHING = "kept string, n_bytes string, n_removed int, n_spans long, kept_sha256 string, removed int, own_0 int, score string, accepted string, component_id string, fp string, salt string, text_ string"


def test_callers_columns_stay_as_they_are(spark, folder):
    """Columns with names that operators use themselves, null texts and ids, repeated rows: every stage passes them on unchanged."""
    path, texts = folder
    own = ("k", "b", 77, 78, "s", 79, 80, "x", "y", "z", "f", "t", "u")
    rows = [(i, t, "en", "s", len(t or ""), *own) for i, t in [*enumerate(texts[:60]), (None, texts[3] + " more"), (500, None), (500, None), (501, ""), (3, texts[3])]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING)
    names, kinds = docs.columns, docs.dtypes
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == names and out.dtypes == kinds, name
        got = out.collect()
        assert got and all(tuple(r)[5:] == own and r.lang == "en" and r.source == "s" for r in got), name
        if name != "suffix-array dedup":
            assert {(r.doc_id, r.text) for r in got} <= {(i, t) for i, t, *_ in rows}, name
        else:
            assert sorted(r.doc_id or -1 for r in got) == sorted(i or -1 for i, *_ in rows)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert sum(1 for r in pieces if r.doc_id == 500) == 2 and sum(1 for r in pieces if r.piece == 0) == len(rows)
