import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dispatchlens.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "text string, lang string, source string, doc_id long, n long, term string, part int, value double, block string"


def brute(rows, least, top):
    rows = [(t or "", a or "", s or "") for t, a, s in rows]
    terms = [TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)) for t, _, _ in rows]
    out = []
    for lang in {a for _, a, _ in rows}:
        docs = Counter(w for ws, (_, a, _) in zip(terms, rows) if a == lang for w in set(ws))
        kept = sorted((w for w, n in docs.items() if n >= least), key=str.encode)

        def shares(own):
            count = Counter(w for ws in own for w in ws if docs[w] >= least)
            return count, {w: 1 + 10**9 * (count[w] + 5) // (count.total() + 5 * len(kept)) for w in kept}

        _, q = shares(ws for ws, (_, a, _) in zip(terms, rows) if a == lang)
        groups = {g: shares(ws for ws, (_, a, s) in zip(terms, rows) if (a, s) == (lang, g)) for g in {s for _, a, s in rows if a == lang}}
        for g, (count, p) in groups.items():
            pairs = [(sum(abs(p[w] - groups[o][1][w]) for w in kept), o) for o in groups if o != g]
            marked = [(p[w] - q[w], w) for w in kept if count[w] and p[w] > q[w]]
            for part, found in (("pair", pairs), ("term", marked)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, g, part, item, v, i + 1) for i, (v, item) in enumerate(found[: None if part == "pair" else top])]
    return sorted(out)


def table(rnd, n):
    words = ["alpha", "Beta", "BETA", "éa", "日本", "x", "it's", "42", "z" * 300, "\x00", "ÉA", *(f"w{chr(97 + i)}" for i in range(20))]
    text = lambda k: " ".join(rnd.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=k))
    langs, sources = ["en", "en", "de", None, ""], ["a", "a", "a", "b", "c", "d", "é", None, "", "~"]
    rows = [(text(rnd.choice([0, 3, 10, 40])), rnd.choice(langs), rnd.choice(sources)) for _ in range(n)]
    lone = [("only here", "xx", "p"), ("other words", "xx", "q"), (None, "xx", None), ("one source", "yy", "s"), ("x " * 50_000, "en", "long"), ("42 --", "en", "wordless")]
    return rows + rows[:30] + lone


@pytest.mark.parametrize("blocks, counted", [((32, 1 << 15), 300_000), ((2, 3), 10), ((1, 1), 1), ((3, 7), 50)])
def test_cube_against_brute_force(spark, monkeypatch, blocks, counted):
    monkeypatch.setattr(divergence, "COUNTED", counted)
    rows = table(random.Random(3), 200)
    docs = spark.createDataFrame([(*r, 1, 2, "t", 3, 4.0, "b") for r in rows], SCHEMA)
    got = divergence.audit(docs, 8, 5, *blocks)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    want = brute(rows, 8, 5)
    assert sorted(map(tuple, got.collect())) == want
    assert {x[0] for x in want} == {"", "de", "en", "xx"} and any(x[0] == "xx" and x[4] == 0 for x in want)


def test_term_blocks_add_up_whatever_the_order_of_rows(spark):
    """Without coalesced partitions and broadcasts a cell's rows come in an order of their own for each term block."""
    shuffled = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in shuffled}
    rows = table(random.Random(3), 200)
    try:
        for k, v in shuffled.items():
            spark.conf.set(k, v)
        got = divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string"), 8, 5, 32, 3).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, got)) == brute(rows, 8, 5)


def test_shares_are_exact_beyond_64_bits(spark):
    n, all_n, terms = 9 * 10**15 + 7, 10**17 + 11, 10**9 + 1
    row = spark.createDataFrame([(n, all_n, terms)], "n long, all_n long, terms long").select(divergence.share(F.col("n"), F.col("all_n"), F.col("terms")).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 5) // (all_n + 5 * terms)


def test_empty_and_wordless(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert divergence.audit(empty).collect() == []
    docs = spark.createDataFrame([(None, None, None), (None, None, "s")], "text string, lang string, source string")
    assert sorted(map(tuple, divergence.audit(docs).collect())) == [("", "", "pair", "s", 0, 1), ("", "s", "pair", "", 0, 1)]
