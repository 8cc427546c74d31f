import base64
import gzip
import hashlib
import random

import pytest

from dispatchlens.llm import common, warc

SCHEMA = "page_id long, url string, html string, payload string, same string"


@pytest.fixture
def pages(spark):
    def make(rows):
        return spark.createDataFrame([(i, u, h, "p", "s") for i, u, h in rows], SCHEMA)

    return make


def rows():
    rnd = random.Random(1)
    own = [(i, f"http://h/{i}", rnd.choice(["same", "two\r\n\r\nparts", "é" * rnd.randint(0, 9), None, ""])) for i in range(60)]
    return [*own, (100, None, "<p>" * 100_000), (101, "a\r\nWARC-Type: x", "odd url"), (None, "n", "same"), (102, "t", "tie"), (102, "t", "tie")]


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, pages, least):
    path = common.scratch_path(spark, "warc-test")
    warc.write_archives(pages(rows()), path, least)
    out = warc.read_archives(spark, path).collect()
    kept = {}
    for i, _, h in rows():
        kept[h or ""] = max(kept.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows():
        payload = (h or "").encode()
        revisit = len(payload) >= least and (-1 if i is None else i) != kept[h or ""]
        want.append((-1 if i is None else i, len(payload), digest(payload), "revisit" if revisit else "response", kept[h or ""] if revisit else None, None if revisit else payload))
    found = [(-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in out]
    assert sorted(found, key=repr) == sorted(want, key=repr)


def test_filters_are_pushed_and_payloads_skipped(spark, pages):
    path = common.scratch_path(spark, "warc-test")
    warc.write_archives(pages(rows()), path)
    some = warc.read_archives(spark, path, ["page_id", "record_type", "payload_bytes"])
    picked = some.filter("record_type = 'revisit' and payload_bytes in (4, 0)")
    every = [r for r in some.collect() if r.record_type == "revisit" and r.payload_bytes in (4, 0)]
    assert sorted(picked.collect(), key=repr) == sorted(every, key=repr)
    reader = warc.WarcReader(path, ["page_id"], 1 << 20)
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), warc.IsNotNull(("record_type",)), warc.EqualTo(("other",), 1)]))
    assert [f.attribute for f in left] == [("other",)] and reader.wanted == {"record_type": {"response"}}
    names = sum((p.names for p in reader.partitions()), [])
    assert names and len(warc.WarcReader(path, ["page_id"], 1).partitions()) == len(names)


def test_records_are_plain_warc(spark, pages):
    path = common.scratch_path(spark, "warc-test")
    warc.write_archives(pages([(7, "http://x/", "body")]), path)
    (part,) = [p for p in warc.WarcReader(path, ["page_id"], 1).partitions()]
    data = gzip.decompress(open(part.names[0], "rb").read())
    head, http, rest = data.split(b"\r\n\r\n", 2)
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and b"WARC-Target-URI: http://x/" in head
    assert http.startswith(b"HTTP/1.1 200 OK") and rest == b"body\r\n\r\n"


def test_no_pages_and_no_folder(spark, pages):
    path = common.scratch_path(spark, "warc-test")
    assert warc.read_archives(spark, path).collect() == []
    warc.write_archives(pages([]), path)
    assert warc.read_archives(spark, path).collect() == []
    with pytest.raises(Exception, match="no such columns"):
        warc.read_archives(spark, path, ["nothing"]).collect()


def archive(spark, pages, own):
    path = common.scratch_path(spark, "warc-test")
    warc.write_archives(pages(own), path)
    return [n for p in warc.WarcReader(path, ["page_id"], 1).partitions() for n in p.names]


@pytest.mark.parametrize("read_bytes", [50, 1 << 16])
def test_unwanted_payloads_are_not_inflated(spark, pages, monkeypatch, read_bytes):
    monkeypatch.setattr(warc, "READ_BYTES", read_bytes)
    rnd = random.Random(2)
    own = [(i, f"u{i}", "".join(rnd.choices("abcdefgh", k=200_000)) + str(i)) for i in range(6)]
    for name in archive(spark, pages, own):
        found = {}
        for wanted, with_payload in (({}, True), ({}, False), ({"page_id": {3}}, True)):
            with open(name, "rb") as raw:
                data = warc.Members(raw)
                found[len(wanted), with_payload] = list(warc.records(data, wanted, with_payload)), data.inflated
        rows, inflated = found[0, True]
        assert inflated > 200_000 * len(rows) and all(own[r["page_id"]][2].encode() == r["payload"] for r in rows)
        heads, few = found[0, False]
        assert [{**r, "payload": None} for r in rows] == heads and few <= 2 * warc.HEAD_STEP * len(rows)
        one, some = found[1, True]
        assert one == [r for r in rows if r["page_id"] == 3] and some <= 2 * warc.HEAD_STEP * len(rows) + 210_000 * len(one)


def test_members_of_other_writers(spark, pages, tmp_path):
    (name,) = archive(spark, pages, [(1, "u", "x" * 100_000)])
    plain = gzip.decompress(open(name, "rb").read())
    other = tmp_path / "other.warc.gz"
    other.write_bytes(gzip.compress(plain) + open(name, "rb").read() + gzip.compress(plain[:100]) + gzip.compress(plain[100:]))
    for with_payload in (True, False):
        with open(other, "rb") as raw:
            got = list(warc.records(warc.Members(raw), {}, with_payload))
        assert [r["page_id"] for r in got] == [1] * 3 and [len(r["payload"] or b"") for r in got] == [100_000 * with_payload] * 3


def test_a_common_payload_is_joined_by_plain_exchanges(spark, pages):
    """Both sides of the join on payloads are exchanges of scans, so Spark can split a payload's rows."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = warc.with_revisits(pages(rows()))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Join" in plan and "Aggregate" not in plan
