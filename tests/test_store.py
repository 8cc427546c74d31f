import glob
import math
import os

import pytest
from pyspark.sql import functions as F

from dispatchlens.plans import store
from dispatchlens.plans.facts import facts
from test_facts import _raw, _row


def _rows(spark):
    days = [("28-01-2023", 6), ("30-01-2023", 5), ("01-02-2023", 4), ("bad", 2)]
    rows = [
        _row(f"o{d}-{i}", Order_Date=day, Delivery_person_ID=[None, "D1", "D2"][i % 3], Restaurant_ID=["R1", "R2", None][(i + d) % 3],
             Time_Order_picked=f"{9 + (i % 3)}:{10 + 7 * i + d}", Time_taken_min=f"{15 + 3 * i + d} min")
        for d, (day, n) in enumerate(days) for i in range(n)
    ]
    return _raw(spark, rows)


def _same(a, b):
    rows = lambda df: {r.Order_ID: r.asDict() for r in df.collect()}
    a, b = rows(a), rows(b)
    assert a.keys() == b.keys() and a
    for k, row in a.items():
        assert list(row) == list(b[k])
        for c, v in row.items():
            w = b[k][c]
            assert math.isclose(v, w, rel_tol=1e-12) if isinstance(v, float) and w is not None else v == w, (k, c, v, w)


def test_late_days_give_the_same_facts_as_a_rebuild(spark, tmp_path):
    path, raw = str(tmp_path / "store"), _rows(spark)
    late = F.col("Order_Date") == "30-01-2023"
    store.append(raw.where(~late).repartition(20), path, "first")
    _same(store.stored_facts(spark, path), facts(raw.where(~late)))
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/rows/batch=first/**/*.parquet", recursive=True)}
    store.append(raw.where(late).repartition(20), path, "late")
    _same(store.stored_facts(spark, path), facts(raw))
    # the rows before it stay untouched, and its own are few files however many tasks wrote them
    assert before == {f: os.stat(f).st_mtime_ns for f in before}
    assert 1 <= len(glob.glob(f"{path}/rows/batch=late/**/*.parquet", recursive=True)) <= 4
    # the same batch again replaces itself, also where the first try held other months
    store.append(raw, path, "late")
    store.append(raw.where(late), path, "late")
    _same(store.stored_facts(spark, path), facts(raw))
    copy = str(tmp_path / "copy")
    store.compacted(spark, path, copy)
    _same(store.stored_facts(spark, copy), facts(raw))


def test_a_batch_that_broke_off_is_not_read(spark, tmp_path, monkeypatch):
    path, raw = str(tmp_path / "store"), _rows(spark)
    late = F.col("Order_Date") == "30-01-2023"
    store.append(raw.where(~late), path, "first")

    def lost(_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "batch_sums", lost)
        with pytest.raises(RuntimeError):
            store.append(raw.where(late), path, "late")
    _same(store.stored_facts(spark, path), facts(raw.where(~late)))
    store.append(raw.where(late), path, "late")
    _same(store.stored_facts(spark, path), facts(raw))


def test_months_choose_folders_and_names_are_checked(spark, tmp_path):
    path, raw = str(tmp_path / "store"), _rows(spark)
    store.append(raw, path, "all-1.0")
    rows = store.stored_rows(spark, path)
    assert rows.where("Month = 2").count() == 4 and rows.where("Year is null").count() == 2
    plan = rows.where("Month = 2")._jdf.queryExecution().executedPlan().toString()
    assert "Month" in plan.split("PartitionFilters: [")[1].split("]")[0]
    for name in ("", "a/b", "a b", "x=1"):
        with pytest.raises(ValueError):
            store.append(raw, path, name)


def test_no_known_wait_and_no_rows(spark, tmp_path):
    raw = _rows(spark)
    path = str(tmp_path / "unknown")
    never = raw.withColumn("Time_Order_picked", F.lit("08:00"))
    store.append(never, path, "a")
    _same(store.stored_facts(spark, path), facts(never))
    empty = str(tmp_path / "empty")
    store.append(raw.limit(0), empty, "a")
    assert store.stored_facts(spark, empty).count() == 0
    store.append(raw, empty, "b")
    _same(store.stored_facts(spark, empty), facts(raw))
