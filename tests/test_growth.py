"""Steps whose time or memory must not grow faster than their input."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.operators import dedup, dependencies, matcher
from gleaner.plans import catalog
from gleaner.session import shared_folder
from gleaner.sources import archives
from tests.conftest import DATA


def _plan(frame):
    return frame._jdf.queryExecution().toString().lower()


def test_no_window_is_read_again_for_every_row(spark):
    rows = spark.range(3000)
    targets = rows.select(F.lit("b").alias("blob_id"), (F.col("id") * 3).alias("end"))
    values = rows.where("id % 5 = 0").select(F.lit("b").alias("blob_id"), (F.col("id") * 3 + 1).alias("start"), F.col("id").cast("string").alias("value"))
    near = dependencies.nearest_value(targets, values, least=100)
    assert "unboundedfollowing" not in _plan(near)
    starts = [i * 3 + 1 for i in range(0, 3000, 5)]
    want = {e: min(starts, key=lambda s: (abs(s - e), s)) for e in range(0, 9000, 3)}
    assert {r["end"]: r["value_start"] for r in near.collect()} == want


def test_a_row_looks_among_few_of_the_cuts(spark):
    spans = spark.range(4000).select(F.lit(1).alias("g"), (F.col("id") * 7 % 4000).alias("start"), (F.col("id") * 7 % 4000 + F.col("id") % 11).alias("end"), "id")
    told = dedup.inside_another(spans, ["g"], tie=["id"], least=50)
    assert "_far" in _plan(told)
    rows = [tuple(r) for r in spans.collect()]
    far, want = -1, set()
    for _, start, end, i in sorted(rows, key=lambda r: (r[1], -r[2], r[3])):
        if far >= end:
            want.add(i)
        far = max(far, end)
    assert {r["id"] for r in told.where("contained").collect()} == want


def test_matches_are_handed_over_in_parts():
    contents = pa.array([b"a@example.org b@example.org", None, b"none"] * 1000, pa.binary())
    parts = list(matcher.find([catalog.EMAIL]).func(iter([(contents, pa.array(["file"] * 3000))])))
    assert max(sum(len(x) for x in p) for p in parts) <= matcher.TOGETHER + 1
    assert sum(map(len, parts)) == 3000 and [len(x) for p in parts for x in p] == [2, 0, 0] * 1000


def test_members_come_in_batches_of_bounded_bytes():
    frames = list(archives.in_batches(((f"m{i}", b"x" * (5 << 20 if i == 700 else 1)) for i in range(1200))))
    assert [len(f) for f in frames] == [512, 189, 499]


@pytest.mark.parametrize("name", ["stream_scan"])
def test_a_stream_has_files_for_all_cores(spark, name):
    before = set(os.listdir(shared_folder(spark).removeprefix("file:")))
    assert catalog.queries()[name](spark, DATA).count() > 0
    (new,) = [d for d in os.listdir(shared_folder(spark).removeprefix("file:")) if d.startswith("stream-") and d not in before]
    files = [f for f in os.listdir(f"{shared_folder(spark).removeprefix('file:')}/{new}/in") if f.endswith(".parquet")]
    assert len(files) == 2 * spark.sparkContext.defaultParallelism


def test_one_timer_serves_many_contents(monkeypatch):
    import signal

    from gleaner.operators.matcher import Scanner
    from gleaner.plans.catalog import _ACCOUNT, _PIN

    set_, scanner = [], Scanner([_ACCOUNT, _PIN])
    monkeypatch.setattr(signal, "setitimer", lambda *a: set_.append(a))
    with scanner.watching():
        found = [scanner(b"acct %d pin %d" % (i, i * 7), "file") for i in range(100)]
    assert len(set_) == 2 and all([m["secret"] for m in f] == [str(i), str(i * 7)] for i, f in enumerate(found))


def test_requests_are_planned_from_flat_columns(spark):
    from gleaner.operators import validate
    from gleaner.plans.catalog import _PIN

    captures = "array<struct<name:string,match_number:int,start:long,end:long,value:string>>"
    rows = [("b1", "demo.pin", "7", [(None, 0, 0, 5, "pin 7"), (None, 1, 4, 5, "7")]), ("b2", "demo.pin", "7", [(None, 0, 0, 5, "pin 7"), (None, 1, 4, 5, "7")])]
    found = spark.createDataFrame(rows, f"blob_id string, rule_id string, secret string, captures {captures}")
    values = spark.createDataFrame([("b1", "demo.pin", "AKID", "3")], "blob_id string, rule_id string, variable string, value string")
    planned = validate.plan_requests(found, [_PIN], values)
    got = {(r["secret"], tuple((r["extra"] or {}).items()), r["request"].split('"url": ')[1]) for r in planned.collect()}
    assert got == {("7", (("AKID", "3"),), '"https://api.invalid/3/7"}'), ("7", (), '"https://api.invalid//7"}')}
    python = planned._jdf.queryExecution().executedPlan().toString().split("MapInPandas")[1].split("\n")[0]
    assert "array<" not in python and "map<" not in python
