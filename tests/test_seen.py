"""Keys of earlier runs: no error, and few rows in the exact join."""

from pyspark.sql import functions as F

from gleaner.sources import seen


def test_runs_of_many_sizes(spark, tmp_path, monkeypatch):
    store = str(tmp_path)
    key = lambda a, b: spark.range(a, b).select(F.sha1(F.col("id").cast("string").cast("binary")).alias("k"), "id")
    seen.record(key(0, 20_000), "k", store, "large")
    seen.record(key(30_000, 30_050), "k", store, "small")
    seen.record(key(40_000, 40_001).where("id < 0"), "k", store, "none")
    rows = key(0, 60_000).unionByName(spark.createDataFrame([(None, -1)], "k string, id long"))
    told = seen.judged(rows, "k", store)
    assert told.where("id between 0 and 19999 and not maybe or id between 30000 and 30049 and not maybe").count() == 0
    # by chance: a few in a thousand, though a small run has been spread over the blocks of the large one
    assert told.where("maybe").count() - 20_050 < 0.01 * 40_000
    for small in (seen.SMALL, 0):  # broadcast, and joined by block
        monkeypatch.setattr(seen, "SMALL", small)
        got = seen.unseen(rows, "k", store)
        assert got.count() == 39_951 and got.columns == rows.columns and got.where("k is null").count() == 1
    seen.record(key(0, 10), "k", store, "large")  # a run told again replaces itself
    assert seen.unseen(rows, "k", store).count() == 60_001 - 60


def test_a_sketch_of_no_keys(spark, tmp_path):
    rows = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    seen.record(rows.where("k = 'z'"), "k", str(tmp_path), "first")
    assert seen.unseen(rows, "k", str(tmp_path)).count() == 3
