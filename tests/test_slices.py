"""Windows over keys with very many rows, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import dedup, dependencies
from gleaner.operators.slices import SLICE, sliced


@pytest.mark.parametrize("least", [5, 100_000])
def test_containment_of_sliced_keys(spark, least):
    rng = random.Random(least)
    rows = [(rng.choice([None, 1, 1, 1, 1, 2]), s := rng.randrange(60), s + rng.choice([0, 1, 3, 5, 40]), i) for i in range(400)]
    frame = spark.createDataFrame(rows, "g int, start int, end int, i int").repartition(3)
    got = {r["i"]: r["contained"] for r in dedup.inside_another(frame, ["g"], tie=["i"], least=least).collect()}
    inside = lambda a, b: a[0] == b[0] and b[1] <= a[1] and b[2] >= a[2] and (b[1] < a[1] or b[2] > a[2] or b[3] < a[3])
    assert got == {a[3]: any(inside(a, b) for b in rows) for a in rows}
    slices = sliced(frame, ["g"], "start", least).groupBy("g").agg(F.count_distinct(SLICE).alias("n")).collect()
    assert max(r["n"] for r in slices) > 3 if least == 5 else all(r["n"] == 1 for r in slices)


@pytest.mark.parametrize("least", [5, 100_000])
def test_nearest_values_of_sliced_blobs(spark, least):
    rng = random.Random(least)
    targets = [(b, i, rng.randrange(3000)) for i, b in enumerate(rng.choices(["hot", "b", "none"], [9, 1, 1], k=300))]
    values = sorted({("hot", p, f"v{p}") for p in rng.sample(range(3000), 12)} | {("b", 5, "x"), ("b", 5, "a"), ("c", 1, "y")})
    t = spark.createDataFrame(targets, "blob_id string, n int, end int")
    v = spark.createDataFrame(values, "blob_id string, start int, value string")
    got = {r["n"]: (r["value_start"], r["value"]) for r in dependencies.nearest_value(t, v, least=least).collect()}
    want = {}
    for b, n, end in targets:
        own = [(abs(p - end), p, value) for k, p, value in values if k == b]
        if own:
            want[n] = min(own)[1:]
    assert got == want
