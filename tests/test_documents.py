"""Documents that many tasks write."""

import json

from pyspark.sql import functions as F

from gleaner.operators import documents


def _joined(spark, tmp_path, rows, **how):
    documents.write_document(rows, ["n", "value"], str(tmp_path / "parts"), "[", "]", **how)
    documents.join_files(spark, str(tmp_path / "parts"), str(tmp_path / "whole"))
    return (tmp_path / "whole").read_text("utf-8")


def test_a_document_from_many_tasks(spark, tmp_path):
    n = 200_000
    rows = spark.range(n).select((F.lit(n) - F.col("id")).alias("n"), F.to_json(F.struct(F.col("id"), F.lit("é\n\"").alias("t"))).alias("value")).repartition(9)
    told = json.loads(_joined(spark, tmp_path, rows))
    assert [r["id"] for r in told] == list(range(n - 1, -1, -1)) and told[0]["t"] == "é\n\""
    assert len(list((tmp_path / "parts").glob("part-*"))) > 1 and not (tmp_path / ".whole.crc").exists()


def test_documents_of_one_row_and_of_none(spark, tmp_path):
    one = spark.createDataFrame([(1, "7"), (2, None)], "n int, value string")
    assert json.loads(_joined(spark, tmp_path / "a", one)) == [7]
    assert json.loads(_joined(spark, tmp_path / "b", one.where("n > 5"))) == []
    assert json.loads(_joined(spark, tmp_path / "c", one.union(one).select("n", F.coalesce("value", F.lit("8")).alias("value")))) == [7, 7, 8, 8]
