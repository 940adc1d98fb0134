"""One document from many tasks: parts in order, each with the separators it needs, joined as files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import checkpoint


def write_document(rows: DataFrame, order: Sequence[str | Column], path: str, head: str, tail: str, between: str = ",") -> None:
    """Writes the column ``value`` of ``rows`` in order as text files below ``path`` that, one after another, are one document.

    The rows are sorted over ranges, one part each.  A row begins with ``between`` unless it is the document's first, which begins with ``head``; the last one ends
    with ``tail``.  Which rows these are is told by their numbers in the sorted table, two of which come to the driver.  Without rows the document is
    ``head`` and ``tail``.  Null values are left out.
    """
    ordered = rows.where("value is not null").orderBy(*order).select("value")
    # written once, so that the numbers are those of the rows that are written out
    numbered = checkpoint(ordered.withColumn("n", F.monotonically_increasing_id()))
    first, last = numbered.agg(F.min("n"), F.max("n")).first()
    if first is None:
        rows.sparkSession.createDataFrame([(head + tail,)], "value string").write.mode("overwrite").text(path)
        return
    before = F.when(F.col("n") == first, head).otherwise(between)
    numbered.select(F.concat(before, "value", F.when(F.col("n") == last, tail).otherwise("")).alias("value")).write.mode("overwrite").text(path)


def join_files(spark: SparkSession, folder: str, target: str) -> None:
    """Copies the parts below ``folder`` one after another into the file ``target``, on any file systems.

    The bytes go through a buffer of a few kilobytes in the driver's JVM.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    source, goal = path(folder), path(target)
    files, out_files = source.getFileSystem(conf), goal.getFileSystem(conf)
    names = [s.getPath().getName() for s in files.listStatus(source)]
    parts = sorted((n for n in names if n.startswith("part-")), key=lambda n: (int(n.split("-")[1].split(".")[0]), n))
    out_files.setWriteChecksum(False)
    out = out_files.create(goal, True)
    try:
        for name in parts:
            part = files.open(path(source, name))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
            finally:
                part.close()
    finally:
        out.close()
