"""Scanning streams of blobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.functions.scalars import blob_id
from gleaner.operators.matcher import scan
from gleaner.sources.blobs import origin
from gleaner.sources.rules import Rule


def file_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """New files below a folder as blobs, with the time they were last changed as ``seen_at``."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    read = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files)
    rows = read.load(path)
    return _seen(rows, F.col("content"), F.col("path"), F.col("modificationTime"))


def _seen(rows: DataFrame, content: Column, path: Column, time: Column) -> DataFrame:
    return rows.select(
        blob_id(content).alias("blob_id"), content.alias("content"), F.octet_length(content).cast("long").alias("num_bytes"),
        F.array(origin("file", path)).alias("origins"), time.alias("seen_at"),
    )


def table_stream(rows: DataFrame, text: str, time: str, path: str) -> DataFrame:
    """A stream with a text column as blobs that keep their event time as ``seen_at``."""
    return _seen(rows.where(F.col(text).isNotNull()), F.col(text).cast("binary"), F.col(path).cast("string"), F.col(time))


def scan_stream(blobs: DataFrame, rules: Sequence[Rule], lateness: str = "1 hour") -> DataFrame:
    """Matches of a stream; a secret of a rule is told once within the watermark of its first sighting."""
    found = scan(blobs.withWatermark("seen_at", lateness), rules)
    return found.dropDuplicatesWithinWatermark(["rule_id", "secret"])


def counts_per_window(matches: DataFrame, window: str = "10 minutes") -> DataFrame:
    return matches.groupBy(F.window("seen_at", window), "rule_id").agg(F.count("*").alias("findings"))


def write_findings(matches: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Findings as Parquet, exactly once; ``once`` ends after what is there now."""
    writer = matches.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
