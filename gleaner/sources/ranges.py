"""Scanning files of any size by ranges of bytes.

A file is cut into ranges that tasks read and scan where they lie; no row ever holds a file.  A range is read with some bytes before and after it (a match
of so many bytes is found wherever it lies), more of them where a match reaches the end of what has been read, and keeps the matches that begin within it, so a match across a cut is found once.  Lines and
columns are made exact by what the ranges before hold: their line feeds, and where the last one is.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from urllib.parse import unquote, urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.operators.matcher import LIMIT, MATCH, Scanner
from gleaner.session import checkpoint
from gleaner.sources.blobs import origin
from gleaner.sources.rules import Rule, compiled, rules_table

#: Bytes of a range, and those read before and after it at first.
SIZE, AROUND = 64 << 20, 1 << 20
_FIELDS = [f for f in MATCH.fields if f.name != "captures"]
_ROWS = (
    "path string, offset long, feeds long, last_feed long, found boolean, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in _FIELDS) + ", "
    "captures " + MATCH["captures"].dataType.simpleString() + ", open_start boolean, open_end boolean"
)


def _local(path: str) -> str:
    parts = urlsplit(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"not a file that tasks can open: {path}")
    return unquote(parts.path) if parts.scheme else path


def _scanned(scanner: Scanner, path: str, offset: int, size: int, around: int) -> tuple[list[dict], int, int]:
    """(matches that begin in the range with offsets in the file, line feeds of the range, the offset of the last one or -1)."""
    total, back, ahead = os.path.getsize(path), around, around
    with open(path, "rb") as file:
        while True:
            begin, stop = max(0, offset - back), min(total, offset + size + ahead)
            file.seek(begin)
            content = file.read(stop - begin)
            found = scanner(content, "file")
            # a whole match is the group of number 0; one that touches what has been read may go on beyond it
            whole = [next((c for c in m["captures"] if c["name"] is None and c["match_number"] == 0), m) for m in found if "problem" not in m]
            early = begin > 0 and any(w["start"] == 0 and w["end"] > offset - begin for w in whole)
            late = stop < total and any(w["end"] == len(content) and w["start"] < offset + size - begin for w in whole)
            if not early and not late:
                break
            back, ahead = back * 4 if early else back, ahead * 4 if late else ahead
    core = np.frombuffer(content, np.uint8)[offset - begin : offset + size - begin]
    feeds = np.flatnonzero(core == 10)
    before = int((np.frombuffer(content, np.uint8)[: offset - begin] == 10).sum())
    out = []
    for m in found:
        if "problem" in m:
            out.append(m)
            continue
        if not offset <= m["start"] + begin < offset + size:
            continue
        # lines in relation to the range's first; columns from the line's start, where that has been read
        opens = [begin > 0 and m[f"line_{side}"] == 1 for side in ("start", "end")]
        captures = [{**c, "start": c["start"] + begin, "end": c["end"] + begin} for c in m["captures"]]
        out.append({
            **m, "start": m["start"] + begin, "end": m["end"] + begin, "line_start": m["line_start"] - before, "line_end": m["line_end"] - before, "captures": captures,
            "open_start": opens[0], "open_end": opens[1],
        })
    return out, len(feeds), int(feeds[-1]) + offset if len(feeds) else -1


def scan_files(spark: SparkSession, paths: Sequence[str], rules: Sequence[Rule], size: int = SIZE, around: int = AROUND, limit: float = LIMIT) -> DataFrame:
    """Matches in files (and those below folders) of any size, as ``matcher.scan`` gives them: one row per match with offsets, lines and columns in the file.

    ``blob_id`` is null, as a file's id would need all its bytes in one place, and ``origins`` names the path.  Files have to be reachable by the executors
    as files.  The result does not depend on ``size``: it is that of scanning each file as one, for matches of at most ``around`` bytes.  A rule that takes more than ``limit`` seconds on a range ends there.
    """
    compiled(rules)
    rules = list(rules)
    # names and lengths only; contents are not read
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path", "length").where("length > 0")
    cut = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("offset"))
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(rules, limit=limit)
        names = ["path", "offset", "feeds", "last_feed", "found"] + [f.name for f in _FIELDS] + ["captures", "open_start", "open_end"]
        for batch in batches:
            for path, offset in zip(batch["path"], batch["offset"], strict=True):
                found, feeds, last = _scanned(scanner, _local(path), int(offset), size, around)
                rows = [{"path": path, "offset": offset, "feeds": feeds, "last_feed": last, "found": False}]
                rows += [{"path": path, "offset": offset, "found": True, **m} for m in found if "problem" not in m]
                yield pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names, dtype=object)

    told = checkpoint(cut.repartition(partitions, "path", "offset").mapInPandas(run, _ROWS))
    order = Window.partitionBy("path").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    before = told.where("not found").select("path", "offset", F.coalesce(F.sum("feeds").over(order), F.lit(0)).alias("_feeds"), F.coalesce(F.max("last_feed").over(order), F.lit(-1)).alias("_last"))
    rows = told.where("found").drop("feeds", "last_feed", "found").join(before, ["path", "offset"])
    column = lambda side, at: F.when(F.col(f"open_{side}"), at - F.col("_last") - 1).otherwise(F.col(f"column_{side}")).cast("int")
    rows = rows.withColumns(
        {
            "column_start": column("start", F.col("start")), "column_end": column("end", F.greatest(F.col("start"), F.col("end") - 1)),
            "line_start": (F.col("line_start") + F.col("_feeds")).cast("int"), "line_end": (F.col("line_end") + F.col("_feeds")).cast("int"),
            "origins": F.array(origin("file", F.col("path"))), "blob_id": F.lit(None).cast("string"),
        }
    )
    known = rules_table(spark, rules).select("rule_id", "rule_name", "confidence", "visible", "prevalidated", "rule_sha1")
    fields = [f.name for f in MATCH.fields if f.name != "problem"]
    return rows.select("blob_id", "origins", *fields).join(F.broadcast(known), "rule_id").withColumns(
        {"validation_success": F.lit(False), "validation_status": F.lit(100), "validation_body": F.lit("")}
    )
