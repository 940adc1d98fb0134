"""Blobs: rows of bytes with where they were found.

Schema: blob_id string, content binary, num_bytes long, origins array<struct<kind, path, repo_path,
commit: struct<commit_id, committer_name, committer_email, committer_ts>, blob_path, extended_json>>.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.scalars import blob_id, is_archive, language, looks_binary, mime_type

DEFAULT_MAX_MB = 25.0


def origin(kind: str, path: Column | None = None, extended: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(
        F.lit(kind).alias("kind"), (null if path is None else path).alias("path"), null.alias("repo_path"),
        F.lit(None).cast("struct<commit_id:string,committer_name:string,committer_email:string,committer_ts:timestamp>").alias("commit"),
        null.alias("blob_path"), (null if extended is None else extended).alias("extended_json"),
    )


def _blobs(rows: DataFrame, content: Column, where: Column) -> DataFrame:
    return rows.select(content.alias("content"), F.array(where).alias("origins")).select(
        blob_id(F.col("content")).alias("blob_id"), "content", F.octet_length("content").cast("long").alias("num_bytes"), "origins"
    )


def from_table(rows: DataFrame, text: str, path: Column) -> DataFrame:
    """A text (or binary) column as blobs; rows with null text are left out."""
    content = F.col(text).cast("binary")
    return _blobs(rows.where(F.col(text).isNotNull()), content, origin("file", path))


def _hidden_files(paths: Iterable[str], limit: int) -> list[tuple[str]]:
    """Files on local paths that Spark's reader passes over: names (or folders) beginning with a dot or underscore."""
    found = []
    for root in (p.removeprefix("file://").removeprefix("file:") for p in paths):
        for folder, _, names in os.walk(root) if "://" not in root else ():
            apart = any(part[:1] in "._" for part in os.path.relpath(folder, root).split(os.sep) if part != ".")
            full = [os.path.join(folder, n) for n in names if apart or n[:1] in "._"]
            found += [(f,) for f in full if os.path.isfile(f) and not os.path.islink(f) and os.path.getsize(f) <= limit]
    return found


def from_files(spark: SparkSession, paths: Iterable[str], max_mb: float = DEFAULT_MAX_MB) -> DataFrame:
    """All files below the paths up to ``max_mb`` MB (negative: 25); larger ones are not read.

    Hidden files are included on local paths, which all executors must reach; in other stores
    Spark's reader leaves out names that begin with a dot or underscore.
    """
    paths = list(paths)
    limit = int((max_mb if max_mb >= 0 else DEFAULT_MAX_MB) * 1024 * 1024)
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    found = _blobs(read.where(F.col("length") <= limit), F.col("content"), origin("file", F.col("path")))
    hidden = _hidden_files(paths, limit)
    if not hidden:
        return found

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                with open(path, "rb") as file:
                    yield pd.DataFrame({"path": [f"file:{path}"], "content": [file.read()]})

    rows = spark.createDataFrame(hidden, "path string").mapInPandas(run, "path string, content binary")
    return found.unionByName(_blobs(rows, F.col("content"), origin("file", F.col("path"))))


def from_jsonl(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON lines ``{content | content_base64, origin}``; lines without content are left out."""
    parsed = lines.select(
        F.from_json(column, "content string, content_base64 string").alias("j"), F.get_json_object(column, "$.origin").alias("o")
    )
    content = F.coalesce(F.unbase64("j.content_base64"), F.col("j.content").cast("binary"))
    return _blobs(parsed.where(content.isNotNull()), content, origin("extended", extended=F.col("o")))


def from_bytes(spark: SparkSession, items: Iterable[tuple[str, bytes]]) -> DataFrame:
    """(path, bytes) pairs, for standard input and tests."""
    rows = spark.createDataFrame([(p, bytearray(b)) for p, b in items], "path string, content binary")
    return _blobs(rows, F.col("content"), origin("file", F.col("path")))


def path_of(origins: str = "origins") -> Column:
    """The path of the first file origin, else of the first origin of any kind, else empty."""
    files = F.filter(F.col(origins), lambda o: o["kind"] == "file")
    first, any_first = F.get(files, F.lit(0)), F.get(F.col(origins), F.lit(0))
    return F.coalesce(
        first["path"], any_first["path"],
        F.when(any_first["repo_path"].isNotNull(), F.concat_ws("/", any_first["repo_path"], any_first["blob_path"])),
        F.get_json_object(any_first["extended_json"], "$.path"), F.lit(""),
    )


def glob_to_regex(line: str, roots: Iterable[str] = ()) -> str | None:
    """A gitignore line (without its ``!``) as a regex over absolute paths; None for blanks and comments.

    A slash at the start or within anchors the pattern to one of ``roots`` (without any, to the start of the path).
    """
    line = re.sub(r"(?<!\\)\s+$", "", line.rstrip("\r\n"))
    if not line or line[0] == "#":
        return None
    folder, anchored = line.endswith("/"), "/" in line.rstrip("/")
    body, out, i = line.strip("/"), "", 0
    while i < len(body):
        c = body[i]
        if body[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif body[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        elif c == "[" and (end := body.find("]", i + 2)) > 0:
            inner = body[i + 1 : end]
            negated = inner[0] in "!^"
            inner = re.sub(r"([\\\[&])", r"\\\1", inner[1:] if negated else inner)
            out, i = out + f"[{'^/' if negated else ''}{inner}]", end + 1
        elif c == "\\" and i + 1 < len(body):
            out, i = out + re.escape(body[i + 1]), i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
            i += 1
    bases = [re.escape(r.rstrip("/")) for r in roots]
    start = (f"^(?:file:/*(?=/))?(?:{'|'.join(bases)})/" if bases else "^(?:file:/*(?=/))?/?") if anchored else "(?:^|/)"
    return f"{start}{out}{'/' if folder else '(?:/|$)'}"


def ignored(path: Column, lines: Iterable[str], roots: Iterable[str] = ()) -> Column:
    """Whether a gitignore list leaves a path out: of the lines that match, the last decides (``!`` keeps)."""
    roots, out = list(roots), F.lit(False)
    for line in lines:
        kept = line.startswith("!")
        pattern = glob_to_regex(line[1:] if kept else line, roots)
        if pattern:
            out = out & ~path.rlike(pattern) if kept else out | path.rlike(pattern)
    return out


def keep(
    blobs: DataFrame, max_mb: float = DEFAULT_MAX_MB, ignore: Iterable[str] = (), no_binary: bool = False, archives: bool = True,
    roots: Iterable[str] = (),
) -> DataFrame:
    """Size, ignore-list, binary and archive filters; anchored lines of the ignore list count from ``roots``."""
    limit = int((max_mb if max_mb >= 0 else DEFAULT_MAX_MB) * 1024 * 1024)
    path = path_of()
    out = blobs.where((F.col("num_bytes") <= limit) & ~ignored(path, ignore, roots))
    if no_binary:
        out = out.where(~looks_binary(F.col("content")) | is_archive(path))
    return out if archives else out.where(~is_archive(path))


def described(blobs: DataFrame) -> DataFrame:
    """``blobs`` with language and MIME type, by path and marks in the content; ``scan`` keeps both for the reports."""
    path = path_of()
    return blobs.withColumns({"language": language(path, F.decode("content", "ISO-8859-1")), "mime": mime_type(path)})


def unseen(blobs: DataFrame, history: DataFrame) -> DataFrame:
    """Blobs that earlier runs (``history``, with blob_id) have not seen."""
    return blobs.join(history.select("blob_id").distinct(), "blob_id", "left_anti")


def distinct_blobs(blobs: DataFrame) -> DataFrame:
    """One row per blob id, with the origins of all its appearances in order."""
    return blobs.groupBy("blob_id").agg(
        F.any_value("content").alias("content"), F.first("num_bytes").alias("num_bytes"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("origins")))).alias("origins"),
    )
