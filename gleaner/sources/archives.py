"""Members of archives as blobs of their own."""

from __future__ import annotations

import bz2
import gzip
import io
import json
import lzma
import posixpath
import shutil
import struct
import tarfile
import tempfile
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.scalars import ZIP_FAMILY, fingerprint, is_archive
from gleaner.operators.dedup import first_of_each
from gleaner.sources.blobs import _blobs, origin, path_of

#: A longer member is given in pieces of this many bytes, each beginning with the last ``OVERLAP`` of the one before.
PIECE = 256 << 20
OVERLAP = 1 << 20


def safe_member(name: str) -> bool:
    """Relative, and without a step up."""
    return not name.startswith("/") and ".." not in name.split("/")


class _Part(io.RawIOBase):
    """Bytes ``at`` to ``end`` of a file."""

    def __init__(self, file: BinaryIO, at: int, end: int) -> None:
        self.file, self.at, self.end = file, at, end

    def readable(self) -> bool:
        return True

    def readinto(self, into: memoryview) -> int:
        self.file.seek(self.at)
        data = self.file.read(max(0, min(len(into), self.end - self.at)))
        into[: len(data)] = data
        self.at += len(data)
        return len(data)


class _Inflated(io.RawIOBase):
    """The content of a zlib stream."""

    def __init__(self, file: BinaryIO) -> None:
        self.file, self.stream, self.rest = file, zlib.decompressobj(), b""

    def readable(self) -> bool:
        return True

    def readinto(self, into: memoryview) -> int:
        while not self.stream.eof:
            data = self.rest or self.file.read(1 << 16)
            out = self.stream.decompress(data, len(into))
            self.rest = self.stream.unconsumed_tail
            into[: len(out)] = out
            if out or not data:
                return len(out)
        return 0


def _asar(file: BinaryIO) -> Iterator[tuple[str, BinaryIO]]:
    head = file.read(16)
    size, length = struct.unpack_from("<I", head, 4)[0], struct.unpack_from("<I", head, 12)[0]
    base = 8 + size

    def walk(node: dict, path: str) -> Iterator[tuple[str, BinaryIO]]:
        for name, entry in node.get("files", {}).items():
            inner = posixpath.join(path, name)
            if "files" in entry:
                yield from walk(entry, inner)
            elif "offset" in entry:
                at = base + int(entry["offset"])
                yield inner, io.BufferedReader(_Part(file, at, at + entry["size"]))

    yield from walk(json.loads(file.read(length)), "")


def _entries(path: str, file: BinaryIO) -> Iterator[tuple[str, BinaryIO]]:
    """(name, content) of every regular file in an archive; each is to be read before the next is asked for."""
    name = posixpath.basename(path).lower()
    ext = name.rpartition(".")[2]
    if ext in ZIP_FAMILY:
        with zipfile.ZipFile(file) as archive:
            for i in archive.infolist():
                if not i.is_dir() and safe_member(i.filename):
                    with archive.open(i) as content:
                        yield i.filename, content
    elif ext == "tar" or ext == "tgz" or ".tar." in name:
        with tarfile.open(fileobj=file) as archive:
            for m in archive:
                if m.isfile() and safe_member(m.name):
                    yield m.name, archive.extractfile(m)
    elif ext == "asar":
        yield from ((n, content) for n, content in _asar(file) if safe_member(n))
    elif ext in ("gz", "bz2", "xz", "zlib"):
        opener = {"gz": lambda f: gzip.GzipFile(fileobj=f), "bz2": bz2.BZ2File, "xz": lzma.LZMAFile}.get(ext)
        yield posixpath.basename(path)[: -len(ext) - 1], opener(file) if opener else io.BufferedReader(_Inflated(file))


def _pieces(name: str, file: BinaryIO, piece: int) -> Iterator[tuple[str, bytes]]:
    overlap = min(OVERLAP, piece // 2)
    data, at, feeds, column = file.read(piece), 0, 0, 0
    more = file.read(piece - overlap) if len(data) == piece else b""
    if not more:
        yield name, data
        return
    yield f"{name}@0:0:0", data
    while more:
        passed = data[: piece - overlap]
        feeds += passed.count(b"\n")
        column = len(passed) - 1 - passed.rfind(b"\n") if b"\n" in passed else column + len(passed)
        data, at = data[piece - overlap :] + more, at + piece - overlap
        yield f"{name}@{at}:{feeds}:{column}", data
        more = file.read(piece - overlap) if len(data) == piece else b""


def members(path: str, data: bytes | BinaryIO, depth: int = 2, piece: int = PIECE) -> Iterator[tuple[str, bytes]]:
    """(archive!member, bytes) of every regular file in an archive, nested ones down to ``depth``.

    Members are read whole: one of more than ``piece`` bytes comes in overlapping pieces, named
    ``archive!member@offset:lines:column`` by what lies before them (``joined`` puts their findings together); archives within are copied to a temporary file.  Names that
    leave the archive are skipped; what cannot be read to its end as an archive yields itself (too).
    """
    file = io.BytesIO(data) if isinstance(data, bytes) else data
    whole = False
    try:
        for member, content in _entries(path, file):
            nested = member.lower().rpartition(".")[2]
            if depth > 1 and (nested in ZIP_FAMILY or nested in ("gz", "tgz", "bz2", "xz", "tar", "zlib", "asar")):
                with tempfile.TemporaryFile() as inner:
                    shutil.copyfileobj(content, inner)
                    inner.seek(0)
                    yield from members(f"{path}!{member}", inner, depth - 1, piece)
            else:
                yield from _pieces(f"{path}!{member}", content, piece)
            whole = True
    except (OSError, EOFError, ValueError, KeyError, RuntimeError, NotImplementedError, zlib.error, lzma.LZMAError, zipfile.BadZipFile, tarfile.TarError, struct.error):
        whole = False
    if not whole:
        file.seek(0)
        yield from _pieces(path, file, piece)


_PIECE_OF = r"^(.*!.*)@([0-9]+):([0-9]+):([0-9]+)$"


def joined(findings: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """Findings in pieces of long members as findings in the members: offsets, lines, columns and fingerprints as in the whole, each once.

    What lies wholly in the part that a piece shares with the one before was found there; of findings of a rule that begin at one place the longest
    stays, as one cut off by the end of a piece is whole in the next.  Other findings stay as they are.
    """
    told = lambda i: F.regexp_extract(path_of(), _PIECE_OF, i)
    pieced = F.coalesce(path_of().rlike(_PIECE_OF), F.lit(False))
    numbers = {"_at": told(2).try_cast("long"), "_feeds": told(3).try_cast("long"), "_column": told(4).try_cast("long")}
    # where the whole match ends, of which the value may be a part
    last = F.get(F.filter("captures", lambda c: c["name"].isNull() & (c["match_number"] == 0)), F.lit(0))["end"]
    pieces = findings.where(pieced).withColumns(numbers).where((F.col("_at") == 0) | (F.coalesce(last, F.col("end")) > overlap))
    moved = lambda c, line: F.when(F.col(line) == 1, F.col(c) + F.col("_column")).otherwise(F.col(c)).cast("int")
    at = F.col("_at")
    whole = pieces.withColumns(
        {
            "start": F.col("start") + at, "end": F.col("end") + at, "column_start": moved("column_start", "line_start"), "column_end": moved("column_end", "line_end"),
            "line_start": (F.col("line_start") + F.col("_feeds")).cast("int"), "line_end": (F.col("line_end") + F.col("_feeds")).cast("int"),
            "captures": F.transform("captures", lambda c: c.withField("start", c["start"] + at).withField("end", c["end"] + at)),
            "origins": F.transform("origins", lambda o: o.withField("path", F.regexp_replace(o["path"], _PIECE_OF, "$1"))),
        }
    ).drop(*numbers)
    whole = first_of_each(whole, [path_of().alias("_path"), F.col("rule_id").alias("_rule"), F.col("start").alias("_start")], [-F.col("end")])
    whole = whole.withColumn("fingerprint", fingerprint(F.col("secret").cast("binary"), F.lit("file"), F.col("start"), F.col("end")))
    return findings.where(~pieced).unionByName(whole.select(findings.columns))


def in_batches(rows: Iterator[tuple[str, bytes]], most: int = 4 << 20, count: int = 512) -> Iterator[pd.DataFrame]:
    """(path, content) as frames of up to ``count`` rows that end once they hold ``most`` bytes."""
    paths, contents, held = [], [], 0
    for path, content in rows:
        paths.append(path)
        contents.append(content)
        held += len(content)
        if held >= most or len(paths) >= count:
            yield pd.DataFrame({"path": paths, "content": contents})
            paths, contents, held = [], [], 0
    if paths:
        yield pd.DataFrame({"path": paths, "content": contents})


def expand(blobs: DataFrame, depth: int = 2, piece: int = PIECE) -> DataFrame:
    """Archives replaced by their members (an archive among the members too, down to ``depth``); other blobs stay."""
    path = path_of()
    packed = blobs.where(is_archive(path)).select(path.alias("path"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from in_batches(m for batch in batches for name, data in zip(batch["path"], batch["content"], strict=True) for m in members(name, bytes(data), depth, piece))

    out = packed.mapInPandas(run, "path string, content binary")
    return blobs.where(~is_archive(path)).unionByName(_blobs(out, F.col("content"), origin("file", F.col("path"))))
