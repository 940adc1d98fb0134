"""Git repositories as a data source: ``spark.read.format("gleaner_git")`` and ``spark.readStream``.

Options: ``path`` (a repository that the executors reach), ``table`` (``commits``, ``changes`` or ``objects``) and ``rows`` (commits or
prefixes of ids of a partition).  A partition is a range of the history, or of the ids of objects; tasks list their own ids, so the driver
learns no more than how many commits there are.  A stream is of changes with their contents; its offset is what the refs pointed to, so a micro-batch reads
the commits that are reachable from the new refs and not from those before, and reads the same again after a failure.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from gleaner.sources.git import _git, contents_of, history_of

COMMITS = "commit_id string, parents array<string>, topo long, committer_name string, committer_email string, committer_ts timestamp"
CHANGES = "commit_id string, path string, blob_id string"
OBJECTS = "blob_id string, content binary"
#: Of a stream: when and where a blob was put in, and its content.
STREAM = f"{CHANGES}, committer_ts timestamp, content binary"
TABLES = {"commits": COMMITS, "changes": CHANGES, "objects": OBJECTS}
#: Commits of a partition, and prefixes of object ids (of 256) of one.
ROWS = 2048
_AT_ONCE = 256


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitSource)


@dataclass
class Stretch(InputPartition):
    """Commits ``first`` to ``stop``, as listed from the newest, of those that are reachable from ``tips`` and not from ``known``; or objects by prefix."""

    first: int
    stop: int
    total: int
    tips: tuple[str, ...] = ("--all",)
    known: tuple[str, ...] = ()


def _revisions(repo: str, tips: tuple[str, ...], known: tuple[str, ...], *options: str) -> bytes:
    """What rev-list says of the commits reachable from tips and not from known (which may have vanished with their refs)."""
    here = [k for k in known if _exists(repo, k)]
    if not tips:
        return b""
    if tips == ("--all",):
        return _git(repo, "rev-list", *options, "--all")
    return _git(repo, "rev-list", *options, "--stdin", data="\n".join([*tips, *(f"^{k}" for k in here)]).encode() + b"\n")


def _exists(repo: str, oid: str) -> bool:
    return b" missing" not in _git(repo, "cat-file", "--batch-check", data=oid.encode() + b"\n")


def _stretches(repo: str, rows: int, tips: tuple[str, ...], known: tuple[str, ...]) -> list[Stretch]:
    total = int(_revisions(repo, tips, known, "--count") or 0)
    return [Stretch(at, min(at + rows, total), total, tips, known) for at in range(0, total, rows)]


def _topo(repo: str, part: Stretch) -> Iterator[dict[str, int]]:
    """Ids of a stretch with their numbers, ancestors smaller, some at a time."""
    told = _revisions(repo, part.tips, part.known, "--topo-order", f"--skip={part.first}", f"--max-count={part.stop - part.first}").decode().split()
    numbered = [(oid, part.total - 1 - part.first - i) for i, oid in enumerate(told)]
    for at in range(0, len(numbered), _AT_ONCE):
        yield dict(numbered[at : at + _AT_ONCE])


def _time(seconds: int) -> datetime:
    return datetime.fromtimestamp(seconds, timezone.utc)


class GitSource(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return "gleaner_git"

    def schema(self) -> str:
        return TABLES[self.options.get("table", "changes")]

    def reader(self, schema) -> DataSourceReader:
        return GitReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802 - the interface's name
        return GitStream(self.options)


class GitReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.repo, self.table, self.rows = options["path"], options.get("table", "changes"), int(options.get("rows", ROWS))
        if self.table not in TABLES:
            raise ValueError(f"No table {self.table!r}: {', '.join(TABLES)}")

    def partitions(self) -> list[Stretch]:
        if self.table == "objects":
            step = max(1, min(256, self.rows))
            return [Stretch(at, min(at + step, 256), 256) for at in range(0, 256, step)]
        return _stretches(self.repo, self.rows, ("--all",), ())

    def read(self, partition: Stretch) -> Iterator[tuple]:
        if self.table == "objects":
            wanted = {f"{n:02x}" for n in range(partition.first, partition.stop)}
            listing = _git(self.repo, "cat-file", "--batch-all-objects", "--batch-check=%(objectname) %(objecttype)").decode().split("\n")
            yield from contents_of(self.repo, [x.split(" ")[0] for x in listing if x.endswith(" blob") and x[:2] in wanted])
            return
        for topo in _topo(self.repo, partition):
            commits, changes = history_of(self.repo, topo)
            if self.table == "changes":
                yield from changes
            else:
                yield from ((oid, parents, n, name, mail, _time(when)) for oid, parents, n, name, mail, when in commits)


class GitStream(DataSourceStreamReader):
    """Changes of new commits, with contents."""

    def __init__(self, options: dict) -> None:
        self.repo, self.rows = options["path"], int(options.get("rows", ROWS))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"tips": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        tips = _git(self.repo, "for-each-ref", "--format=%(objectname)").decode().split()
        return {"tips": " ".join(sorted(set(tips)))}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        return _stretches(self.repo, self.rows, tuple(end["tips"].split()), tuple(start["tips"].split()))

    def read(self, partition: Stretch) -> Iterator[tuple]:
        for topo in _topo(self.repo, partition):
            commits, changes = history_of(self.repo, topo)
            when = {c[0]: _time(c[5]) for c in commits}
            content = dict(contents_of(self.repo, sorted({blob for _, _, blob in changes})))
            yield from ((oid, path, blob, when[oid], content[blob]) for oid, path, blob in changes)

    def commit(self, end: dict) -> None:
        pass


class GitStreamSource(GitSource):
    """The same with the stream's columns."""

    @classmethod
    def name(cls) -> str:
        return "gleaner_git_stream"

    def schema(self) -> str:
        return STREAM


def register_stream(spark: SparkSession) -> None:
    spark.dataSource.register(GitStreamSource)
