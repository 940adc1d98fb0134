"""The match operator: every rule's secrets in a column of bytes.

Each rule's regex runs only on content that meets its condition over literals: of each clause one is there.  All literals of all
rules are looked for in one pass.
Where all rules together have only a few, rows without any of them do not even reach
Python: a built-in filter drops them first.  The matching itself is one Arrow-batched function from content to an array of matches, so
all other columns stay in the JVM.
"""

from __future__ import annotations

import re
import time
import uuid
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from contextlib import contextmanager, nullcontext

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, FloatType, IntegerType, LongType, StringType, StructField, StructType

from gleaner.functions.regexes import Bounded, OutOfTime, compile_bytes, interruptible, time_limit
from gleaner.functions.scalars import entropy_of, fingerprint_of, is_safe
from gleaner.sources.blobs import path_of
from gleaner.sources.rules import Rule, compiled, rules_table

CAPTURE = StructType(
    [
        StructField("name", StringType()), StructField("match_number", IntegerType()), StructField("start", LongType()),
        StructField("end", LongType()), StructField("value", StringType()),
    ]
)
MATCH = StructType(
    [
        StructField("rule_id", StringType()), StructField("start", LongType()), StructField("end", LongType()),
        StructField("value", BinaryType()), StructField("secret", StringType()), StructField("captures", ArrayType(CAPTURE)),
        StructField("entropy", FloatType()), StructField("line_start", IntegerType()), StructField("column_start", IntegerType()),
        StructField("line_end", IntegerType()), StructField("column_end", IntegerType()), StructField("fingerprint", StringType()),
        StructField("problem", StringType()),
    ]
)


#: Seconds that a rule may take on one content.
LIMIT = 60.0


def _captures(m: re.Match[bytes]) -> list[dict]:
    """Named groups first (number -1), then all groups in order; those that took no part are left out."""
    names = m.re.groupindex
    groups = [*((n, -1, n) for n in sorted(names, key=names.get)), *((None, i, i) for i in range(m.re.groups + 1))]
    return [
        {"name": n, "match_number": i, "start": m.start(g), "end": m.end(g), "value": m[g].decode("utf-8", "replace")}
        for n, i, g in groups if m[g] is not None
    ]


class _Lines:
    """Offsets to (line from 1, column from 0), by binary search among the offsets of line feeds."""

    def __init__(self, content: bytes, compat: bool) -> None:
        self.content, self.compat, self.feeds = content, compat, None

    def at(self, offset: int) -> tuple[int, int]:
        if self.feeds is None:  # contents without matches need none
            self.feeds = np.flatnonzero(np.frombuffer(self.content, np.uint8) == 10).tolist() if b"\n" in self.content else []
        before = bisect_left(self.feeds, offset)
        if before < len(self.feeds) and self.feeds[before] == offset:
            return before + 2, 0
        column = offset - self.feeds[before - 1] - 1 if before else offset
        return before + 1, 0 if self.compat and not before and self.feeds else column


class _Spans:
    """Accepted spans, none within another: in order of their starts their ends ascend too, so only neighbours need a look."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def accept(self, start: int, end: int) -> bool:
        """Takes the span unless it lies in or around an accepted one."""
        at = bisect_left(self.starts, start)
        if at < len(self.starts) and (self.ends[at] <= end or self.starts[at] == start):
            return False
        if at and self.ends[at - 1] >= end:
            return False
        self.starts.insert(at, start)
        self.ends.insert(at, end)
        return True


class Scanner:
    """Matches of a set of rules in one piece of content.

    A rule may run for ``limit`` seconds on one content; then what it has found there stays, and one more entry tells of
    the ``problem``.
    """

    def __init__(self, rules: Sequence[Rule], compat_columns: bool = False, limit: float = LIMIT) -> None:
        self.stoppable, self.limit = interruptible(), limit
        pattern = compile_bytes if self.stoppable else lambda p: Bounded(p, limit)
        self.rules = [(r.id, pattern(r.pattern), r.min_entropy) for r in rules]
        clauses = [[frozenset(k.encode() for k in c) for c in r.clauses] for r in rules]
        self.literals = {k for own in clauses for c in own for k in c}
        #: Rules that nothing is known of, and those of each literal of a first clause, with their other clauses.
        self.always = [i for i, own in enumerate(clauses) if not own]
        self.by_literal: dict[bytes, list[int]] = {}
        self.further = [own[1:] for own in clauses]
        for i, own in enumerate(clauses):
            for k in own[0] if own else ():
                self.by_literal.setdefault(k, []).append(i)
        self.compat = compat_columns
        self.automaton = _automaton(self.literals) if len(self.literals) > MANY_LITERALS else None
        #: Rules due by the literals present: contents of one form have the same.
        self.known: dict[frozenset[bytes], list[int]] = {}
        #: When the present rule began, in a list (see ``time_limit``); None outside ``watching``.
        self.since: list[float | None] | None = None
        #: Seconds that each rule took on the last content, where asked for.
        self.seconds: dict[str, float] | None = None

    @contextmanager
    def watching(self) -> Iterator[None]:
        """Inside, one timer serves all contents; without, each sets its own."""
        with time_limit(self.limit) if self.stoppable else nullcontext([None]) as self.since:
            try:
                yield
            finally:
                self.since = None

    def _present(self, content: bytes) -> set[bytes]:
        lower = content.lower() if self.literals else b""
        if self.automaton is None:
            return {k for k in self.literals if k in lower}
        return {k for _, k in self.automaton.iter(lower.decode("latin-1"))}

    def due(self, content: bytes) -> list[int]:
        """The rules whose conditions the content meets, in order."""
        present = frozenset(self._present(content))
        due = self.known.get(present)
        if due is None:
            first = {i for k in present for i in self.by_literal.get(k, ())}
            due = sorted([*self.always, *(i for i in first if not any(present.isdisjoint(c) for c in self.further[i]))])
            if len(self.known) < MANY_FORMS:
                self.known[present] = due
        return due

    def __call__(self, content: bytes, kind: str) -> list[dict]:
        due = [self.rules[i] for i in self.due(content)]
        lines, out = _Lines(content, self.compat), []
        if self.seconds is not None:
            self.seconds.update((r[0], 0.0) for r in self.rules)
        with self.watching() if due and self.since is None else nullcontext():
            for rule in due:
                before = time.perf_counter()
                try:
                    self.since[0] = before  # the limit is each rule's own
                    self._match(*rule, content, kind, lines, out)
                    self.since[0] = None
                except OutOfTime:
                    self.since[0] = None
                    out.append({"rule_id": rule[0], "problem": f"no end of matching after {self.limit} seconds"})
                if self.seconds is not None:
                    self.seconds[rule[0]] = time.perf_counter() - before
        return out

    @staticmethod
    def _match(rule_id: str, regex, least: float, content: bytes, kind: str, lines: _Lines, out: list[dict]) -> None:
        accepted = _Spans()
        for m in regex.finditer(content):
            group = 1 if m.re.groups and m[1] is not None else 0
            value, (start, end) = m[group], m.span(group)
            bits = entropy_of(value)
            if bits <= least or is_safe(value) or not accepted.accept(start, end):
                continue
            captures = _captures(m)
            secret = captures[min(1, len(captures) - 1)]["value"]
            (l0, c0), (l1, c1) = lines.at(start), lines.at(max(start, end - 1))
            out.append(
                {
                    "rule_id": rule_id, "start": start, "end": end, "value": value, "secret": secret,
                    "captures": captures, "entropy": bits, "line_start": l0, "column_start": c0, "line_end": l1, "column_end": c1,
                    "fingerprint": str(fingerprint_of(secret.encode("utf-8"), kind, start, end)),
                }
            )


#: So many sets of literals are remembered with the rules that they call for.
MANY_FORMS = 1024
#: With more literals than this one automaton looks for all of them at once; below, separate searches are faster.
MANY_LITERALS = 24


def _automaton(literals: set[bytes]):
    """An automaton over the literals (none within another's end is lost: all hits are reported)."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for literal in literals:
        automaton.add_word(literal.decode("latin-1"), literal)
    automaton.make_automaton()
    return automaton


#: From this many matches on they are handed over, however many contents of a batch are left.
TOGETHER = 1000


def find(rules: Sequence[Rule], compat_columns: bool = False, limit: float = LIMIT):
    """A Column function (content, origin kind) -> array of matches (and of problems, where ``problem`` is not null)."""
    rules = list(rules)

    @arrow_udf(ArrayType(MATCH))
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        scanner, kind_of = Scanner(rules, compat_columns, limit), to_arrow_type(ArrayType(MATCH))
        for contents, kinds in batches:
            kinds, at = kinds.to_pylist(), 0
            while at < len(contents):
                found, held = [], 0
                with scanner.watching():  # not while the matches are handed over
                    while at < len(contents) and held < TOGETHER:
                        content = contents[at].as_py()
                        found.append(scanner(content, kinds[at]) if content is not None else [])
                        held, at = held + len(found[-1]), at + 1
                yield pa.array(found, kind_of)

    return run


#: With more literals than this, looking for them in the JVM costs more than handing the content to Python.
FEW_LITERALS = 4


def may_match(rules: Sequence[Rule], content: Column) -> Column | None:
    """A built-in filter that all matching content passes; None if some rule has no known literal or there are many."""
    literals = {k for r in rules for k in r.literals}
    # a literal within another makes the longer one needless
    needed = [a for a in sorted(literals) if not any(b != a and b in a for b in literals)]
    if not all(r.literals for r in rules) or len(needed) > FEW_LITERALS:
        return None

    def present(text: Column) -> Column:
        found = F.lit(False)
        for literal in needed:
            found = found | text.contains(literal)
        return found

    # as an array of one, so that the content is decoded once and not for each literal
    return F.exists(F.array(F.lower(F.decode(content, "ISO-8859-1"))), present)


def timings(blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(rule_id, blob_id, path, seconds): how long each rule's pattern ran on each blob that had one of its literals."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(rules)
        for batch in batches:
            out = []
            for blob_id, path, content in zip(batch["blob_id"], batch["path"], batch["content"], strict=True):
                scanner.seconds = {}
                scanner(bytes(content), "file")
                out += [(rule_id, blob_id, path, s) for rule_id, s in scanner.seconds.items() if s > 0]
            yield pd.DataFrame(out, columns=["rule_id", "blob_id", "path", "seconds"])

    rows = blobs.where("content is not null").select("blob_id", path_of().alias("path"), "content")
    return rows.mapInPandas(run, "rule_id string, blob_id string, path string, seconds double")


#: What a match adds to a blob.
_RULE = ("rule_name", "confidence", "visible", "prevalidated", "rule_sha1")


def scan(
    blobs: DataFrame, rules: Sequence[Rule], compat_columns: bool = False, context: int | None = None, limit: float = LIMIT, problems: bool = False
) -> DataFrame:
    """One row per match: the columns of ``blobs`` but ``content``, and those of MATCH with the rule's.

    With ``context`` also ``before`` and ``after``: so many bytes on either side of the match.

    ``blobs`` has ``content`` (binary) and ``origins`` (array of structs with ``kind``).  Per rule,
    matches go from left to right and do not overlap; ``value`` is group 1 if it took part, else the
    whole match.  Values of too little entropy, placeholders, and spans inside or around an
    accepted one of the same rule are dropped.  Null content has no matches.  Columns of ``blobs`` named like one that a match adds give way to it.

    A rule that takes more than ``limit`` seconds on one content ends there; its matches so far stay.  With ``problems`` such cases are rows too, with
    the ``problem`` in words and neither span nor secret; without, there is no such column and no such row.
    """
    compiled(rules)  # reports every pattern that fails before any task runs
    coarse = may_match(rules, F.col("content"))
    if coarse is not None:
        blobs = blobs.where(coarse)
    kinds = F.get("origins", F.lit(0))["kind"]
    kind = F.when(kinds == "git_repo", "git").when(kinds == "extended", "ext").otherwise("file")
    found, one = f"_found_{uuid.uuid4().hex[:8]}", f"_match_{uuid.uuid4().hex[:8]}"
    added = {f.name for f in MATCH.fields} | set(_RULE) | {"validation_success", "validation_status", "validation_body"}
    around = [F.col(f"{one}.{c}") for c in ("before", "after")] if context is not None else []
    added |= {"before", "after"} if context is not None else set()
    own = [c for c in blobs.columns if c != "content" and c not in added]
    rows = blobs.withColumn(found, find(rules, compat_columns, limit)(F.col("content"), kind)).where(F.size(found) > 0)
    if context is None:
        matches = rows.select(*own, F.explode(found).alias(one)).select(*own, f"{one}.*")
    else:
        cut = F.transform(
            found,
            lambda m: F.struct(
                m.alias("m"),
                F.substring("content", (F.greatest(m["start"] - context, F.lit(0)) + 1).cast("int"), F.least(m["start"], F.lit(context)).cast("int")).alias("before"),
                F.substring("content", (m["end"] + 1).cast("int"), F.lit(context)).alias("after"),
            ),
        )
        matches = rows.withColumn(found, cut).select(*own, F.explode(found).alias(one)).select(*own, f"{one}.m.*", *around)
    if not problems:
        matches = matches.where("problem is null").drop("problem")
    known = rules_table(blobs.sparkSession, rules).select("rule_id", *_RULE)
    # the rule table is held in every task already; its size is that of the rule files
    return matches.join(F.broadcast(known), "rule_id").withColumns(
        {"validation_success": F.lit(False), "validation_status": F.lit(100), "validation_body": F.lit("")}
    )
