"""Runs of periodic words by a suffix tree with smaller-half leaf lists (Stoye and Gusfield, 2002).

A run is a stretch of words that repeats itself with a period, at least twice, and that neither neighbour
extends.  In the suffix tree of a text a node v that spells D words stands for all places where these words occur.
A place i is a *branching tandem repeat* of v when i and i + D are both among the leaves of v and the word
after the repeat breaks the period.  One of the two places can always be sought among the leaves outside v's
largest child, so only those are walked: n log n in all.  Every run ends in the branching repeat of its
period; rotating that repeat to the left as far as the words agree gives the run, and repeats that give the same
stretch (multiples of a period) are merged into the one of the smallest period.

The tree is held as arrays: suffixes in order (by doubling of prefixes), the common prefixes of neighbours, and
its nodes as intervals of equal common prefixes.  Texts of a slice share one tree; their words
have numbers of their own, so no node holds two texts.  A run of 12 words or more holds each of its windows of six words
twice, and those windows cover it, so words under no repeated window are left out of the tree (``WINDOW``).

Documents are worked on where they lie: one narrow stage, no shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import in_slices

#: Runs have at least this many words, and hold each window of half as many twice.
LEAST = 12
WINDOW = LEAST // 2
#: (node, leaf) pairs looked at together, and bytes of a text numbered at once.
_PAIRS = 1 << 21
_PIECE = 1 << 20


def _ranks(x: np.ndarray) -> np.ndarray:
    """The rank of each value among the distinct values, from 0."""
    order = np.argsort(x, kind="stable")
    return _ranks_in(order, x[order])


def _ranks_in(order: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    out = np.empty(len(order), np.int32)
    out[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])), dtype=np.int32)
    return out


def prefix_ranks(words: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words, until all differ."""
    levels, width = [_ranks(words)], 1
    n = len(words)
    while n and levels[-1].max() < n - 1:
        now = levels[-1]
        after = np.zeros(n, np.int64)
        after[: max(0, n - width)] = now[width:] + 1
        levels.append(_ranks(now * np.int64(n + 1) + after))
        width *= 2
    return levels


def _agree(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words the suffixes at i and j (different places) share from their starts."""
    n, out = len(levels[0]), np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = i + out, j + out
        inside = (a < n) & (b < n)
        same = np.flatnonzero(inside)
        same = same[levels[k][a[same]] == levels[k][b[same]]]
        out[same] += 1 << k
    return out


def _agree_before(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words before i (which is the smaller) equal those before j."""
    out = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a = i - out - (1 << k)
        same = np.flatnonzero(a >= 0)
        same = same[levels[k][a[same]] == levels[k][j[same] - out[same] - (1 << k)]]
        out[same] += 1 << k
    return out


def _nearest_smaller(x: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value (x[0] is smaller than all others)."""
    at = np.arange(-1, len(x) - 1)
    left = np.arange(1, len(x))
    while len(left):
        left = left[x[at[left]] >= x[left]]
        at[left] = at[at[left]]
    at[0] = 0
    return at


def tree(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes in order, depth, low, high, big_low, big_high): the nodes with their intervals of suffixes (ends included)
    and those of their largest children."""
    rank = levels[-1]
    n = len(rank)
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    common = np.full(n + 1, -1, np.int64)  # common[t]: shared by the suffixes t - 1 and t in order
    common[1:n] = _agree(levels, order[:-1], order[1:])
    low = _nearest_smaller(common[:n])
    high = n - _nearest_smaller(common[1:][::-1])[::-1] - 1  # at t - 1: the suffix before the next smaller common prefix
    split = np.flatnonzero(common[:n] > 0)
    lo, hi = low[split], high[split - 1]
    key = lo * np.int64(n + 1) + hi
    by_node = np.argsort(key, kind="stable")
    split, lo, hi, key = split[by_node], lo[by_node], hi[by_node], key[by_node]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    if not len(first):
        none = np.zeros(0, np.int64)
        return order, none, none, none, none, none
    # children lie between the splits of a node: one begins at each split, and one before the first
    last = np.append(first[1:], len(key)) - 1
    stop = np.append(split[1:], 0) - 1
    stop[last] = hi[last]
    size, head = stop - split + 1, split[first] - lo[first]
    node = np.repeat(np.arange(len(first)), last - first + 1)
    most = np.maximum.reduceat(size, first)
    best = np.full(len(first), -1, np.int64)
    hit = np.flatnonzero(size == most[node])[::-1]
    best[node[hit]] = hit  # the first of the largest
    own = head > most
    big_low = np.where(own, lo[first], split[best])
    big_high = np.where(own, split[first] - 1, stop[best])
    return order, common[split[first]], lo[first], hi[first], big_low, big_high


def branching_repeats(words: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(start, half): all branching tandem repeats, each once."""
    order, depth, low, high, big_low, big_high = tree(levels)
    rank, n = levels[-1], len(words)
    padded = np.append(words, -1)
    small = (high - low) - (big_high - big_low)
    ends = np.cumsum(small)
    starts, halves = [], []
    at = 0
    while at < len(small):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS, side="right")))
        count = small[at:to]
        node = np.repeat(np.arange(at, to), count)
        nth = np.arange(len(node)) - np.repeat(ends[at:to] - count - (ends[at - 1] if at else 0), count)
        place = low[node] + nth
        place += np.where(place >= big_low[node], big_high[node] - big_low[node] + 1, 0)
        at = to
        i, d, lo, hi = order[place], depth[node], low[node], high[node]
        for begin, other in ((i, i + d), (i - d, i - d)):
            good = np.flatnonzero((begin >= 0) & (other < n))
            seen = rank[other[good]]
            good = good[(seen >= lo[good]) & (seen <= hi[good])]
            # the word after the repeat breaks its period; the end of the text does
            good = good[padded[begin[good] + d[good]] != padded[np.minimum(begin[good] + 2 * d[good], n)]]
            starts.append(begin[good])
            halves.append(d[good])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = np.unique(np.concatenate(starts) * np.int64(n + 1) + np.concatenate(halves))
    return key // (n + 1), key % (n + 1)


def runs(words: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of all runs of at least ``least`` words, by start, then period."""
    if len(words) < 2:
        return np.zeros((0, 3), np.int64)
    levels = prefix_ranks(words)
    start, half = branching_repeats(words, levels)
    begin = start - _agree_before(levels, start, start + half)
    stop = start + 2 * half
    order = np.lexsort((half, stop, begin))
    begin, stop, half = begin[order], stop[order], half[order]
    new = np.concatenate(([True], (begin[1:] != begin[:-1]) | (stop[1:] != stop[:-1]))) if len(begin) else np.zeros(0, bool)
    begin, stop, half = begin[new], stop[new], half[new]
    kept = stop - begin >= np.maximum(least, 2 * half)
    begin, stop, half = begin[kept], stop[kept], half[kept]
    order = np.lexsort((half, begin))
    return np.stack([begin, stop - begin, half], axis=1)[order]


def _under_repeats(words: np.ndarray) -> np.ndarray:
    """Which words lie in a window of ``WINDOW`` words that occurs more than once (or in one that hashes like another)."""
    n = len(words) - WINDOW + 1
    covered = np.zeros(len(words), bool)
    if n < 2:
        return covered
    mixed = words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    digest = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        digest = digest * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : k + n]
    ordered = np.sort(digest)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return covered
    at = np.searchsorted(twice, digest)
    again = np.flatnonzero(twice[np.minimum(at, len(twice) - 1)] == digest)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + WINDOW, -1)
    return np.cumsum(edge[:-1]) > 0


def runs_of_texts(words: np.ndarray, text: np.ndarray, texts: int) -> list[np.ndarray]:
    """The runs of each text; ``text`` numbers the texts of the words in ascending order, and equal words of two texts have different numbers."""
    kept = np.flatnonzero(_under_repeats(words))
    none = np.zeros((0, 3), np.int64)
    out = [none] * texts
    if not len(kept):
        return out
    # a word of its own between stretches, and at the end, so that nothing repeats across
    new = np.concatenate(([False], (np.diff(kept) > 1) | (text[kept][1:] != text[kept][:-1])))
    gaps = np.cumsum(new)
    size = len(kept) + gaps[-1] + 1
    place, joined = np.arange(len(kept)) + gaps, np.full(size, -1, np.int64)
    joined[place] = words[kept]
    apart = np.flatnonzero(joined < 0)
    joined[apart] = int(words.max()) + 1 + np.arange(len(apart))
    found = runs(joined)
    if not len(found):
        return out
    back = np.zeros(size, np.int64)
    back[place] = kept
    start = back[found[:, 0]]
    own, first = text[start], np.searchsorted(text, np.arange(texts))
    found[:, 0] = start - first[own]
    edges = np.searchsorted(own, np.arange(texts + 1))
    for k in np.unique(own):
        out[k] = found[edges[k] : edges[k + 1]]
    return out


class Numbered:
    """The words of a text as numbers: ``ids``, and each number's ``words``."""

    def __init__(self, text: str | None) -> None:
        raw, known, parts, at = (text or "").encode("utf-8", "replace"), {}, [], 0
        while at < len(raw):
            to = at + _PIECE
            while to < len(raw) and raw[to] not in b" \t\n\v\f\r":
                to += 1
            piece = raw[at:to].split()
            parts.append(np.fromiter((known.setdefault(w, len(known)) for w in piece), np.int32, len(piece)))
            at = to
        self.ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        self.words = list(known)

    def repeat_tail(self, begin: int, period: int) -> None:
        """From ``begin`` on the first ``period`` words there, over and over."""
        self.ids[begin:] = np.resize(self.ids[begin : begin + period], len(self.ids) - begin)

    def digest(self, kept: np.ndarray | None) -> str:
        """SHA-256 of the words (those ``kept``), joined by single spaces."""
        ids, sha = self.ids if kept is None else self.ids[kept], hashlib.sha256()
        for at in range(0, len(ids), 1 << 17):
            sha.update((b" " if at else b"") + b" ".join([self.words[i] for i in ids[at : at + (1 << 17)].tolist()]))
        return sha.hexdigest()


def collapsed(found: np.ndarray, n: int) -> np.ndarray | None:
    """Which of the n words stay: those that no run holds after its first period; None for all."""
    if not len(found):
        return None
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 0] + found[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tail: str | None = None) -> DataFrame:
    """(id, n_words, runs, collapsed_sha256): the runs of every text by start, then period.

    Words are what stands between blanks (space and the five ASCII control characters for white space).  A run is a stretch of
    consecutive words with smallest period q, of at least 12 and at least 2 q words, that no neighbour extends.
    ``collapsed_sha256`` is of the words, joined by single spaces, that no run holds after its first q words (lowercase hex, UTF-8).
    ``tail`` names a column of structs (begin, period), or null: from that word on a text's words are replaced by
    the first ``period`` of them over and over, as far as it has such words, before runs are sought.

    Null, empty and blank texts have no words and no runs (empty array, hash of nothing).  Each row is judged by itself, so repeated rows
    and null ids give rows like any other; texts of any length are read whole; an empty table gives an empty result.  Columns
    other than those named play no part, whatever their names.  Of runs that share a start the shorter period comes first.
    A task holds one slice of texts, or one longer text: about 250 bytes for each word under a repeated window.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in in_slices(batches, "text", 2 << 20):
            texts = [Numbered(t) for t in rows["text"]]
            for t, begin, period in zip(texts, rows["begin"], rows["period"], strict=True):
                if begin >= 0 and period > 0 and begin < len(t.ids):
                    t.repeat_tail(int(begin), int(period))
            sizes = [len(t.ids) for t in texts]
            before = np.cumsum([0, *(len(t.words) for t in texts)])
            joined = np.concatenate([t.ids.astype(np.int64) + b for t, b in zip(texts, before, strict=False)])
            found = runs_of_texts(joined, np.repeat(np.arange(len(texts)), sizes), len(texts))
            yield pd.DataFrame(
                {
                    "id": rows["id"], "n_words": sizes,
                    "runs": [[dict(zip(("start", "length", "period"), r, strict=True)) for r in f.tolist()] for f in found],
                    "collapsed_sha256": [t.digest(collapsed(f, n)) for t, f, n in zip(texts, found, sizes, strict=True)],
                }
            )

    change = F.col(tail) if tail else F.lit(None).cast("struct<begin:long,period:long>")
    lacks = F.lit(-1).cast("long")
    return docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
        F.coalesce(change["begin"].cast("long"), lacks).alias("begin"), F.coalesce(change["period"].cast("long"), lacks).alias("period"),
    ).mapInPandas(run, f"id long, n_words long, runs {_RUNS}, collapsed_sha256 string")


def longest(found: DataFrame) -> DataFrame:
    """(id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of what ``periodic_runs`` gives.

    The four numbers are of the longest run (ties: smallest start, then period), null without runs; ``runs_sha256`` is
    of every run as ``start,length,period`` and a line feed.
    """
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("_best", best).select(
        "id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"), (-F.col("_best.n")).alias("length"), F.col("_best.period").alias("period"),
        F.expr("1000 * (-_best.n) div _best.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), "collapsed_sha256",
    )
