"""Best-fit packing of documents into fixed-length training sequences.

Pattern packing by non-negative least squares (after Krell et al., 2021): the
histogram of piece lengths is all that packing needs to know.  Patterns of up to
three lengths that fill a sequence exactly are enumerated, their repeat counts are
fitted to the histogram by non-negative least squares, rounded down, and what is
left over is packed best-fit decreasing, again on counts.  The histogram and the plan
have at most a few thousand entries whatever the size of the corpus; pieces find
their place by their rank among the pieces of equal length.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import checkpoint, in_slices

#: The pre-tokenizing pattern of the byte-level vocabulary (a fixed value of its format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK = 1 << 20
_CUT = re.compile(r" (?=\S)")


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies (the installed package knows)."""
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteBpe:
    """Ids of a byte-level BPE vocabulary, as little-endian 32-bit bytes.

    They are the ids that the ``tokenizers`` library gives for the vocabulary's JSON file without added
    special tokens: the strings of its special tokens are single ids also within a text, and what stands between
    them is encoded by itself (by tiktoken, which is faster and has the same merges).  The pattern always
    ends a token before a space that is followed by something other than white space, so very
    long stretches are encoded in blocks cut there; no block cuts a special string.
    """

    def __init__(self, json_path: str) -> None:
        import tiktoken

        with open(json_path, encoding="utf-8") as file:
            saved = json.load(file)
        special = {t["content"]: t["id"] for t in saved["added_tokens"]}
        plain = _byte_values()
        ranks = {bytes(map(plain.__getitem__, piece)): i for piece, i in saved["model"]["vocab"].items() if piece not in special}
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        #: How many ids there are, special ones included, and how many bytes each stands for.
        self.size = len(ranks) + len(special)
        self.lengths = np.zeros(self.size, np.int64)
        for piece, i in ranks.items():
            self.lengths[i] = len(piece)
        for piece, i in special.items():
            self.lengths[i] = len(piece.encode("utf-8"))
        self.special = {s: np.array([i], "<u4").tobytes() for s, i in special.items()}
        self.between = re.compile(f"({'|'.join(map(re.escape, sorted(special, key=len, reverse=True)))})") if special else None

    def __call__(self, text: str) -> bytes:
        if self.between is None or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(self.special[part] if k % 2 else self._plain(part) for k, part in enumerate(self.between.split(text)))

    def _plain(self, text: str) -> bytes:
        parts, at = [], 0
        while len(text) - at > BLOCK and (cut := _CUT.search(text, at + BLOCK)):
            parts.append(text[at : cut.start()])
            at = cut.start()
        parts.append(text[at:] if at else text)
        return b"".join(np.array(self.encode(x), dtype="<u4").tobytes() for x in parts)


def _byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for
    themselves, the others in order for the characters from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def byte_bpe(json_path: str) -> ByteBpe:
    return ByteBpe(json_path)


def pieces(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024,
    end_id: int = 2, with_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): every document's ids and ``end_id``.

    Only documents of more than ``capacity`` tokens are cut, the first piece being the
    short one.  A null text is an empty one: its only piece is the end id.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = byte_bpe(path), np.array([end_id], "<u4").tobytes()
        for rows in in_slices(batches, "text"):
            out: dict[str, list] = {k: [] for k in ("row", "piece", "start", "length", "ids_crc32", "ids")}
            for row, text in enumerate(rows["text"]):
                ids = memoryview(encode(text or "") + end)
                total = len(ids) // 4
                at, size, k = 0, total % capacity or capacity, 0
                while at < total:
                    part = ids[4 * at : 4 * (at + size)]
                    out["row"].append(row)
                    out["piece"].append(k)
                    out["start"].append(at)
                    out["length"].append(size)
                    out["ids_crc32"].append(zlib.crc32(part))
                    if with_ids:
                        out["ids"].append(np.frombuffer(part, "<i4"))
                    at, size, k = at + size, capacity, k + 1
            ids_column = {"ids": out.pop("ids")} if with_ids else (out.pop("ids"), {})[1]
            row = out.pop("row")
            yield pd.DataFrame({"doc_id": rows["doc_id"].take(row).reset_index(drop=True), **out, **ids_column})

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInPandas(
        run, schema
    )


def _patterns(present: np.ndarray, capacity: int) -> np.ndarray:
    """(n, 3) lengths a >= b >= c, 0 for none, of up to three present lengths that add up to ``capacity``."""
    there = np.zeros(capacity + 1, bool)
    there[present] = True
    there[0] = True
    a, b = np.meshgrid(present, np.append(present, 0), indexing="ij")
    c = capacity - a - b
    keep = (c >= 0) & (c <= b) & (b <= a)
    a, b, c = a[keep], b[keep], c[keep]
    keep = there[c]
    return np.stack([a[keep], b[keep], c[keep]], axis=1)


def _fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative repeat counts x minimising |A x - counts|: accelerated projected gradient."""
    flat, size = patterns.ravel(), len(counts)

    def apply(x: np.ndarray) -> np.ndarray:
        y = np.bincount(flat, weights=np.repeat(x, 3), minlength=size)
        y[0] = 0
        return y

    def adjoint(r: np.ndarray) -> np.ndarray:
        return r[patterns].sum(axis=1)

    x = np.ones(len(patterns))
    for _ in range(20):
        x = adjoint(apply(x))
        x /= (norm := np.linalg.norm(x))
    step, x = 1 / (1.05 * norm), np.zeros(len(patterns))
    y, t = x, 1.0
    goal = counts.copy()
    goal[0] = 0
    for _ in range(rounds):
        new = np.maximum(0, y - step * adjoint(apply(y) - goal))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if ((y - new) * (new - x)).sum() > 0:  # restart when momentum points uphill
            t_new, y = 1.0, new
        else:
            y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def _best_fit(counts: np.ndarray, capacity: int) -> dict[tuple[int, ...], int]:
    """Best-fit decreasing on counts of lengths: pattern -> number of sequences."""
    free: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    room = np.zeros(capacity + 1, np.int64)

    def add(left: int, pattern: tuple[int, ...], n: int) -> None:
        free[left][pattern] = free[left].get(pattern, 0) + n
        room[left] += n

    for length in range(capacity, 0, -1):
        todo = int(counts[length])
        while todo:
            fits = np.flatnonzero(room[length:])
            if not len(fits):
                each = capacity // length
                if todo >= each:
                    add(capacity - each * length, (length,) * each, todo // each)
                if todo % each:
                    add(capacity - todo % each * length, (length,) * (todo % each), 1)
                break
            left = length + int(fits[0])
            pattern, there = free[left].popitem()
            n = min(there, todo)
            room[left] -= there
            if there > n:
                add(left, pattern, there - n)
            add(left - length, (*pattern, length), n)
            todo -= n
    out: dict[tuple[int, ...], int] = defaultdict(int)
    for groups in free.values():
        for pattern, n in groups.items():
            out[pattern] += n
    return out


def plan(counts: np.ndarray, capacity: int) -> dict[tuple[int, ...], int]:
    """Patterns of lengths and how many sequences have each; covers ``counts`` exactly."""
    counts = counts.astype(np.int64).copy()
    out: dict[tuple[int, ...], int] = defaultdict(int)
    if counts[capacity]:
        out[(capacity,)] = int(counts[capacity])
        counts[capacity] = 0
    for _ in range(2):  # the second fit works on what rounding the first has left
        present = np.flatnonzero(counts)
        patterns = _patterns(present, capacity) if len(present) else np.zeros((0, 3), np.int64)
        if not len(patterns):
            break
        repeats = np.floor(_fit(patterns, counts.astype(float)) + 1e-6).astype(np.int64)
        for i in np.argsort(-repeats, kind="stable"):
            pattern = [int(v) for v in patterns[i] if v]
            need = {v: pattern.count(v) for v in pattern}
            n = min(int(repeats[i]), *(int(counts[v]) // k for v, k in need.items()))
            if n <= 0:
                if not repeats[i]:
                    break
                continue
            out[tuple(pattern)] += n
            for v, k in need.items():
                counts[v] -= n * k
    for pattern, n in _best_fit(counts, capacity).items():
        out[pattern] += n
    return out


def _slots(planned: dict[tuple[int, ...], int], capacity: int) -> tuple[np.ndarray, ...]:
    """The plan by length: for slot groups in order of length, the rank (within the length) at
    which each starts, the sequence of its first piece and its offset; ``begin`` finds a length."""
    by: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    base = 0
    for pattern, n in sorted(planned.items()):
        offset = 0
        for length in pattern:
            by[length].append((n, base, offset))
            offset += length
        base += n
    begin, rank, first, offsets = np.zeros(capacity + 2, np.int64), [], [], []
    for length in range(capacity + 1):
        so_far = 0
        for n, sequence, offset in by.get(length, ()):
            rank.append(so_far)
            first.append(sequence)
            offsets.append(offset)
            so_far += n
        begin[length + 1] = len(rank)
    return begin, np.array(rank, np.int64), np.array(first, np.int64), np.array(offsets, np.int64)


def pack(
    docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024,
    end_id: int = 2, with_ids: bool = False, max_groups: int = 50_000,
) -> DataFrame:
    """Every piece with its place: the columns of ``pieces``, sequence_id and offset.

    Sequences are gapless from offset 0 and hold at most ``capacity`` tokens.
    Repeated rows are packed each for itself; null ids and other columns, whatever their names, play no
    part; an empty table gives an empty result.  Texts of any length are encoded whole, in bounded blocks.  ``max_groups`` bounds the table of counts
    that the driver reads to number the pieces of each length.
    """
    path = path or tokenizer_path("byte_bpe_50k.json")
    cut = pieces(docs, path, id_col, text_col, capacity, end_id, with_ids)
    cut = checkpoint(cut.withColumn("uid", F.monotonically_increasing_id()))
    spark = docs.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for row in cut.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["n"]
    begin, rank, first, offsets = _slots(plan(counts, capacity), capacity)

    each = max(2000, int(counts.sum()) // max_groups)
    salts = spark.createDataFrame(
        [(int(v), int(counts[v]) // each + 1) for v in np.flatnonzero(counts)], "length long, salts long"
    )
    salted = cut.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("uid"), "salts"))
    sizes = sorted(map(tuple, salted.groupBy("length", "salt").agg(F.count("*")).collect()))
    before, seen = [], (None, 0)
    for length, salt, n in sizes:
        so_far = seen[1] if seen[0] == length else 0
        before.append((length, salt, so_far))
        seen = (length, so_far + n)
    earlier = F.broadcast(spark.createDataFrame(before, "length long, salt long, earlier long"))
    order = Window.partitionBy("length", "salt").orderBy("uid")
    ranked = salted.withColumn("nth", F.row_number().over(order)).join(earlier, ["length", "salt"])
    ranked = ranked.select(*cut.columns, (F.col("earlier") + F.col("nth") - 1).alias("rank")).drop("uid")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # ranks of all lengths in one ascending array: length * 2^42 + rank
        keys = np.repeat(np.arange(capacity + 1), np.diff(begin)) * (1 << 42) + rank
        for rows in batches:
            nth = rows["rank"].to_numpy(np.int64)
            at = np.searchsorted(keys, rows["length"].to_numpy(np.int64) * (1 << 42) + nth, side="right") - 1
            yield rows.drop(columns="rank").assign(sequence_id=first[at] + nth - rank[at], offset=offsets[at])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInPandas(place, f"{kinds}, sequence_id long, offset long")
