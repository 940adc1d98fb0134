"""Document fingerprints by a quartile bucket digest, after Oliver, Cheng and Chen (TLSH, 2013).

A window of five bytes slides over a text; its first byte and each two of the others make six triplets,
and each is hashed to one of 256 buckets.  A bucket's code is 0 to 3 by the quartiles of all counts, so the digest
does not grow with the text and small edits move few codes.  The length in bytes is told in steps of a quarter octave.
Digests are compared by a bounded score: a price for each bucket by how far its codes are apart, and one for
the lengths, over the mean price of unrelated codes; at that or more the likeness is 0, for equal digests 1.

``edited_chain`` needs each document's follower.  Documents are dealt out by ranges of (id, hash of the text), one
shuffle of the texts, with the first row of each range copied to the end of the one before.  Ranges come from a bounded sample
of keys; a range is read in order, so a task holds two texts at a time.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from gleaner.llm.common import checkpoint

BUCKETS = 256
#: The triplets of a window of five bytes, each with its first.
TRIPLETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
_FIRST, _SECOND, _THIRD, _SALT, _MIX = 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x2C1B3C6D
#: Price of codes so far apart; of each step between lengths, up to ``FARTHEST`` steps.
PRICE = (0, 1, 2, 6)
STEP, FARTHEST = 8, 15
#: The mean price of codes drawn at random.
BOUND = BUCKETS * (6 * PRICE[1] + 4 * PRICE[2] + 2 * PRICE[3]) // 16
#: Lengths at which the code of the length goes up: 4, 5, 6, 7, 8, 10, 12, 14, 16, ...
LENGTHS = [f << e for e in range(38) for f in (4, 5, 6, 7)]
_AT_ONCE = 1 << 19
#: Ranges for each shuffle partition, and keys sampled for each range.
_RANGES, _KEYS = 4, 16


def bucket_counts(raw: bytes, settled: int = 0) -> np.ndarray:
    """Counts of the hashed triplets of ``raw`` that end at byte ``settled`` or later."""
    x, counts = np.frombuffer(raw, np.uint8), np.zeros(BUCKETS, np.int64)
    for at in range(settled, len(x), _AT_ONCE):
        part = x[max(0, at - 4) : at + _AT_ONCE].astype(np.uint32)
        ahead = at - max(0, at - 4)
        first = part * np.uint32(_FIRST)
        second, third = part * np.uint32(_SECOND), part * np.uint32(_THIRD)
        for i, (b, c) in enumerate(TRIPLETS):
            begin = max(0, ahead - c)
            n = len(part) - c - begin
            if n <= 0:
                continue
            h = first[begin : begin + n] + second[begin + b : begin + b + n]
            h += third[begin + c : begin + c + n]
            h += np.uint32(i * _SALT & 0xFFFFFFFF)
            h ^= h >> np.uint32(15)
            h *= np.uint32(_MIX)
            h ^= h >> np.uint32(13)
            counts += np.bincount(h & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    return counts


def codes(counts: np.ndarray) -> np.ndarray:
    """The code of each bucket: how many of the three quartiles its count exceeds."""
    ordered = np.sort(counts)
    quartiles = ordered[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    return (counts[:, None] > quartiles).sum(axis=1).astype(np.uint8)


def digest(counts: np.ndarray, size: int) -> str:
    """Two hex digits for the length, then one for each two buckets."""
    own = codes(counts)
    return f"{bisect_right(LENGTHS, size):02x}" + "".join("0123456789abcdef"[v] for v in own[::2] * 4 + own[1::2])


def fingerprint(text: str | None) -> str:
    raw = (text or "").encode("utf-8", "replace")
    return digest(bucket_counts(raw), len(raw))


def likeness_of(a: str, b: str) -> float:
    """From 0 (as far apart as unrelated digests, or farther) to 1 (equal)."""
    if a == b:
        return 1.0
    x, y = (np.array([int(c, 16) for c in d[2:]], np.int64) for d in (a, b))
    price = np.array(PRICE)
    far = price[np.abs(x // 4 - y // 4)].sum() + price[np.abs(x % 4 - y % 4)].sum()
    far += STEP * min(FARTHEST, abs(int(a[:2], 16) - int(b[:2], 16)))
    return 1 - min(int(far), BOUND) / BOUND


def likeness(a: Column, b: Column) -> Column:
    """The likeness of two columns of fingerprints (null where one is null)."""

    @pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            yield pd.Series([None if x is None or y is None else likeness_of(x, y) for x, y in zip(left, right, strict=True)], dtype="float64")

    return run(a, b)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, fingerprint): one row per document, in one narrow stage.

    Null counts as the empty text, whose codes are all zero.  Equal texts have equal fingerprints.  Texts are read whole; repeated rows and
    null ids give rows like any other; an empty table gives an empty result; other columns play no part, whatever their names.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = [(t or "").encode("utf-8", "replace") for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "n_bytes": [len(r) for r in raw], "fingerprint": [digest(bucket_counts(r), len(r)) for r in raw]})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, "id long, n_bytes long, fingerprint string")


class _Document:
    """A document that waits for its follower: its text, its fingerprint, and the counts of the part that stays."""

    def __init__(self, doc_id: int | None, text: str | None, part: float) -> None:
        self.id, self.text = doc_id, text or ""
        self.taken = int(len(self.text) * part)
        raw = self.text.encode("utf-8", "replace")
        self.stays = self.text[: len(self.text) - self.taken].encode("utf-8", "replace")
        self.counts = bucket_counts(self.stays)
        self.fingerprint = digest(self.counts + bucket_counts(raw, len(self.stays)), len(raw))

    def followed_by(self, other: _Document) -> tuple:
        edited = self.stays + other.text[: self.taken].encode("utf-8", "replace")
        changed = digest(self.counts + bucket_counts(edited, len(self.stays)), len(edited))
        return (
            self.id, len(self.text), hashlib.sha256(edited).hexdigest(), self.fingerprint, changed,
            likeness_of(self.fingerprint, changed), likeness_of(self.fingerprint, other.fingerprint),
        )


_CHAIN = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_chain(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: float = 0.25) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    The edited text is the text with its last ``part`` of the code points (rounded down) replaced by the first as many, or all, of the next
    document, in ascending order of ids; after the last comes the first, and a lone document follows itself.
    ``near_edited`` is the likeness of the fingerprint to the edited text's, ``near_next`` to the next document's.

    Null counts as the empty text.  Rows without an id come first; rows of one id follow each other by the hash
    of their texts, and repeated rows follow each other, each giving a row.  Texts are read whole; an empty table gives an empty
    result; other columns play no part, whatever their names.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    keys = checkpoint(rows.select("id", "hash"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = partitions * _RANGES
    # borders of the ranges only; every row is dealt out by them.  About so many keys, each once, whatever the number of rows
    every = max(1, keys.count() // (ranges * _KEYS))
    sample = keys.where(F.pmod(F.xxhash64("id", "hash"), F.lit(every)) == 0).distinct().collect() or keys.limit(1).collect()
    if not sample:
        return spark.createDataFrame([], _CHAIN)
    ordered = sorted({(r["id"] is not None, r["id"] or 0, r["hash"]) for r in sample})
    bounds = [ordered[i] for i in sorted({len(ordered) * k // ranges for k in range(1, ranges)} - {0})]

    def place(ids: pd.Series, hashes: pd.Series) -> list[tuple]:
        known = [(not pd.isna(i), 0 if pd.isna(i) else int(i), int(h)) for i, h in zip(ids, hashes, strict=True)]
        return [(bisect_right(bounds, k), k) for k in known]

    @pandas_udf("int")
    def range_of(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series([at for at, _ in place(ids.astype("Int64"), hashes)], dtype="int32")

    lowest = keys.groupBy(range_of("id", "hash").alias("range")).agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), F.coalesce("id", F.lit(0)).alias("id"), "hash")).alias("k"))
    firsts = sorted((r["range"], tuple(r["k"])) for r in lowest.collect())  # at most one row for each range
    #: The first key of a range, and the range before it, where a copy of that row goes.
    before = {key: firsts[i - 1][0] for i, (_, key) in enumerate(firsts)}

    @pandas_udf("array<struct<range:int,border:boolean>>")
    def places(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(
            [[{"range": at, "border": False}, *([{"range": before[k], "border": True}] if k in before else [])] for at, k in place(ids.astype("Int64"), hashes)],
            dtype=object,
        )

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, own, names = None, None, [c.split(" ")[0] for c in _CHAIN.split(", ")]
        for batch in batches:
            out = []
            for at, border, doc_id, text in zip(batch["range"], batch["border"], batch["id"].astype("Int64"), batch["text"], strict=True):
                if at != own:
                    waiting, own = None, at
                elif waiting is None:
                    continue  # a further copy of the row behind the border
                now = _Document(None if pd.isna(doc_id) else int(doc_id), text, part)
                if waiting is not None:
                    out.append(waiting.followed_by(now))
                waiting = None if border else now
            if out:
                yield pd.DataFrame(out, columns=names).astype({"id": "Int64"})

    dealt = rows.select("id", "text", "hash", F.inline(places("id", "hash")))
    return dealt.repartition(partitions, "range").sortWithinPartitions("range", "border", "id", "hash").select("range", "border", "id", "text").mapInPandas(chain, _CHAIN)


def oracle() -> str:
    """The same in SQL: bytes as rows, triplets by self-made windows, quartiles from sorted counts."""
    lengths = ", ".join(map(str, LENGTHS))
    grams = "\n      UNION ALL ".join(
        f"SELECT id, kind, (x0 * {_FIRST} + x{b} * {_SECOND} + x{c} * {_THIRD} + {i * _SALT & 0xFFFFFFFF}) & 4294967295 AS h FROM windows WHERE x{c} IS NOT NULL"
        for i, (b, c) in enumerate(TRIPLETS)
    )
    price = f"list_sum(list_transform(range(1, {BUCKETS + 1}), lambda i: [{', '.join(map(str, PRICE))}][abs({{a}}.codes[i] - {{b}}.codes[i]) + 1]))"

    def near(a: str, b: str) -> str:
        return f"1 - least({price.format(a=a, b=b)} + {STEP} * least({FARTHEST}, abs({a}.size - {b}.size)), {BOUND}) / {BOUND}"

    def shown(a: str) -> str:
        pairs = f"list_transform(range(0, {BUCKETS // 2}), lambda i: format('{{:x}}', {a}.codes[2 * i + 1] * 4 + {a}.codes[2 * i + 2]))"
        return f"format('{{:02x}}', {a}.size) || array_to_string({pairs}, '')"

    return f"""
    WITH chained AS (
      SELECT doc_id AS id, coalesce(text, '') AS text,
        coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS following,
        coalesce(lead(doc_id) OVER (ORDER BY doc_id), first_value(doc_id) OVER (ORDER BY doc_id)) AS following_id
      FROM documents
    ), texts AS (
      SELECT id, 0 AS kind, text FROM chained
      UNION ALL SELECT id, 1, left(text, length(text) - length(text) // 4) || left(following, length(text) // 4) FROM chained
    ), octets AS (
      SELECT id, kind, unnest(regexp_extract_all(hex(encode(text)), '..')) AS x, generate_subscripts(regexp_extract_all(hex(encode(text)), '..'), 1) AS pos FROM texts
    ), numbers AS (
      SELECT id, kind, pos, CAST('0x' || x AS UBIGINT) AS x0 FROM octets
    ), windows AS (
      SELECT id, kind, x0, {', '.join(f'lead(x0, {k}) OVER w AS x{k}' for k in range(1, 5))} FROM numbers WINDOW w AS (PARTITION BY id, kind ORDER BY pos)
    ), grams AS (
      {grams}
    ), mixed AS (
      SELECT id, kind, (xor(h, h >> 15) * {_MIX}) & 4294967295 AS h FROM grams
    ), counted AS (
      SELECT id, kind, CAST(xor(h, h >> 13) & {BUCKETS - 1} AS INTEGER) AS bucket, count(*) AS n FROM mixed GROUP BY ALL
    ), filled AS (
      SELECT t.id, t.kind, map_from_entries(list((bucket, n)) FILTER (n IS NOT NULL)) AS m FROM texts t LEFT JOIN counted c ON t.id = c.id AND t.kind = c.kind GROUP BY ALL
    ), counts AS (
      SELECT id, kind, list_transform(range(0, {BUCKETS}), lambda b: coalesce(m[CAST(b AS INTEGER)], 0)) AS n FROM filled
    ), sorted AS (
      SELECT id, kind, n, list_sort(n) AS s FROM counts
    ), digests AS (
      SELECT s.id, s.kind, list_transform(n, lambda c: CAST(c > s[{BUCKETS // 4}] AS INTEGER) + CAST(c > s[{BUCKETS // 2}] AS INTEGER) + CAST(c > s[{3 * BUCKETS // 4}] AS INTEGER)) AS codes,
        len(list_filter([{lengths}], lambda l: l <= strlen(t.text))) AS size
      FROM sorted s JOIN texts t ON s.id = t.id AND s.kind = t.kind
    )
    SELECT c.id AS doc_id, length(c.text) AS n_chars, sha256(left(c.text, length(c.text) - length(c.text) // 4) || left(c.following, length(c.text) // 4)) AS edited_sha256,
      {shown('a')} AS fingerprint, {shown('e')} AS edited_fingerprint, {near('a', 'e')} AS near_edited, {near('a', 'f')} AS near_next
    FROM chained c JOIN digests a ON a.id = c.id AND a.kind = 0 JOIN digests e ON e.id = c.id AND e.kind = 1 JOIN digests f ON f.id = c.following_id AND f.kind = 0
    """
