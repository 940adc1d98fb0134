"""Near-duplicate documents by SimHash with pigeonring filtering.

A text's fingerprint is the bitwise majority of the XXH64 hashes of its word
shingles.  Two fingerprints link when at most MAX_BITS (4) of 64 bits differ.

Candidates come from the pigeonring principle (Qin and Xiao, 2018).  The 64 bits
are cut into five segments on a ring.  If two fingerprints differ in at most four
bits, the differences d_0..d_4 of the segments have a start i for which every
chain of consecutive segments stays within its proportional budget:
d_i <= 4/5, d_i + d_{i+1} <= 8/5, and so on round the ring.  So segment i is equal
and segment i+1 differs in at most one bit.  That first link of the chain is the
join key; the rest of the chain is tested on each candidate before the full
Hamming distance.

Equal fingerprints are one class from the start, so copies never meet in a join.
A key shared by more than ``dense`` fingerprints is not joined with itself:
its members list the values within two bits (midpoints) and are linked to the least
member that shares a midpoint, which finds the same components without
enumerating pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import balanced_join, checkpoint, fresh_name, in_slices, split_join
from gleaner.llm.components import connected_components

#: Bits in which linked fingerprints may differ; the five segments below follow from it.
MAX_BITS = 4
WIDTHS = (13, 13, 13, 13, 12)
STARTS = (0, 13, 26, 39, 52)


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint; zero for null and for texts without a word."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    k = min(words, len(tokens))
    first, last = (ends - lengths)[: len(tokens) - k + 1], ends[k - 1 :]
    counts, total = np.zeros(64, np.int64), len(first)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, 1 << 15):
        spans = zip(first[at : at + (1 << 15)].tolist(), last[at : at + (1 << 15)].tolist(), strict=True)
        hashes = np.array([digest(joined[i:j], seed) for i, j in spans], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, text_hash, fp): one row per document, ``fp`` as a signed 64-bit integer."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in in_slices(batches, "text"):
            values = np.array([fingerprint(t, words) for t in rows["text"]], dtype=np.uint64)
            yield rows.drop(columns="text").assign(fp=values.view(np.int64))

    text = F.col(text_col).cast("string")
    spread = F.xxhash64(F.col(id_col).cast("long"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), spread.alias("spread"), text.alias("text"))
    return rows.mapInPandas(run, "id long, text_hash long, spread long, fp long")


def _segment(column, i: int):
    return F.shiftrightunsigned(column, STARTS[i]).bitwiseAND(F.lit((1 << WIDTHS[i]) - 1))


def _keys(fps: DataFrame) -> DataFrame:
    """(key, fp, probe): a row for the own key of each ring start, and one with each set bit
    of the second segment cleared.  A pair one bit apart there meets where the value that
    has the bit probes the value that lacks it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            signed = batch["fp"].to_numpy(np.int64)
            bits = signed.view(np.uint64)
            parts = []
            for i in range(5):
                j = (i + 1) % 5
                head = bits >> np.uint64(STARTS[i]) & np.uint64((1 << WIDTHS[i]) - 1)
                tail = bits >> np.uint64(STARTS[j]) & np.uint64((1 << WIDTHS[j]) - 1)
                own = (np.uint64(i << 26) + (head << np.uint64(13)) + tail).astype(np.int64)
                parts.append((own, signed, False))
                for bit in range(WIDTHS[j]):
                    has = (tail >> np.uint64(bit) & np.uint64(1)).astype(bool)
                    parts.append((own[has] - (1 << bit), signed[has], True))
            for key, fp, probe in parts:
                yield pd.DataFrame({"key": key, "fp": fp, "probe": probe})

    return fps.select("fp").mapInPandas(run, "key long, fp long, probe boolean")


def _chain_holds(a: str, b: str):
    """Whether some ring start keeps every chain within its budget (a superset of the result)."""
    diff = [F.bit_count(_segment(F.col(a), i).bitwiseXOR(_segment(F.col(b), i))) for i in range(5)]
    holds = F.lit(False)
    for i in range(5):
        chain, so_far = F.lit(True), F.lit(0)
        for k in range(5):
            so_far = so_far + diff[(i + k) % 5]
            chain = chain & (so_far * 5 <= (k + 1) * MAX_BITS)
        holds = holds | chain
    return holds


def _midpoint_masks() -> pd.DataFrame:
    """(seg, mask, near): for each ring start the masks of at most two bits (near: at most
    one) outside the two segments of its key.  A fixed table of 3,639 rows."""
    rows = []
    for i in range(5):
        fixed = {b for s in (i, (i + 1) % 5) for b in range(STARTS[s], STARTS[s] + WIDTHS[s])}
        free = [1 << b for b in range(64) if b not in fixed]
        rows += [(i, m, True) for m in (0, *free)] + [(i, x | y, False) for x, y in combinations(free, 2)]
    frame = pd.DataFrame(rows, columns=["seg", "mask", "near"])
    return frame.assign(seg=frame["seg"].astype("int32"), mask=np.array(frame["mask"].tolist(), np.uint64).view(np.int64))


def _dense_links(rows: DataFrame) -> DataFrame:
    """Links that connect, under each key, all that lies within four bits.

    A key's own members list the values within two bits outside the two fixed
    segments, probes (already one bit away) those within one.  Two that list the same
    value are at most four bits apart, and any two at most four apart (one of them
    not a probe) list a common one.  Each is linked to the least own member of the value.
    """
    masks = F.broadcast(rows.sparkSession.createDataFrame(_midpoint_masks()))
    own = rows.withColumn("seg", F.shiftright("key", 26).cast("int"))
    # the key fixes both of its segments, so they need not be cleared from the value
    apart = own.withColumn(
        "tail", F.col("key").bitwiseAND(F.lit((1 << 13) - 1))
    )
    value = F.lit(None).cast("long")
    for i in range(5):
        j = (i + 1) % 5
        keep = np.array([~(((1 << WIDTHS[j]) - 1) << STARTS[j]) & (2**64 - 1)], np.uint64).view(np.int64)[0].item()
        value = F.when(F.col("seg") == i, F.col("fp").bitwiseAND(F.lit(keep)).bitwiseOR(F.shiftleft("tail", STARTS[j]))).otherwise(value)
    spread = (
        apart.withColumn("value", value)
        .join(masks, "seg")
        .where("near or not probe")
        .select("key", "fp", "probe", F.col("value").bitwiseXOR(F.col("mask")).alias("mid"))
    )
    least = spread.where("not probe").groupBy("key", "mid").agg(F.min("fp").alias("other"))
    return spread.join(least, ["key", "mid"]).where("fp <> other").select("fp", "other")


def fingerprint_links(fps: DataFrame, dense: int = 64) -> DataFrame:
    """(fp, other): links whose components are those of all pairs within MAX_BITS bits."""
    keys = checkpoint(_keys(fps.select("fp")))
    sizes = keys.groupBy("key").agg(F.count("*").alias("n"), F.count_if(~F.col("probe")).alias("own"))
    live = split_join(keys, sizes.where("n > 1 and own > 0").withColumn("rows", F.col("n")), "key", "fp", "rows", keys.count())
    sparse = live.where(F.col("n") <= dense)
    left = sparse.where("not probe").select("key", F.col("fp").alias("x"))
    right = sparse.select("key", F.col("fp").alias("y"), "probe")
    pairs = (
        left.join(right, "key")
        .where("probe or x < y")
        .where(_chain_holds("x", "y"))
        .where(F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= MAX_BITS)
        .select(F.col("x").alias("fp"), F.col("y").alias("other"))
    )
    crowded = _dense_links(live.where(F.col("n") > dense).select("key", "fp", "probe"))
    return pairs.unionByName(crowded)


def _placed(docs: DataFrame, id_col: str, text_col: str, words: int, dense: int) -> DataFrame:
    """(id, text_hash, fp, component, component_id); ``component`` tells components apart even where ids do not."""
    prints = checkpoint(fingerprints(docs, id_col, text_col, words))
    classes = checkpoint(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("copies")))
    comps = connected_components(fingerprint_links(classes, dense=dense), "fp", "other")
    rooted = checkpoint(
        classes.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    )
    heads = checkpoint(rooted.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("rows")))
    placed = checkpoint(balanced_join(rooted, heads, ["component"], "fp", "rows").select("fp", "component", "component_id", "copies"))
    # a fingerprint or component may have a third of all rows
    return balanced_join(prints, placed, ["fp"], "spread", "copies")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, dense: int = 64
) -> DataFrame:
    """(id, fp, component_id): the documents' fingerprints and near-duplicate components.

    ``component_id`` is the smallest id reachable over links of at most four bits.
    Null texts and texts without words have fingerprint zero and link like any other;
    a row whose id is null keeps its row and takes the component's smallest id (null
    if no row of the component has one).  Repeated rows each give a row; an empty table gives an empty
    result.  Texts of any length are read whole; columns other than the two named play no part, whatever their names.
    ``dense`` decides how links are found, never which components they make.
    """
    return _placed(docs, id_col, text_col, words, dense).select("id", "fp", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one of each near-duplicate component, with the smallest id.

    Of several rows with that id the one whose text has the smallest hash stays; a row with a null
    id only where its component holds no id at all.  Repeated rows count once.  All columns of ``docs`` are kept, whatever their
    names; an empty table gives an empty result.
    """
    rows = _placed(docs, id_col, text_col, 4, 64).groupBy("component", "id", "text_hash").agg(F.count("*").alias("n"))
    order = F.struct(F.col("id").isNull(), "id", "text_hash")
    first = rows.groupBy("component").agg(F.min_by(F.struct("id", "text_hash", "n"), order).alias("kept"))
    key, digest, times = fresh_name("id"), fresh_name("hash"), fresh_name("n")
    kept = checkpoint(first.select(F.col("kept.id").alias(key), F.col("kept.text_hash").alias(digest), F.col("kept.n").alias(times)))
    here = F.col(id_col).cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(digest))
    once = docs.join(kept.where(F.col(times) == 1), here, "left_semi")
    repeated = docs.join(kept.where(F.col(times) > 1), here, "left_semi").dropDuplicates([id_col, text_col])
    return once.unionByName(repeated)
