"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its nearest reference points in order of cosine (the prefix of its
permutation of all of them), after the mean of a sample is taken from it, as vectors of a model often share a direction that
tells nothing.  Reference points are taken far apart from each other, from a
bounded sample; their number grows with the square root of the rows, which keeps lists short.  How long prefixes are, and how
many pivots candidates share, is found on the sample: partners at just the threshold are made of its vectors, and the cheapest
setting that finds nearly all of them is used.
Inverted lists name, for each label and pivot, the vectors that have it in their prefix.  Two
vectors are candidates if their prefixes share ``shared`` pivots; only candidates are verified, by
cosine in double precision.

With the pivots in one order, rare ones first, two prefixes of m pivots that share t of them share one among
the first m - t + 1 of each.  So a vector is posted under those only, and a pair belongs to the list of the
first pivot it shares.  There the pivots that come later are counted through inverted lists within the list: the work is
in proportion to the pivots that pairs do share, and pairs that share none are never formed.

A list longer than a block is solved in blocks: every pair of blocks is a group of bounded size, from which only
counts and a spanning forest leave, so a list that holds a third of all rows costs time but neither memory nor
rows.  Equal vectors of a label are one class from the start.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import balanced_join, checkpoint
from gleaner.llm.components import connected_components
from gleaner.llm.knn import finite, matrix


#: Reference points have at most this cosine, so that a crowd of near copies gets few of them.
APART = 0.8
#: Shared pivots counted, and pairs verified, at once.
_AT_ONCE = 1 << 20


def _units(x: np.ndarray) -> np.ndarray:
    scaled = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)  # keeps squares within range
    return scaled / np.maximum(np.linalg.norm(scaled, axis=1, keepdims=True), 1e-300)


def reference_points(x: np.ndarray, count: int) -> np.ndarray:
    """At most ``count`` rows of unit vectors, each in turn the farthest from those before (none within ``APART`` of them)."""
    chosen = [0]
    near = x @ x[0]
    while len(chosen) < min(count, len(x)):
        nxt = int(near.argmin())
        if near[nxt] > APART:
            break
        chosen.append(nxt)
        near = np.maximum(near, x @ x[nxt])
    return x[chosen]


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while (up := parent.setdefault(v, v)) != v:
            parent[v] = v = parent.setdefault(up, up)
        return v

    out = []
    for v, w in zip(a.tolist(), b.tolist(), strict=True):
        v, w = root(v), root(w)
        if v != w:
            parent[max(v, w)] = min(v, w)
            out.append((v, w))
    return out


#: Settings from the cheapest on: pivots of a prefix, those that candidates share, and whether the mean is taken away first.
SETTINGS = (*((n, 3, True) for n in range(10, 25, 2)), *((n, 3, False) for n in range(10, 25, 2)), (24, 2, True), (24, 1, True))
#: Share of the partners made of the sample that the setting finds at least.
FOUND = 0.985
#: With more reference points than this, the others are not sought far apart, and are looked up through their nearest of these.
_FIRST = 2048


@dataclass
class Index:
    """Reference points in order (rare ones first), the length of a prefix, the pivots that candidates share, and what is taken from vectors first.

    ``cells``, where there are very many reference points: (centres, the numbers of the reference points nearest to each).
    """

    pivots: np.ndarray
    prefix: int
    shared: int
    mean: np.ndarray
    cells: tuple[np.ndarray, list[np.ndarray]] | None = None

    def describe(self, x: np.ndarray) -> np.ndarray:
        """The pivots of the prefix of each unit vector, in the order of the index."""
        x = _units(x - self.mean)
        if self.cells is None:
            near = np.argpartition(-(x @ self.pivots.T), self.prefix - 1, axis=1)[:, : self.prefix]
            return np.sort(near, axis=1).astype(np.int32)
        # the reference points of as many centres as hold several prefixes
        centres, members = self.cells
        order = np.argsort(-(x @ centres.T), axis=1)
        out = np.empty((len(x), self.prefix), np.int32)
        for i, near in enumerate(order):
            seen, count = [], 0
            for c in near:
                seen.append(members[c])
                count += len(members[c])
                if count >= 16 * self.prefix:
                    break
            among = np.concatenate(seen)
            out[i] = np.sort(among[np.argpartition(-(self.pivots[among] @ x[i]), self.prefix - 1)[: self.prefix]])
        return out

    @property
    def posted(self) -> int:
        """How many pivots of a prefix a vector is posted under."""
        return self.prefix - self.shared + 1


def _partners(x: np.ndarray, cosine: float) -> np.ndarray:
    """For each unit vector another at this cosine, in a direction of its own; the same every time."""
    away = np.random.default_rng(7).normal(size=x.shape)
    away -= (away * x).sum(axis=1, keepdims=True) * x
    size = np.linalg.norm(away, axis=1, keepdims=True)
    return cosine * x + (1 - cosine**2) ** 0.5 * np.divide(away, size, out=np.zeros_like(away), where=size > 0)


def _referenced(x: np.ndarray, count: int, centred: bool) -> Index:
    """Reference points among the unit vectors ``x``, with a prefix of one so far."""
    mean = x.mean(axis=0) if centred else np.zeros(x.shape[1])
    bare = x - mean
    bare = bare[np.linalg.norm(bare, axis=1) > 1e-6]  # what is the mean has no direction left
    if not len(bare):
        return Index(x[:1], 1, 1, np.zeros(x.shape[1]))
    bare = _units(bare)
    pivots, cells = reference_points(bare[: 4 * _FIRST], min(count, _FIRST)), None
    if count > _FIRST and len(pivots) == _FIRST and len(bare) > _FIRST:
        more = bare[-(count - _FIRST) :]
        pivots = np.concatenate([pivots, more[(more @ pivots.T).max(axis=1) <= APART]])
        centres = pivots[: int(len(pivots) ** 0.5)]
        own = (pivots @ centres.T).argmax(axis=1)
        cells = (centres, [np.flatnonzero(own == c) for c in range(len(centres))])
    return Index(pivots, 1, 1, mean, cells)


def fit_index(x: np.ndarray, count: int, nearest: int | None = None, shared: int | None = None, cosine: float = 0.93) -> Index:
    """An index with at most ``count`` reference points among the unit vectors ``x``.

    Without ``nearest`` and ``shared`` the cheapest of ``SETTINGS`` that finds ``FOUND`` of the partners at ``cosine``; where none
    does, one reference point, under which all vectors of a label are compared.
    """
    made = {centred: _referenced(x, count, centred) for centred in (True, False)}
    if nearest is not None or shared is not None:
        index = _set(made[True], nearest or 10, shared or 3)
    else:
        partners, index = _partners(x[:2000], cosine), None
        for n, t, centred in SETTINGS:
            tried = _set(made[centred], n, t)
            a, b = tried.describe(x[:2000]), tried.describe(partners)
            common = sum((a[:, :, None] == b[:, None, k : k + 1])[:, :, 0].sum(axis=1) for k in range(b.shape[1]))
            if (common >= tried.shared).mean() >= FOUND:
                index = tried
                break
        index = index or Index(x[:1], 1, 1, np.zeros(x.shape[1]))
    often = np.bincount(index.describe(x).ravel(), minlength=len(index.pivots))
    order = np.argsort(often, kind="stable")
    if index.cells is not None:
        place = np.argsort(order)
        index = replace(index, cells=(index.cells[0], [place[m] for m in index.cells[1]]))
    return replace(index, pivots=index.pivots[order])


def _set(index: Index, nearest: int, shared: int) -> Index:
    # with few reference points a prefix holds much of them, and sharing some says little but costs nothing
    prefix = min(nearest, len(index.pivots))
    return replace(index, prefix=prefix, shared=min(shared, prefix))


def candidates(index: Index, group: np.ndarray, pivot: np.ndarray, near: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of ``left``, row of ``right``) of the same group that share enough pivots, the first of them that of the group.

    ``group``, ``pivot`` and ``near`` are of all rows; the numbers of shared pivots are added up over the inverted lists of the group.
    """
    later = near > pivot[:, None]
    size, n = len(index.pivots), len(group)

    def postings(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        who, at = np.nonzero(later[rows])
        return rows[who], group[rows[who]] * size + near[rows[who], at]

    def first_shared(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        same = (near[i][:, :, None] == near[j][:, None, :]) & ~later[i][:, :, None] & (near[i] != pivot[i][:, None])[:, :, None]
        return ~same.any(axis=(1, 2))

    if index.shared == 1:
        # the group's own pivot is enough
        postings = lambda rows: (rows, group[rows])
    row, key = postings(left)
    other, other_key = postings(right)
    order = np.argsort(other_key, kind="stable")
    other, other_key = other[order], other_key[order]
    begin, stop = np.searchsorted(other_key, key, side="left"), np.searchsorted(other_key, key, side="right")
    length = stop - begin
    total = np.cumsum(length)
    at = 0
    while at < len(row):
        # whole rows, about ``_AT_ONCE`` shared pivots
        end = int(np.searchsorted(total, (total[at - 1] if at else 0) + _AT_ONCE, side="right"))
        end = max(end, at + 1)
        end = int(np.searchsorted(row, row[end - 1], side="right")) if end < len(row) else end
        size_of = length[at:end]
        i = np.repeat(row[at:end], size_of)
        j = other[np.repeat(begin[at:end] - np.concatenate(([0], np.cumsum(size_of)[:-1])), size_of) + np.arange(size_of.sum())]
        at = end
        pair, times = np.unique(i.astype(np.int64) * n + j, return_counts=True)
        pair = pair[times >= max(1, index.shared - 1)]
        for k in range(0, len(pair), 1 << 17):
            i, j = np.divmod(pair[k : k + (1 << 17)], n)
            good = first_shared(i, j)
            yield i[good], j[good]


def _compare(index: Index, threshold: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows of groups (label, pivot, a, b), which come one after another, to (x, y, n): links of x by number (y = -1),
    a link x to y, or the number of pairs verified (y = -2)."""

    def solve(part: pd.DataFrame, begins: np.ndarray) -> pd.DataFrame:
        x, near = _units(np.stack(part["v"].to_list()).astype(float)), np.stack(part["near"].to_list())
        cid, copies, pivot = part["cid"].to_numpy(), part["copies"].to_numpy(), part["pivot"].to_numpy()
        own, a, b = (part[c].to_numpy() for c in ("own", "a", "b"))
        group = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(part))))
        counts, links, verified = np.zeros(len(part)), [], 0
        for i, j in candidates(index, group, pivot, near, np.flatnonzero(own == a), np.flatnonzero(own == b)):
            once = (own[i] != own[j]) | (cid[i] < cid[j])
            i, j = i[once], j[once]
            verified += len(i)
            linked = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
            i, j = i[linked], j[linked]
            counts += np.bincount(i, weights=copies[j], minlength=len(part)) + np.bincount(j, weights=copies[i], minlength=len(part))
            links += _forest(cid[i], cid[j])
        hit = np.flatnonzero(counts)
        forest = _forest(*np.array(links, np.int64).reshape(-1, 2).T) if links else []
        out = [(-1, -2, verified), *zip(cid[hit].tolist(), [-1] * len(hit), counts[hit].astype(np.int64).tolist(), strict=True), *((v, w, 0) for v, w in forest)]
        return pd.DataFrame(out, columns=["x", "y", "n"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            part = batch if held is None else pd.concat([held, batch], ignore_index=True)
            keys = part[["label", "pivot", "a", "b"]]
            begins = np.flatnonzero((keys != keys.shift()).any(axis=1).to_numpy())
            held = part.iloc[begins[-1] :]  # the last group may go on
            if len(begins) > 1:
                yield solve(part.iloc[: begins[-1]], begins[:-1])
        if held is not None and len(held):
            yield solve(held, np.zeros(1, np.int64))

    return run


def _found(
    classes: DataFrame, kind: str, threshold: float, nearest: int | None, shared: int | None, sampled: int, max_pivots: int, block: int
) -> DataFrame | None:
    """What ``_compare`` finds among the classes (cid, label, v, copies); None without any."""
    total, width = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    if not total:
        return None
    count = min(max_pivots, max(128, int(8 * total**0.5)))
    picked = classes.orderBy(F.xxhash64("label", "v")).limit(min(sampled, 4 * count)).select("v").toPandas()
    index = fit_index(_units(matrix(picked["v"], width)), count, nearest, shared, threshold)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = matrix(batch["v"], width)
            yield batch.assign(v=list(x), near=list(index.describe(_units(x))))

    indexed = classes.select("label", "cid", "copies", "v").mapInPandas(describe, f"label string, cid long, copies long, v {kind}, near array<int>")
    posted = checkpoint(indexed).select("*", F.explode(F.slice("near", 1, index.posted)).alias("pivot"))
    # lists of more than ``block`` rows are cut into blocks.  The lists of more than a quarter of a partition's share are fewer than
    # four times the shuffle partitions, as their rows add up to no more than all, and are broadcast; the others are joined by key, which is even
    partitions = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(block, total * index.posted // (4 * partitions))
    blocks = F.floor(F.col("rows") / block + 1).cast("int").alias("blocks")
    sizes = posted.groupBy("label", "pivot").agg(F.count("*").alias("rows")).where(F.col("rows") > block)
    crowded = F.broadcast(sizes.where(F.col("rows") > share).select("label", "pivot", blocks))
    placed = posted.join(crowded, ["label", "pivot"], "left")
    if share > block:
        rest = placed.where("blocks is null").drop("blocks").join(sizes.where(F.col("rows") <= share).select("label", "pivot", blocks), ["label", "pivot"], "left")
        placed = placed.where("blocks is not null").unionByName(rest)
    placed = placed.withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    spread = (
        placed.withColumn("own", F.pmod(F.xxhash64("cid"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other")).drop("blocks", "other")
    )
    groups = spread.repartition("label", "pivot", "a", "b").sortWithinPartitions("label", "pivot", "a", "b")
    return checkpoint(groups.mapInPandas(_compare(index, threshold), "x long, y long, n long"))


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    nearest: int | None = None, shared: int | None = None, sampled: int = 65_536, max_pivots: int = 16_384, block: int = 1500, exact: bool = False,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Rows link when their labels are equal and not null and their cosine reaches
    ``threshold``.  Null and zero vectors, and vectors with null or non-finite
    components, link with nothing; of unequal lengths the shorter vector counts as filled up
    with zeros.  Repeated rows link with each other like any others.  A row without links is
    its own component and kept; ``component_id`` is null only where the ids are.
    An empty table gives an empty result; other columns play no part, whatever their names.
    The pivots are fitted on at most ``sampled`` vectors (four times as many as there are pivots); every vector is indexed.  ``nearest`` pivots describe a
    vector and candidates share ``shared``, found on the sample where they are not given.  ``exact`` compares all vectors of a label, in blocks: nothing is
    missed, at a cost that grows with the square of the label.
    """
    if exact:
        nearest, shared, max_pivots = 1, 1, 1
    kind = vectors.schema[vec_col].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"  # single precision travels as such
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(kind).alias("v"), F.col(label_col).cast("string").alias("label")
    ).withColumn("valid", finite(F.col("v")) & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull())
    rows = rows.withColumn("valid", F.coalesce("valid", F.lit(False)))
    alone = rows.where("not valid").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
    )
    classes = rows.where("valid").groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = checkpoint(classes.withColumn("cid", F.monotonically_increasing_id()))
    found = _found(classes, kind, threshold, nearest, shared, sampled, max_pivots, block)
    if found is None:
        return alone
    linked = found.where("y = -1").groupBy(F.col("x").alias("cid")).agg(F.sum("n").alias("linked"))
    comps = connected_components(found.where("y >= 0"), "x", "y").withColumnRenamed("node", "cid")
    placed = (
        classes.select("cid", "label", "v", "least", "copies").join(linked, "cid", "left").join(comps, "cid", "left")
        .withColumn("component", F.coalesce("component", "cid"))
    )
    placed = checkpoint(placed)
    heads = checkpoint(placed.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("rows")))
    placed = balanced_join(placed, heads, ["component"], "cid", "rows").select(
        "label", "v", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id", "copies"
    )
    out = balanced_join(rows.where("valid"), checkpoint(placed), ["label", "v"], "vec_id", "copies").select(
        "vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    )
    return out.unionByName(alone)
