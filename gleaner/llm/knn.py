"""Exact top-k inner products by a Voronoi kNN join.

Pivots (centres of a bounded sample, about the square root of the rows in number) cut the data into Voronoi
cells, and each cell into rings by the angle to its pivot.  A row s is told by its part along the pivot's
direction u, a = s.u, and the length r of the rest; a summary of each ring holds the range of a,
the largest r and the number of rows.  For a query q the scores in a ring are at most
q.u a + |q - (q.u) u| r.

1. Cells near each other form bundles of bounded size, and queries groups.  Every query is first solved in the bundle
   of its own cell; the k-th best score there is a floor.
2. The rings whose ceiling for some query of a group reaches that query's floor are replicated to the group, the
   others are not.  Within a group and bundle the cells are solved one after another, each for the queries whose ceiling
   there still reaches their floor, which rises as better scores are found.
3. The best of both steps are kept.

The result is exact whatever the data; summaries and floors only decide how much is replicated and compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from gleaner.llm.common import checkpoint

#: Integers up to this are exact in double precision.
EXACT = 2.0**53
_AT_ONCE = 256
#: Rings of a cell, by the sine of the angle to its pivot.
RINGS = 4


def finite(vector: Column) -> Column:
    """Whether the vector is not null and all its components are finite numbers."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & ~odd, F.lit(False))


def matrix(vectors: pd.Series | list, width: int) -> np.ndarray:
    """Rows of doubles; shorter vectors are filled up with zeros."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """At most k k-means centres of the rows of x, the same every time."""
    c = x[np.unique(np.linspace(0, len(x) - 1, k).astype(int))]
    for _ in range(rounds):
        own = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        c = np.stack([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
    return c


@dataclass
class Cells:
    """Pivots, their directions (zero for a zero pivot) and the rings' summaries, in arrays of cells by rings."""

    pivots: np.ndarray
    size: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rest: np.ndarray

    @property
    def width(self) -> int:
        return self.pivots.shape[1]

    @property
    def directions(self) -> np.ndarray:
        return self.pivots / np.maximum(np.linalg.norm(self.pivots, axis=1, keepdims=True), 1e-300)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(cell, ring, a, r) of each row."""
        cell = ((self.pivots**2).sum(1) - 2 * x @ self.pivots.T).argmin(1)
        along = np.einsum("ij,ij->i", x, self.directions[cell])
        square = (x**2).sum(1)
        rest = np.sqrt(np.maximum(square - along**2, 0))
        ring = np.minimum(RINGS * rest / np.maximum(np.sqrt(square), 1e-300), RINGS - 1).astype(int)
        return cell, ring, along, rest

    def ceilings(self, queries: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores of each query in each ring of some cells; minus infinity for empty rings."""
        along = queries @ self.directions[cells].T
        square = (queries**2).sum(1)
        rest = np.sqrt(np.maximum(square[:, None] - along**2, 0))
        best = np.maximum(along[:, :, None] * self.low[cells], along[:, :, None] * self.high[cells])
        longest = np.abs(self.high).max() + np.abs(self.low).max() + self.rest.max()
        # rounding errors of bounds and summaries are far below this
        slack = 1e-6 * (1 + np.sqrt(square) * (1 + longest))
        bound = best + rest[:, :, None] * self.rest[cells] + slack[:, None, None]
        return np.where(self.size[cells] > 0, bound, -np.inf)


def _ranked(who: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each ``who``: highest score first, ties to the smaller id."""
    order = np.lexsort((ids, -scores if scores.dtype != object else np.argsort(np.argsort(-scores, kind="stable")), who))
    if scores.dtype == object:
        order = np.array(sorted(range(len(who)), key=lambda i: (who[i], -scores[i], ids[i])), int)
    own = who[order]
    begin = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, int)
    nth = np.arange(len(own)) - np.repeat(begin, np.diff(np.append(begin, len(own))))
    return order[nth < k]


def _solve(queries: pd.DataFrame, data: pd.DataFrame, cells: Cells, k: int) -> pd.DataFrame:
    """(quid, query_id, vec_id, score): for each query its k best among the data, as far as they reach its floor; and
    one row without ids whose score is the number of pairs compared."""
    out, compared = [], 0
    queries = queries[queries["home"] != queries["bundle"]]
    if len(queries) and len(data):
        data = data.sort_values("cell", kind="stable")
        x, ids, uids = matrix(data["v"], cells.width), data["vec_id"].to_numpy(), data["uid"].to_numpy()
        there, begin = np.unique(data["cell"].to_numpy(), return_index=True)
        spans = list(zip(begin, [*begin[1:], len(data)], strict=True))
        wide = np.abs(x).sum(1).max()
        for at in range(0, len(queries), _AT_ONCE):
            part = queries.iloc[at : at + _AT_ONCE]
            q, quid = matrix(part["qv"], cells.width), part["quid"].to_numpy()
            exact = wide * np.abs(q).max() < EXACT
            ceiling = cells.ceilings(q, there).max(axis=2)
            # best scores so far, the lowest first; what is below the floor counts for nothing
            best = np.full((len(q), k), -np.inf, None if exact else object)
            floor = part["floor"].to_numpy(float)
            who, score, row = [], [], []
            for c in np.argsort(-ceiling.max(axis=0), kind="stable"):
                need = np.flatnonzero(ceiling[:, c] >= np.maximum(floor, best[:, 0].astype(float)))
                lo, hi = spans[c]
                if not len(need):
                    continue
                if exact:
                    s = q[need] @ x[lo:hi].T
                else:  # beyond double precision: integers without bound
                    s = np.array([[int(v) for v in r] for r in q[need]], object) @ np.array([[int(v) for v in r] for r in x[lo:hi]], object).T
                s[quid[need][:, None] == uids[None, lo:hi]] = -np.inf
                compared += s.size
                both = np.concatenate([best[need], s], axis=1)
                best[need] = (np.partition(both, -k, axis=1) if exact else np.sort(both, axis=1))[:, -k:]
                best[need] = np.sort(best[need], axis=1)
                least = best[need][:, :1]
                i, j = np.nonzero((s >= least) & (s > -np.inf))
                who.append(need[i])
                score.append(s[i, j])
                row.append(lo + j)
                if sum(map(len, who)) > 1 << 20:
                    who, score, row = ([v] for v in _kept(who, score, row, ids, k))
            if who:
                w, s, r = _kept(who, score, row, ids, k)
                out.append(pd.DataFrame({"quid": quid[w], "query_id": part["query_id"].to_numpy()[w], "vec_id": ids[r], "score": [int(v) for v in s]}))
    out.append(pd.DataFrame({"quid": [-1], "query_id": [None], "vec_id": [None], "score": [compared]}))
    return pd.concat([o.astype({"query_id": "Int64", "vec_id": "Int64"}) for o in out])


def _kept(who: list, score: list, row: list, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w, s, r = np.concatenate(who), np.concatenate(score), np.concatenate(row)
    good = _ranked(w, s, ids[r], k)
    return w[good], s[good], r[good]


_ANSWER = "quid long, query_id long, vec_id long, score long"


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "v",
    sampled: int = 8192, block: int = 8192, group: int = 4096, max_cells: int = 4096,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of ``vectors`` with the highest inner products with each query.

    Vectors hold integers (as numbers of any type); scores are exact, and must fit 64 bits.
    Every row but the query's own is a candidate, repeated rows included; ties go to
    the smaller id.  Null and empty vectors, and vectors with null or non-finite components, take no part;
    of vectors of unequal lengths the shorter counts as filled up with zeros.  Fewer
    candidates than k give fewer rows, an empty table none; columns other than the named play no part.  The cells are
    fitted on at most ``sampled`` rows; no others are left out of anything else.
    """
    solved = answers(vectors, is_query, k, id_col, vec_col, sampled, block, group, max_cells)
    if solved is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("quid").orderBy(F.desc("score"), "vec_id")
    ranked = solved.where("quid >= 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def answers(
    vectors: DataFrame, is_query: Column, k: int, id_col: str, vec_col: str, sampled: int, block: int, group: int, max_cells: int
) -> DataFrame | None:
    """(quid, query_id, vec_id, score): the best of each query (by number) in each bundle, and in rows with the
    number -1 how many pairs were compared; None without vectors."""
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"), is_query.alias("query")
    ).where(finite(F.col("v")) & (F.size("v") > 0))
    rows = checkpoint(rows.withColumn("uid", F.monotonically_increasing_id()))
    total, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not total:
        return None
    count = min(max_cells, max(2, int(total**0.5)))
    picked = rows.orderBy(F.xxhash64("uid")).limit(min(sampled, 8 * count)).toPandas()
    pivots = centres(matrix(picked["v"], width), count)
    shape = (len(pivots), RINGS)
    cells = Cells(pivots, np.zeros(shape, np.int64), np.zeros(shape), np.zeros(shape), np.zeros(shape))

    @pandas_udf("cell int, ring int, along double, rest double")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for vs in batches:
            yield pd.DataFrame(dict(zip(("cell", "ring", "along", "rest"), cells.place(matrix(vs, width)), strict=True)))

    placed = checkpoint(rows.withColumn("at", place("v")).select("*", "at.*").drop("at"))
    summary = placed.groupBy("cell", "ring").agg(F.count("*"), F.min("along"), F.max("along"), F.max("rest"), F.count_if("query"))
    asked = np.zeros(len(pivots), np.int64)
    for r in summary.collect():  # at most ``max_cells`` by ``RINGS`` rows
        at = (r["cell"], r["ring"])
        cells.size[at], cells.low[at], cells.high[at], cells.rest[at] = r[2:6]
        asked[r["cell"]] += r[6]
    size = cells.size.sum(axis=1)

    # cells in a walk from neighbour to neighbour; bundles of about ``block`` rows, groups of about ``group`` queries
    walk, left = [0], np.ones(len(pivots), bool)
    left[0] = False
    while left.any():
        away = np.where(left, ((pivots - pivots[walk[-1]]) ** 2).sum(axis=1), np.inf)
        walk.append(int(away.argmin()))
        left[walk[-1]] = False
    walk = np.array(walk)
    bundle, team = np.zeros(len(pivots), np.int64), np.zeros(len(pivots), np.int64)
    bundle[walk] = (np.cumsum(size[walk]) - size[walk]) // block
    team[walk] = (np.cumsum(asked[walk]) - asked[walk]) // group
    in_bundle, in_team = np.bincount(bundle, weights=size), np.bincount(team, weights=asked)
    asked_in = np.bincount(bundle, weights=asked)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = max(1000, int(total) // (2 * partitions))
    known = [
        (j, int(bundle[j]), max(1, round(in_bundle[bundle[j]] / block)), int(size[j]) // share + 1, int(team[j]),
         int(in_team[team[j]]) // group + 1, int(asked_in[bundle[j]]) // group + 1)
        for j in range(len(pivots))
    ]
    # one row for each cell, at most ``max_cells``
    table = F.broadcast(spark.createDataFrame(known, "cell int, bundle long, parts long, salts long, team long, teams long, owns long"))
    placed = placed.join(table, "cell")
    number = lambda kind, key, n: F.struct(F.lit(kind).alias("kind"), F.col(key).alias("key"), F.pmod(F.xxhash64("uid"), n).alias("split"))
    queries = placed.where("query").select(
        "uid", "vec_id", "v", "cell", number(0, "bundle", F.col("owns")).alias("own"), number(1, "team", F.col("teams")).alias("grp"), F.col("bundle").alias("home")
    )

    def solve(asks: DataFrame, wanted: DataFrame) -> DataFrame:
        """``asks``: queries with grp, floor and the bundle they are done with; ``wanted``: (grp, cell, rings) with the rings as bits."""
        wanted = checkpoint(wanted.join(table, "cell"))
        parts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
        places = wanted.select("grp", "bundle", "parts").distinct().select("grp", "bundle", parts)
        left = asks.join(places, "grp").select("grp", "bundle", "part", F.col("uid").alias("quid"), F.col("vec_id").alias("query_id"), F.col("v").alias("qv"), "floor", "home")
        salted = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).select("grp", "cell", "rings", "salt")
        right = (
            placed.withColumn("salt", F.pmod(F.xxhash64("uid", F.lit(1)), "salts")).join(salted, ["cell", "salt"])
            .where(F.expr("shiftright(rings, ring) & 1") == 1)
            .select(F.col("grp").alias("g"), F.col("bundle").alias("b"), F.pmod(F.xxhash64("uid"), "parts").alias("p"), "uid", "vec_id", "v", "cell")
        )
        return left.groupBy("grp", "bundle", "part").cogroup(right.groupBy("g", "b", "p")).applyInPandas(lambda a, b: _solve(a, b, cells, k), _ANSWER)

    # the bundle of a query's own cell
    homes = queries.select(F.col("own").alias("grp"), F.col("home").alias("bundle")).distinct()
    all_cells = homes.join(F.broadcast(spark.createDataFrame([(int(b), j) for j, b in enumerate(bundle)], "bundle long, cell int")), "bundle")
    at_home = queries.select(F.col("own").alias("grp"), "uid", "vec_id", "v", F.lit(float("-inf")).alias("floor"), F.lit(-1).cast("long").alias("home"))
    first = checkpoint(solve(at_home, all_cells.select("grp", "cell", F.lit((1 << RINGS) - 1).alias("rings"))))
    # at most parts times k answers of each query; of more than k the k-th best counts
    floors = first.where("quid >= 0").groupBy(F.col("quid").alias("uid")).agg(F.sort_array(F.collect_list("score"), asc=False).alias("best"))
    floors = floors.select("uid", F.coalesce(F.get("best", F.lit(k - 1)).cast("double"), F.lit(float("-inf"))).alias("floor"))
    asks = checkpoint(queries.join(floors, "uid", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))))

    def needs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = np.arange(len(pivots))
        for batch in batches:
            teams: dict[tuple, np.ndarray] = {}
            for at in range(0, len(batch), _AT_ONCE):
                rows = batch.iloc[at : at + _AT_ONCE]
                reach = cells.ceilings(matrix(rows["v"], width), every) >= rows["floor"].to_numpy()[:, None, None]
                reach &= bundle[None, :, None] != rows["home"].to_numpy()[:, None, None]
                rings = (reach * (1 << np.arange(RINGS))).sum(axis=2)
                for i, g in enumerate(rows["grp"]):
                    key = (g["kind"], g["key"], g["split"])
                    teams[key] = teams.get(key, 0) | rings[i]
            for key, rings in teams.items():
                cell = np.flatnonzero(rings)
                if not len(cell):
                    continue
                grp = [dict(zip(("kind", "key", "split"), key, strict=True))] * len(cell)
                yield pd.DataFrame({"grp": grp, "cell": cell, "rings": rings[cell]})

    kind = "grp struct<kind:int,key:bigint,split:bigint>, cell int, rings int"
    wanted = asks.select("grp", "v", "floor", "home").mapInPandas(needs, kind).groupBy("grp", "cell").agg(F.bit_or("rings").alias("rings"))
    return first.unionByName(solve(asks, wanted))
