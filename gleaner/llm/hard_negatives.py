"""Hard negatives by a pivot table over vectors augmented for inner products.

A row x gets one more component, sqrt(M^2 - |x|^2) with M the largest length, and an anchor q is stretched to length M and gets a
zero; then |q' - x'|^2 = 2 M^2 - 2 (M / |q|) q.x, so the highest inner product is the nearest neighbour (Bachrach et al., 2014).
The pivot table holds the distance of every row to a few pivots, which lie far apart.  By the triangle
inequality |d(q,p) - d(x,p)| <= d(q,x) <= d(q,p) + d(x,p) for every pivot p, which brackets each score.  Only pairs whose
bracket meets what is sought are computed exactly.

1. Positives: the rows of a label meet its anchors.  The k-th highest lower end of the brackets is a floor; a row whose upper end
   is below it is left out.
2. Negatives: rows lie in cells by their nearest pivot, told by the ranges of their distances to all pivots.  A cell goes to a team
   of anchors only if its bracket meets the band of scores that some anchor of the team seeks; within, brackets of single rows decide.

The result is exact whatever the data; brackets only decide what is sent and computed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from gleaner.llm.common import checkpoint
from gleaner.llm.knn import EXACT, finite, matrix

#: Anchors and rows of one tile of scores.
_ANCHORS, _ROWS = 256, 4096
#: Rows of the table of teams and cells up to which it is broadcast; a larger one is joined by shuffling.
_SMALL = 100_000


@dataclass
class PivotTable:
    """Pivots in the augmented space, and the largest length of all rows."""

    pivots: np.ndarray
    longest: float

    @property
    def width(self) -> int:
        return self.pivots.shape[1] - 1

    def rows(self, x: np.ndarray) -> np.ndarray:
        """Distances of rows to the pivots."""
        return _distances(augmented(x, self.longest), self.pivots)

    def anchors(self, q: np.ndarray) -> np.ndarray:
        """Distances of anchors, stretched to the largest length."""
        size = np.linalg.norm(q, axis=1, keepdims=True)
        stretched = q * np.divide(self.longest, size, out=np.zeros_like(size), where=size > 0)
        return _distances(np.hstack([stretched, np.zeros((len(q), 1))]), self.pivots)

    def brackets(self, size: np.ndarray, far: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and most that the scores of anchors of these lengths and distances can be, for rows (or cells) whose distances are from ``low`` to ``high``."""
        shape, m = (len(far), len(low)), self.longest
        near, away = np.zeros(shape), np.full(shape, 2 * m)
        for j in range(far.shape[1]):
            f = far[:, j, None]
            np.maximum(near, np.maximum(low[None, :, j] - f, f - high[None, :, j]), out=near)
            np.minimum(away, f + high[None, :, j], out=away)
        scale = (size / m if m else size)[:, None]
        slack = 1e-9 * (1 + size[:, None] * m)  # far above the rounding errors
        return scale * (m * m - away**2 / 2) - slack, scale * (m * m - near**2 / 2) + slack


def augmented(x: np.ndarray, longest: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(longest**2 - (x**2).sum(axis=1, keepdims=True), 0))])


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def pivot_table(x: np.ndarray, count: int, longest: float) -> PivotTable:
    """At most ``count`` of the rows ``x`` as pivots, each in turn the farthest from those before."""
    x = augmented(x, longest)
    chosen = [0]
    near = ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < count and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return PivotTable(x[chosen], longest)


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of integers: in double precision where that is exact, else with whole numbers of any size."""
    if not len(q) or not len(x) or np.abs(q).max() * np.abs(x).sum(axis=1).max() < EXACT:
        return q @ x.T
    whole = lambda a: np.array([[int(v) for v in r] for r in a], object)
    return whole(q) @ whole(x).T


def _ordered(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Highest score first, ties by smaller id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i])), int)
    return np.lexsort((ids, -scores))


def _tiles(table: PivotTable, asks: pd.DataFrame, data: pd.DataFrame, wanted):
    """(ask number, row numbers, scores) of each anchor and stretch of rows whose brackets pass ``wanted``; and in the end (-1, number of pairs computed, None)."""
    x, far = matrix(data["v"], table.width), np.stack(data["far"].to_list())
    q, own = matrix(asks["qv"], table.width), np.stack(asks["qfar"].to_list())
    size, computed = np.linalg.norm(q, axis=1), 0
    for a in range(0, len(q), _ANCHORS):
        one = slice(a, a + _ANCHORS)
        for b in range(0, len(x), _ROWS):
            two = slice(b, b + _ROWS)
            kept = wanted(one, two, *table.brackets(size[one], own[one], far[two], far[two]))
            some = np.flatnonzero(kept.any(axis=1))
            if not len(some):
                continue
            rows = np.flatnonzero(kept[some].any(axis=0))
            scores = _scores(q[one][some], x[two][rows])
            for i, s in zip(some, scores, strict=True):
                good = kept[i][rows]
                computed += int(good.sum())
                yield a + i, b + rows[good], s[good]
    yield -1, computed, None


def _positives(table: PivotTable, asks: pd.DataFrame, data: pd.DataFrame, k: int) -> pd.DataFrame:
    """(quid, vec_id, score): for each anchor its k best of the rows of its label, and a row with quid -1 and the number of pairs computed."""
    out, label, same = [], data["label"].to_numpy(), asks["qlabel"].to_numpy()
    uid, quid, ids = data["uid"].to_numpy(), asks["quid"].to_numpy(), data["vec_id"].to_numpy()
    best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    # floors so far: what k rows are sure to reach
    floor = np.full(len(asks), -np.inf)

    def wanted(one: slice, two: slice, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        own = (same[one, None] == label[None, two]) & (quid[one, None] != uid[None, two])
        sure = np.where(own, low, -np.inf)
        if sure.shape[1] >= k:
            floor[one] = np.maximum(floor[one], np.partition(sure, -k, axis=1)[:, -k])
        return own & (high >= floor[one, None])

    if len(asks) and len(data):
        for i, rows, scores in _tiles(table, asks, data, wanted):
            if i < 0:
                out.append((-1, None, rows))
                continue
            if i in best:
                rows, scores = np.concatenate([best[i][0], rows]), np.concatenate([best[i][1], scores])
            first = _ordered(scores, ids[rows])[:k]
            best[i] = rows[first], scores[first]
    for i, (rows, scores) in best.items():
        out += [(int(quid[i]), int(v), int(s)) for v, s in zip(ids[rows], scores, strict=True)]
    return pd.DataFrame(out, columns=["quid", "vec_id", "score"]).astype({"quid": "int64", "vec_id": "Int64", "score": "int64"})


def _least(score: int, low: int, of: int) -> int:
    """The least integer s with of * s >= low * score."""
    return -((-low * score) // of)


def _negatives(table: PivotTable, asks: pd.DataFrame, data: pd.DataFrame, k: int, low: int, high: int, of: int) -> pd.DataFrame:
    """(quid, nth, vec_id, score): for each anchor and positive the k best rows of other labels within the band, and a row with the number of pairs computed."""
    out, label, same = [], data["label"].to_numpy(), asks["qlabel"].to_numpy()
    quid, ids = asks["quid"].to_numpy(), data["vec_id"].to_numpy()
    bands = [[(_least(int(s), low, of), (high * int(s)) // of) for s in p] for p in asks["scores"]]
    bottom, top = (np.array([f(b[j] for b in band) for band in bands], float) for j, f in ((0, min), (1, max)))
    best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def wanted(one: slice, two: slice, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        return (same[one, None] != label[None, two]) & (most >= bottom[one, None]) & (least <= top[one, None])

    if len(asks) and len(data):
        for i, rows, scores in _tiles(table, asks, data, wanted):
            if i < 0:
                out.append((-1, 0, None, rows))
                continue
            for nth, (least, most) in enumerate(bands[i]):
                inside = np.flatnonzero((scores >= least) & (scores <= most))
                if not len(inside):
                    continue
                r, s = rows[inside], scores[inside]
                if (i, nth) in best:
                    r, s = np.concatenate([best[i, nth][0], r]), np.concatenate([best[i, nth][1], s])
                first = _ordered(s, ids[r])[:k]
                best[i, nth] = r[first], s[first]
    for (i, nth), (rows, scores) in best.items():
        out += [(int(quid[i]), nth, int(v), int(s)) for v, s in zip(ids[rows], scores, strict=True)]
    return pd.DataFrame(out, columns=["quid", "nth", "vec_id", "score"]).astype({"quid": "int64", "nth": "int32", "vec_id": "Int64", "score": "int64"})


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vec_col: str = "v", label_col: str = "label",
    positives: int = 5, negatives: int = 5, band: tuple[int, int, int] = (80, 100, 100),
    pivots: int = 24, sampled: int = 2048, block: int = 16384, group: int = 8192,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Vectors hold integers (as numbers of any type); a score is the inner product with the anchor, exact, and must fit 64 bits.
    An anchor's positives are its best ``positives`` other rows of the same label.  For each of them come the best ``negatives`` rows
    of other labels with low * positive <= of * negative <= high * positive, where ``band`` is (low, high, of); ties go to the smaller id.

    Rows without an id or a label, null and empty vectors, and vectors with null or non-finite components take no part; of
    vectors of unequal lengths the shorter counts as filled up with zeros.  Repeated rows are rows like any other: copies of an anchor are each
    other's positives and each give rows.  Fewer rows than asked for give fewer, an empty table none; columns other than those
    named play no part, whatever their names.  At most ``pivots`` pivots come from at most ``sampled`` rows; all else covers all rows.
    ``block`` and ``group`` bound the rows and anchors that meet in a task and never change the result.
    """
    solved = solve(vectors, is_anchor, id_col, vec_col, label_col, positives, negatives, band, pivots, sampled, block, group)
    if solved is None:
        return vectors.sparkSession.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        )
    asks, found = solved
    best = Window.partitionBy("quid", "nth").orderBy(F.desc("score"), "vec_id")
    ranked = found.where("quid >= 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    pairs = asks.select("quid", "anchor_id", F.posexplode(F.arrays_zip("ids", "scores")).alias("nth", "p"))
    return ranked.join(pairs, ["quid", "nth"]).select(
        "anchor_id", F.col("p.ids").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("p.scores").alias("positive_score"),
        F.col("score").alias("negative_score"),
    )


def solve(
    vectors: DataFrame, is_anchor: Column, id_col: str, vec_col: str, label_col: str, positives: int, negatives: int, band: tuple[int, int, int],
    pivots: int, sampled: int, block: int, group: int,
) -> tuple[DataFrame, DataFrame] | None:
    """(anchors with their positives, negatives of each with quid -1 for the number of pairs computed); None without vectors."""
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    ).where(finite(F.col("v")) & (F.size("v") > 0) & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    rows = checkpoint(rows.withColumn("uid", F.monotonically_increasing_id()))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    total, width, longest = rows.agg(F.count("*"), F.max(F.size("v")), F.max(square)).first()
    if not total:
        return None
    # a hair longer, so that no row's root is taken of less than zero
    longest = float(longest) ** 0.5 * (1 + 1e-12)
    picked = rows.orderBy(F.xxhash64("uid"), "uid").limit(sampled).select("v").toPandas()
    table = pivot_table(matrix(picked["v"], width), pivots, longest)

    @pandas_udf("far array<double>, cell int, asks array<double>")
    def describe(vs: pd.Series, anchor: pd.Series) -> pd.DataFrame:
        x = matrix(vs, width)
        far = table.rows(x)
        asks = np.full(len(x), None, object)
        own = np.flatnonzero(anchor.to_numpy())
        if len(own):
            for i, d in zip(own, table.anchors(x[own]), strict=True):
                asks[i] = d
        return pd.DataFrame({"far": list(far), "cell": far.argmin(axis=1).astype(np.int32), "asks": asks})

    placed = checkpoint(rows.withColumn("d", describe("v", "anchor")).select("*", "d.*").drop("d"))
    anchors = placed.where("anchor").select(F.col("uid").alias("quid"), F.col("vec_id").alias("anchor_id"), F.col("v").alias("qv"), F.col("label").alias("qlabel"), F.col("cell").alias("qcell"), F.col("asks").alias("qfar"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    block = min(block, max(1000, total // (2 * partitions)))

    # labels of more than a block are cut into parts and their anchors into chunks; there are fewer of them than blocks, and where they
    # are more than twice the partitions a block is a larger share
    share = max(block, total // (2 * partitions))
    sizes = placed.groupBy("label").agg(F.count("*").alias("n"), F.count_if("anchor").alias("a")).where(F.col("n") > share)
    hot = F.broadcast(sizes.select("label", F.ceil(F.col("n") / block).alias("parts"), F.ceil((F.col("a") + 1) / group).alias("chunks")))
    buckets = max(1, total // block)

    def keyed(df: DataFrame, uid: str, label: str, own: str, own_many: str, other: str, other_many: str) -> DataFrame:
        one = F.lit(1).cast("long")
        joined = df.join(hot.withColumnRenamed("label", label), label, "left")
        joined = joined.withColumn("key", F.when(F.col("parts").isNotNull(), F.concat(F.lit("l"), label)).otherwise(F.pmod(F.xxhash64(label), F.lit(buckets)).cast("string")))
        joined = joined.withColumns({"parts": F.coalesce("parts", one), "chunks": F.coalesce("chunks", one)})
        joined = joined.withColumn(own, F.pmod(F.xxhash64(uid, F.lit(1)), own_many))
        return joined.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other_many) - 1))).drop("parts", "chunks")

    left = keyed(anchors.drop("qcell"), "quid", "qlabel", "chunk", "chunks", "part", "parts")
    right = keyed(placed.select("uid", "vec_id", "v", "label", "far"), "uid", "label", "part", "parts", "chunk", "chunks")
    grouped = ["key", "part", "chunk"]
    found = left.groupBy(grouped).cogroup(right.groupBy(grouped)).applyInPandas(lambda a, b: _positives(table, a, b, positives), "quid long, vec_id long, score long")
    best = Window.partitionBy("quid").orderBy(F.desc("score"), "vec_id")
    ranked = found.where("quid >= 0").withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= positives)
    # at most ``positives`` entries each
    listed = ranked.groupBy("quid").agg(F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("p"))
    asks = checkpoint(anchors.join(listed, "quid").select(*anchors.columns, F.col("p.vec_id").alias("ids"), F.col("p.score").alias("scores")))

    # cells, told by the ranges of their distances; in the order of the pivots they form bundles of rows and teams of anchors
    count = len(table.pivots)
    spans = [F.min(F.col("far")[j]).alias(f"low{j}") for j in range(count)] + [F.max(F.col("far")[j]).alias(f"high{j}") for j in range(count)]
    told = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("anchor").alias("a"), *spans).collect()}
    cells = sorted(told)
    low, high = (np.array([[told[c][f"{side}{j}"] for j in range(count)] for c in cells]) for side in ("low", "high"))
    size, asked = (np.array([told[c][x] for c in cells]) for x in ("n", "a"))
    bundle, team = (np.cumsum(size) - size) // block, (np.cumsum(asked) - asked) // group
    in_bundle, in_team = np.bincount(bundle, weights=size), np.bincount(team, weights=asked)
    known = [(c, int(bundle[i]), int(-(-in_bundle[bundle[i]] // block)), int(team[i]), int(max(1, -(-in_team[team[i]] // group)))) for i, c in enumerate(cells)]
    # one row for each cell, at most ``pivots``
    spots = F.broadcast(spark.createDataFrame(known, "cell int, bundle int, parts int, team int, crews int"))
    asks = asks.join(spots.select(F.col("cell").alias("qcell"), "team", "crews"), "qcell").withColumn("crew", F.pmod(F.xxhash64("quid", F.lit(2)), "crews").cast("int"))
    asks = asks.drop("crews", "qcell")

    def reaches(batches):
        for batch in batches:
            q = matrix(batch["qv"], width)
            ends = [[_least(int(s), band[0], band[2]) for s in p] + [(band[1] * int(s)) // band[2] for s in p] for p in batch["scores"]]
            bottom, top = (np.array([f(e) for e in ends], float)[:, None] for f in (min, max))
            least, most = table.brackets(np.linalg.norm(q, axis=1), np.stack(batch["qfar"].to_list()), low, high)
            meet = (most >= bottom) & (least <= top)
            pairs = {(t, w, cells[c]) for t, w, m in zip(batch["team"], batch["crew"], meet, strict=True) for c in np.flatnonzero(m)}
            yield pd.DataFrame(sorted(pairs), columns=["team", "crew", "cell"])

    wanted = checkpoint(asks.select("team", "crew", "qv", "qfar", "scores").mapInPandas(reaches, "team int, crew int, cell int").distinct())
    ways = wanted.count()
    sent = placed.select("uid", "vec_id", "v", "label", "far", "cell").join(spots.select("cell", "bundle", "parts"), "cell")
    sent = sent.join(F.broadcast(wanted) if ways <= _SMALL else wanted, "cell").withColumn("part", F.pmod(F.xxhash64("uid", F.lit(3)), "parts").cast("int")).drop("parts", "cell")
    places = F.broadcast(wanted) if ways <= _SMALL else wanted
    places = places.join(spots.select("cell", "bundle", "parts"), "cell").select("team", "crew", "bundle", "parts").distinct()
    places = places.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    grouped = ["team", "crew", "bundle", "part"]
    met = asks.join(places, ["team", "crew"]).groupBy(grouped).cogroup(sent.groupBy(grouped))
    return asks, met.applyInPandas(lambda a, b: _negatives(table, a, b, negatives, *band), "quid long, nth int, vec_id long, score long")


def oracle() -> str:
    """The query's rows in SQL, by comparing every anchor with every row."""
    return """
    WITH rows AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
      FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
      SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
    ), positives AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
    )
    SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
    FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
    WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 5
    """
