"""Connected components over a table of links.

Links are contracted inside each partition first (a partition's links become a
spanning forest), then rounds of the large-star / small-star algorithm of
Kiveris et al. (2014) run as joins and aggregations until nothing changes.  No
vertex's neighbour list is ever collected: minima are aggregated map-side and
joined back, the links of a hub split among tasks, so a hub costs no more than its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import checkpoint, split_join


#: Vertices held at once while links are contracted.
HELD = 1_000_000


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fewer links that connect the same, from runs of links of at most about ``HELD`` vertices."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    def told() -> Iterator[pd.DataFrame]:
        pairs = [(x, r) for x in list(parent) if (r := root(x)) != x]
        for i in range(0, len(pairs), 50_000):
            yield pd.DataFrame(pairs[i : i + 50_000], columns=["a", "b"])

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > HELD:
            yield from told()
            parent.clear()
    yield from told()


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """One large-star or small-star step over ``total`` edges (a, b), a > b."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
    joined = split_join(both, least, "a", "b", "n", 2 * total if large else total)
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return out.where("a > b").distinct()


def connected_components(links: DataFrame, a: str, b: str, max_rounds: int = 50) -> DataFrame:
    """(node, component) for every node that has a link to another node.

    ``component`` is the smallest node of the component.  Links may repeat, point
    either way, join a node to itself or hold nulls (ignored).  An empty table of
    links gives an empty result.
    """
    edges = (
        links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
        .where("a <> b")
        .mapInPandas(_forest, "a long, b long")
    )
    edges = checkpoint(edges.distinct())
    before = None
    for _ in range(max_rounds):
        state = edges.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")
        ).first()
        if state == before or not state["n"]:
            break
        before = state
        # written between the steps, as the small one asks for its hubs first
        large = checkpoint(_star(edges, True, state["n"]))
        edges = checkpoint(_star(large, False, large.count()))
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
