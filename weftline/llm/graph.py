"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Each step is one aggregation with map-side partial minima and one join back to the edges. The minima are
written before the join, so that both sides reach it through plain exchanges and adaptive execution can split
the partition of a node with very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize

MAX_ROUNDS = 60


def _signature(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(
            F.count(F.lit(1)),
            F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")),
        ).first()
    )


def _star(edges: DataFrame, name: str, large: bool) -> DataFrame:
    """src > dst in edges. Large: a node's larger neighbours move to the least of its neighbours and itself.
    Small: its smaller neighbours and itself move to the least of them."""
    both = edges.union(edges.select("dst", "src")).toDF("src", "dst") if large else edges
    least = materialize(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("least")), name + "-min")
    joined = both.join(least, "src")
    if large:
        moved = joined.filter(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    else:
        moved = joined.filter("dst != least").select(F.col("dst").alias("src"), F.col("least").alias("dst")).union(
            least.select("src", "least")
        )
    out = materialize(moved.filter("src != dst").distinct(), name)
    discard(least)
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node that has an edge; label is the least node reachable. edges: src, dst longs.

    Loops and repeated edges are allowed; rows with a null end are ignored; no edges give no rows."""
    canonical = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).filter(
        edges.src.isNotNull() & edges.dst.isNotNull() & (edges.src != edges.dst)
    )
    now = materialize(canonical.distinct(), "edges")
    before = _signature(now)
    for _ in range(MAX_ROUNDS if before[0] else 0):
        large = _star(now, "large", True)
        discard(now)
        now = _star(large, "small", False)
        discard(large)
        after = _signature(now)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("src").alias("node"), F.col("dst").alias("label")).union(now.select("dst", "dst").distinct())


class Forest:
    """Union-find inside one task: turns the links of a bucket into at most one edge for each node."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while (up := self.parent.get(x, x)) != root:
            self.parent[x] = root
            x = up
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple[int, int]]:
        return [(x, self.find(x)) for x in list(self.parent) if self.find(x) != x]
