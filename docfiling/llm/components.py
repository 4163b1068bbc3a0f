"""Connected components: union-find in each partition, then stars between partitions until nothing changes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            a, b = min(a, b), max(a, b)
            self.up[b] = a
            self.up.setdefault(a, a)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
    nodes = [x for x in forest.up if forest.root(x) != x]
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([forest.root(x) for x in nodes], pa.int64())], names=["a", "b"])


def _is_star(now: DataFrame) -> bool:
    """Whether each node a has one b, and no b is an a: then b is the component."""
    ends = now.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(now.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root")).filter((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("root") == 1))).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node of its component) for all nodes of edges a, b that are no roots.

    Large-star and small-star in turn, until all are stars; each is one aggregation and one join, so a hub's neighbours
    never meet in one row, and every round is written to the shared folder.
    """
    now = stage(edges.select("a", "b").mapInArrow(_contract, "a long, b long").distinct(), "forest")
    while not _is_star(now):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        linked = down.join(least, "a")
        now = stage(
            linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), "stars"
        )
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
