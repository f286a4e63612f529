"""Connected components by union-find within partitions and star contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.session import materialize


#: Links that one task takes into its union-find.
LINKS = 200_000


def local_forest(batches: Iterator[pa.RecordBatch], most: int = 2 * LINKS) -> Iterator[pa.RecordBatch]:
    """Links of a partition, in portions of bounded size, as links to the smallest node of each portion's components."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def out() -> pa.RecordBatch:
        rows = [(x, r) for x in parent if (r := find(x)) != x]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) >= most:
            yield out()
    yield out()


def _nearest(links: DataFrame) -> DataFrame:
    """Of each node ``a``, the smallest of it and its neighbours; a written table, so that a hot node's links can be split in the join."""
    return materialize(links.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a"), F.least("a", "_m").alias("_m")), "components-nearest")


def connected_components(links: DataFrame, per_task: int = LINKS) -> DataFrame:
    """(node, component) of all nodes of ``links`` (a long, b long); a component's name is its smallest node.

    Union-find takes ``per_task`` links at a time. What is left of several such portions is contracted by
    stars: each round links all larger neighbours of a node to its smallest one, then all smaller
    ones, and drops links that are the same, until a round changes nothing. No task holds a component.
    """
    links = materialize(links.select("a", "b").where("a != b"), "components-links")
    portions = max(1, -(-links.count() // per_task))
    links = materialize(links.repartition(portions).mapInArrow(local_forest, "a long, b long"), "components")
    if portions > 1:
        links = _contracted(links.distinct())
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _contracted(links: DataFrame) -> DataFrame:
    before = None
    while True:
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return links
        before = tuple(state)
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_nearest(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct()
        large = materialize(large, "components-large")
        near = _nearest(large)
        small = large.join(near, "a").where("b != _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        links = materialize(small.unionByName(near.select("a", F.col("_m").alias("b"))).where("a != b").distinct(), "components")
