"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .settle import drop_settled, settle


#: So many distinct edges at most are joined up within one task; more of them by rounds of joins.
ONE_TASK = 1 << 20


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over all edges of the task."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    ids = list(parent)
    yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "component": pa.array([root(x) for x in ids], pa.int64())})


def component_labels(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(a long, b long) -> (id, component): every vertex with the smallest id of its component.

    Each round joins no vertex with a list: a vertex and its smallest neighbour meet by an aggregate
    and an equi-join, so a vertex of many edges is no group of its own. Null ends and loops are
    dropped; repeated edges count once; no edges give no rows. Rounds end when no label changes;
    their number grows with the logarithm of the longest path. Up to ``one_task`` edges (16 MB) need no
    rounds: one task of that bounded size joins them up.
    """
    now = settle(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _print(now)
    if seen[0] <= one_task:
        return now.repartition(1).mapInArrow(_united, "id long, component long")
    while True:
        # Large star: each larger neighbour of a vertex moves to the vertex's smallest neighbour.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # Small star: smaller neighbours and the vertex itself move to the smallest.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        after = settle(small.distinct())
        print_after = _print(after)
        drop_settled(now)
        now = after
        if print_after == seen:
            break
        seen = print_after
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select("b", "b").distinct().toDF("id", "component"))


def _print(edges: DataFrame) -> tuple:
    """Number of edges and sum of their hashes: equal for equal sets of edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
