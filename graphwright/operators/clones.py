"""Descriptions of blank nodes, with names of their own for each root: what a report shows of a value without an IRI."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.settle import settle
from ..sources.graph import Graph

DEPTH = 10


def _blank(c: Column) -> Column:
    return F.startswith(c, F.lit("_:"))


def clones(graph: Graph, roots: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(root, s, p, o): all triples of the blank nodes (f) and of the blank nodes that are reached from them, lists included, ``depth`` steps
    deep. A root keeps its name; a node beneath it is named by a digest of root and node, so that each root has copies of its own, the
    same ones in every run. Nodes that come back to themselves are copied once; IRIs, literals and nulls among the roots give nothing."""
    triples = graph.triples()
    start = roots.select(F.col("f").alias("root")).where(_blank(F.col("root"))).distinct()
    fresh = settle(start.select("root", F.col("root").alias("node")))
    seen, found = fresh, None
    for _ in range(depth + 1):
        if fresh.isEmpty():
            break
        part = settle(triples.join(fresh.withColumnRenamed("node", "s"), "s").select("root", "s", "p", "o").distinct())
        found = part if found is None else found.unionByName(part)
        fresh = settle(part.where(_blank(F.col("o"))).select("root", F.col("o").alias("node")).distinct().join(seen, ["root", "node"], "left_anti"))
        seen = seen.unionByName(fresh)
    if found is None:
        return graph.spark.createDataFrame([], "root string, s string, p string, o string")
    named = lambda c: F.when(_blank(F.col(c)) & (F.col(c) != F.col("root")), F.concat(F.lit("_:c"), F.substring(F.sha2(F.concat_ws(" ", "root", c), 256), 1, 32))).otherwise(F.col(c))
    return found.select("root", named("s").alias("s"), "p", named("o").alias("o"))
