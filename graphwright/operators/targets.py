"""Target declarations of shapes as frames of focus nodes (f)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import SUBCLASS, TYPE
from ..plans.shapes import Shape, ShapesGraph
from ..sources.graph import Graph
from .paths import classes_below


def constants(graph: Graph, nodes: list[str]) -> DataFrame:
    return graph.spark.createDataFrame([(n,) for n in dict.fromkeys(nodes)], "f string")


#: Classes of a filter; more of them, MOST_BROADCAST at most, are broadcast, beyond that the join is shuffled.
MOST_LISTED, MOST_BROADCAST = 1000, 1_000_000


def instances(graph: Graph, classes: list[str]) -> DataFrame:
    """(f): instances of one of the classes, or of a transitive subclass by the data's own hierarchy; may repeat rows."""
    below = classes_below(graph, classes, SUBCLASS)
    typed = graph.pred(TYPE)
    if isinstance(below, list) and len(below) <= MOST_LISTED:
        return typed.where(F.col("o").isin(*below)).select(F.col("s").alias("f"))
    keys = graph.spark.createDataFrame([(k,) for k in below], "k string") if isinstance(below, list) else below
    few = isinstance(below, list) or keys.count() <= MOST_BROADCAST
    return typed.join(F.broadcast(keys) if few else keys, F.col("o") == F.col("k"), "left_semi").select(F.col("s").alias("f"))


def focus_nodes(graph: Graph, shapes: ShapesGraph, shape: Shape, custom=None) -> DataFrame:
    """Distinct focus nodes of all targets of the shape. ``custom(target node)`` evaluates sh:target."""
    parts = []
    if nodes := shape.get("targetNode"):
        parts.append(constants(graph, nodes))
    classes = shape.get("targetClass") + ([shape.node] if shapes.implicit_class(shape) else [])
    if classes:
        parts.append(instances(graph, classes))
    for p in shape.get("targetSubjectsOf"):
        parts.append(graph.pred(p).select(F.col("s").alias("f")))
    for p in shape.get("targetObjectsOf"):
        parts.append(graph.pred(p).select(F.col("o").alias("f")))
    if custom is not None:
        parts += [custom(t) for t in shape.get("target")]
    return reduce(DataFrame.unionByName, parts).distinct() if parts else constants(graph, [])
