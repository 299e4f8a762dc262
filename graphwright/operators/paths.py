"""Property paths as joins: pairs (f, v) of focus and value nodes, always a set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.settle import drop_settled, settle
from ..plans.shapes import Path
from ..sources.graph import FIRST, NIL, REST, Graph

#: After so many rounds a closure from most nodes goes on by doubling.
LONG = 16
#: Rounds of a closure that are written as one table.
MERGED = 8
#: A hierarchy of at most so many edges is closed on the driver; a larger one by joins.
DRIVER_EDGES = 100_000


def inverted(path: Path) -> Path:
    """The inverse of a path, down to its predicates: a sequence is reversed, as SPARQL defines it."""
    kind, inner = path
    if kind == "pred":
        return ("inv", path)
    if kind == "inv":
        return inner
    if kind == "seq":
        return ("seq", [inverted(x) for x in reversed(inner)])
    if kind == "alt":
        return ("alt", [inverted(x) for x in inner])
    if kind == "neg":
        return ("neg", (inner[1], inner[0]))
    return (kind, inverted(inner))


def edges(graph: Graph, path: Path) -> DataFrame | None:
    """(s, o) of a path that is one step; None for others."""
    if path[0] == "pred":
        return graph.pred(path[1])
    if path[0] == "inv" and path[1][0] == "pred":
        return graph.pred(path[1][1]).select(F.col("o").alias("s"), F.col("s").alias("o"))
    if path[0] == "neg":  # a step of any predicate but those, in one direction or both
        forward, backward = path[1]
        other = lambda names: graph.triples().where(~F.col("p").isin(*names)) if names else graph.triples()
        parts = [other(forward).select("s", "o")] if forward is not None else []
        parts += [other(backward).select(F.col("o").alias("s"), F.col("s").alias("o"))] if backward is not None else []
        return reduce(DataFrame.unionByName, parts)
    if path[0] == "alt":
        parts = [edges(graph, x) for x in path[1]]
        return reduce(DataFrame.unionByName, parts) if all(p is not None for p in parts) else None
    return None


def _steps(path: Path) -> list[Path]:
    """The steps of a sequence, those of sequences within it too."""
    if path[0] == "inv" and path[1][0] != "pred":
        return _steps(inverted(path[1]))
    return [step for x in path[1] for step in _steps(x)] if path[0] == "seq" else [path]


def _follow_steps(graph: Graph, pairs: DataFrame, steps: list[Path], own: bool) -> DataFrame:
    """(f, v) at the end of a sequence. A step that isn't a predicate may lead from a node to any number of them, for each node before it that
    leads there. So where steps follow it, the way goes on from distinct nodes, and what they reach at its end is joined to the pairs before it."""
    for i, step in enumerate(steps):
        if step[0] != "pred" and i + 1 < len(steps) and not (own and i == 0):
            reached = values(graph, pairs.select(F.col("v").alias("f")).distinct(), ("seq", steps[i:]))
            return pairs.join(reached.toDF("w", "x"), F.col("v") == F.col("w")).select("f", F.col("x").alias("v"))
        pairs = follow(graph, pairs, step)
    return pairs


def follow(graph: Graph, pairs: DataFrame, path: Path, own: bool = False) -> DataFrame:
    """(f, v) one path further from the v of ``pairs``; may repeat rows. ``own``: each pair is a node and itself, and no pair is there twice."""
    one = edges(graph, path)
    if one is not None:
        return pairs.join(one, pairs["v"] == one["s"]).select("f", F.col("o").alias("v"))
    kind, inner = path
    if kind == "inv":
        return follow(graph, pairs, inverted(inner), own)
    if kind == "seq":
        return _follow_steps(graph, pairs, _steps(path), own)
    if kind == "alt":
        return reduce(DataFrame.unionByName, [follow(graph, pairs, x, own) for x in inner])
    if kind == "?":
        return pairs.unionByName(follow(graph, pairs, inner, own))
    reached = closure(graph, pairs.select(F.col("v").alias("f")).distinct(), inner)
    further = pairs.join(reached.toDF("w", "x"), F.col("v") == F.col("w")).select("f", F.col("x").alias("v"))
    return pairs.unionByName(further) if kind == "*" else further


def values(graph: Graph, focus: DataFrame, path: Path) -> DataFrame:
    """Distinct (f, v) from the nodes ``focus`` (f)."""
    return follow(graph, focus.select("f", F.col("f").alias("v")), path, own=True).distinct()


def closure(graph: Graph, start: DataFrame, step: Path) -> DataFrame:
    """(f, v): v is reached from f by one or more steps. Semi-naive rounds: only pairs found in the last round
    are carried on, and what is known already is taken out by an anti join, so cycles end."""
    fresh = settle(follow(graph, start.select("f", F.col("f").alias("v")), step, own=True).distinct())
    # What the rounds found, in parts: MERGED of one level are written as one of the next, so that there are few parts however many rounds
    # there are, and each row is written a few times at most.
    levels: list[list[DataFrame]] = [[fresh]]
    rounds = 0
    while not fresh.isEmpty():
        rounds += 1
        if rounds == LONG and (one := edges(graph, step)) is not None and _from_most(start, one):
            return all_reached(one).join(start.select("f").distinct(), "f", "left_semi")
        known = reduce(DataFrame.unionByName, [part for level in levels for part in level])
        fresh = settle(follow(graph, fresh, step).distinct().join(known, ["f", "v"], "left_anti"))
        levels[0].append(fresh)
        for i in range(len(levels)):
            if len(levels[i]) > MERGED:
                merged, kept = levels[i][:MERGED], levels[i][MERGED:]
                levels += [[]] if i + 1 == len(levels) else []
                levels[i + 1].append(settle(reduce(DataFrame.unionByName, merged)))
                levels[i] = kept
                for part in merged:
                    drop_settled(part)
    return reduce(DataFrame.unionByName, [part for level in levels for part in level])


def _from_most(start: DataFrame, one: DataFrame) -> bool:
    """Whether at least half of the nodes that a step leads from are among the start's."""
    sources = one.select(F.col("s").alias("f")).distinct()
    total, met = sources.join(start.select("f").distinct().withColumn("_in", F.lit(True)), "f", "left").agg(F.count(F.lit(1)), F.count("_in")).first()
    return 2 * met >= total


def all_reached(one: DataFrame) -> DataFrame:
    """(f, v) for every two nodes of which one is reached from the other by steps (s, o). Round k has the pairs of fewer than 2 ** k steps, and
    those of 2 ** k steps that it goes on by: a pair of a chain or tree is made once, and rounds grow with the logarithm of the longest way."""
    jump = settle(one.select(F.col("s").alias("f"), F.col("o").alias("v")).distinct())
    known = jump
    while True:
        further = jump.toDF("f", "m").join(known.toDF("m", "v"), "m").select("f", "v")
        fresh = settle(further.distinct().join(known, ["f", "v"], "left_anti"))
        if fresh.isEmpty():
            return known
        after = settle(known.unionByName(fresh))
        longer = settle(jump.toDF("f", "m").join(jump.toDF("m", "v"), "m").select("f", "v").distinct())
        known, jump = after, longer


def list_items(graph: Graph, heads: DataFrame) -> DataFrame:
    """(f, n, v): the n-th member, from 0, of the RDF list that each node f of ``heads`` (f) begins. A round a place, for all
    lists at once; a list that comes back to one of its nodes raises ValueError. Other nodes have no members."""
    first, rest = graph.pred(FIRST).toDF("node", "v"), graph.pred(REST).toDF("node", "next")
    at = settle(heads.select("f", F.col("f").alias("node")).distinct())
    seen, found, n = at, None, 0
    while not at.isEmpty():
        part = at.join(first, "node").select("f", F.lit(n).alias("n"), "v")
        found = part if found is None else found.unionByName(part)
        after = settle(at.join(rest, "node").where(F.col("next") != NIL).select("f", F.col("next").alias("node")).distinct())
        if not after.join(seen, ["f", "node"], "left_semi").isEmpty():
            raise ValueError("a list has a cycle")
        at, seen, n = after, seen.unionByName(after), n + 1
    return found if found is not None else graph.spark.createDataFrame([], "f string, n int, v string")


def classes_below(graph: Graph, classes: list[str], subclass: str) -> list[str] | DataFrame:
    """The classes and their transitive subclasses: a list, or a frame (k) where the hierarchy has more than DRIVER_EDGES edges."""
    spark = graph.spark
    pairs = graph.pred(subclass).distinct().limit(DRIVER_EDGES + 1).collect()
    if len(pairs) > DRIVER_EDGES:
        start = spark.createDataFrame([(c,) for c in classes], "f string")
        below = closure(graph, start, ("inv", ("pred", subclass)))
        return start.toDF("k").unionByName(below.select(F.col("v").alias("k"))).distinct()
    children: dict[str, list[str]] = {}
    for s, o in pairs:
        children.setdefault(o, []).append(s)
    seen, todo = set(classes), list(dict.fromkeys(classes))
    while todo:
        for k in children.get(todo.pop(), ()):
            if k not in seen:
                seen.add(k)
                todo.append(k)
    return sorted(seen)
