"""Node expressions as frames (f, v): the nodes v that the expression gives at each focus node f."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import is_literal
from ..operators.paths import values
from .shapes import ReportableRuntimeError, sh

DEPTH = 8


def expression_values(run, node: str, nodes: DataFrame, depth: int = 0) -> DataFrame:
    """Distinct (f, v). ``nodes`` has the focus nodes (f)."""
    shapes = run.shapes
    none = nodes.select("f", F.col("f").alias("v")).where(F.lit(False))
    if depth > DEPTH:
        return none
    if node == sh("this"):
        return nodes.select("f", F.col("f").alias("v"))
    if is_literal(node) or (node.startswith("<") and not shapes.is_list(node) and node not in shapes.out):
        return nodes.select("f", F.lit(node).alias("v"))
    union, intersection = shapes.values(node, "union"), shapes.values(node, "intersection")
    if union and intersection:
        raise ReportableRuntimeError(f"{node} has a union and an intersection")
    if union or intersection:
        parts = [expression_values(run, x, nodes, depth + 1) for x in shapes.items((union or intersection)[0])]
        if union:
            return reduce(DataFrame.unionByName, parts).distinct()
        return reduce(lambda a, b: a.join(b, ["f", "v"], "left_semi"), parts).distinct()
    if path := shapes.values(node, "path"):
        return values(run.graph, nodes, shapes.path(path[0]))
    if filter_ := shapes.values(node, "filterShape"):
        start = expression_values(run, (shapes.values(node, "nodes") or [sh("this")])[0], nodes, depth + 1)
        bad = run.failing(filter_[0], start.select(F.col("v").alias("f")).distinct())
        return start.join(bad.withColumnRenamed("f", "v"), "v", "left_anti").select("f", "v")
    from .sparql_shapes import engine, parameters

    own = engine(run)
    for name, heads in shapes.out.get(node, {}).items() if node in shapes.out else ():
        if name in own.functions:
            wanted = parameters(shapes, name)
            given = shapes.items(heads[0])
            if len(given) > len(wanted):
                raise ReportableRuntimeError(f"{name} takes {len(wanted)} arguments")
            rows = nodes.select("f")
            for i, (n, _, optional) in enumerate(wanted):
                if i < len(given):
                    arg = expression_values(run, given[i], nodes, depth + 1).withColumnRenamed("v", f"a{i}")
                    rows = rows.join(arg, "f", "left" if optional else "inner")  # all combinations within a focus node
                elif optional:
                    rows = rows.withColumn(f"a{i}", F.lit(None).cast("string"))
                else:
                    raise ReportableRuntimeError(f"{name} needs {n}")
            named = [n for n, *_ in wanted]
            renamed = rows.select("f", *[F.col(f"a{i}").alias(n) for i, n in enumerate(named)])
            own.scope, own.maybe = set(), getattr(own, "maybe", set())
            answers = own.call(name, renamed.select(*named).distinct()).select(*[F.col(n).alias(f"_k{i}") for i, n in enumerate(named)], "_result")
            match = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_k{i}")) for i, n in enumerate(named)], F.lit(True))
            return renamed.join(answers, match).where("_result IS NOT NULL").select("f", F.col("_result").alias("v")).distinct()
    if node.startswith("<"):
        return nodes.select("f", F.lit(node).alias("v"))
    raise ReportableRuntimeError(f"{node} isn't a node expression")
