"""SHACL rules: triple rules, SPARQL CONSTRUCT rules and rules by Python functions, in order, perhaps repeated until nothing is added."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import TRUE, TYPE, lexical_of
from ..plans.compile import Run
from ..plans.expressions import expression_values
from ..plans.hooks import Hook, hook_of, inferred
from ..plans.settle import settle
from ..plans.shapes import RuleLoadError, ReportableRuntimeError, ShapesGraph, sh
from ..plans.sparql_shapes import custom_target, engine, read
from ..sources.graph import Graph, Layered
from .targets import constants, focus_nodes

ROUNDS = 100


def _order(shapes: ShapesGraph, node: str) -> float:
    got = shapes.value(node, "order")
    return float(lexical_of(got)) if got else 0.0


def rules_of(shapes: ShapesGraph, shape: str) -> list[tuple[str, str]]:
    """(kind, rule) of a shape by sh:order; deactivated rules are left out."""
    out = []
    for node in shapes.values(shape, "rule"):
        types = shapes.values(node, TYPE)
        kinds = [k for k in ("TripleRule", "SPARQLRule", "JSRule") if sh(k) in types]
        if len(kinds) != 1:
            raise RuleLoadError(f"{node} has to be a triple rule, a SPARQL rule or a rule by a function")
        if TRUE not in shapes.values(node, "deactivated"):
            out.append((kinds[0], node))
    return sorted(out, key=lambda r: _order(shapes, r[1]))


def infer(run: Run, kind: str, node: str, nodes: DataFrame) -> DataFrame:
    """(s, p, o) that one rule gives for the focus nodes that fulfil its conditions."""
    shapes = run.shapes
    conditions = [x for c in shapes.values(node, "condition") for x in (shapes.items(c) if shapes.is_list(c) else [c])]
    for c in conditions:
        nodes = nodes.join(run.failing(c, nodes), "f", "left_anti")
    if kind == "TripleRule":
        parts = []
        for name, column in (("subject", "s"), ("predicate", "p"), ("object", "o")):
            given = shapes.values(node, name)
            if len(given) != 1:
                raise RuleLoadError(f"{node} needs one sh:{name}")
            parts.append(expression_values(run, given[0], nodes).withColumnRenamed("v", column))
        return reduce(lambda a, b: a.join(b, "f"), parts).select("s", "p", "o").distinct()
    if kind == "JSRule":
        if (hook := hook_of(run, node)) is None:
            raise RuleLoadError(f"{node} needs sh:jsFunctionName")
        return inferred(run, hook, nodes)
    texts = shapes.values(node, "construct")
    if not texts:
        raise RuleLoadError(f"{node} needs sh:construct")
    seed = nodes.select(F.col("f").alias("this"))
    made = []
    for text in texts:
        q = read(shapes, node, lexical_of(text), None)
        made.append(engine(run).construct(q, seed))
    return reduce(DataFrame.unionByName, made).distinct()


def apply_rules(graph: Graph, shapes: ShapesGraph, iterate: bool = False, focus: list[str] | None = None, use_shapes: list[str] | None = None, hooks: dict[str, Hook] | None = None) -> tuple[Layered, DataFrame]:
    """(the expanded graph, the triples that rules added). A shape's rules are repeated while they add something,
    if ``iterate``; each rule sees what the rules before it added."""
    spark = graph.spark
    added = spark.createDataFrame([], "s string, p string, o string")
    now = Layered(spark, graph, added)
    owners = [n for n, s in shapes.shapes.items() if sh("rule") in s.params and not s.deactivated and (use_shapes is None or n in use_shapes)]
    for owner in sorted(owners, key=lambda n: _order(shapes, n)):
        rules = rules_of(shapes, owner)
        for turn in range(ROUNDS + 1):
            if turn == ROUNDS:
                raise ReportableRuntimeError("the rules don't come to an end")
            changed = False
            for kind, node in rules:
                run = Run(now, shapes, hooks=hooks or {})
                if focus is not None and use_shapes is not None:
                    nodes = constants(run.graph, focus)
                else:
                    nodes = focus_nodes(run.graph, shapes, shapes.shapes[owner], lambda t, r=run: custom_target(r, t))
                    nodes = nodes.where(F.col("f").isin(*focus)) if focus is not None else nodes
                new = settle(now.missing(settle(infer(run, kind, node, nodes))))
                if not new.isEmpty():
                    changed, added = True, added.unionByName(new)
                    now = Layered(spark, graph, added)
            if not (iterate and changed):
                break
    return now, added
