"""From shapes to plans: one plan for each (shape, component), over all focus nodes at once."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import lexical_of
from ..operators.constraints import COMPONENTS, LIST_PARAMETERS, nodes_failing
from ..operators.paths import closure, inverted, values
from ..operators.targets import constants, focus_nodes
from ..sources.graph import Graph
from .hooks import Hook
from .settle import settle, small_tasks
from .shapes import Path, ReportableRuntimeError, Shape, ShapeRecursionWarning, ShapesGraph, path_text, sh

#: The bag of results. ``counts`` tells whether a result makes the graph not conform.
RESULTS = "focus string, path string, value string, component string, source_shape string, severity string, messages array<string>, counts boolean, source_constraint string"
#: Within a run a result also has its root: the node for which the shape at hand was asked, which for nested property shapes isn't its focus node.
ROOTED = RESULTS + ", root string"
#: A result that stands beneath another one: its number (a digest), that of the result above it, the root of the uppermost one.
NESTED = ROOTED + ", result string, parent string"


def names(schema: str) -> list[str]:
    return [x.split(" ")[0] for x in schema.split(", ")]


def digest_of_result() -> Column:
    """A result's number: a digest of what it says."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in names(RESULTS)])), 256)


def _asked(shapes: ShapesGraph, shape: Shape) -> list[str]:
    """Shapes that a shape asks for in another way than by sh:node and sh:property."""
    lists = [x for name in ("and", "or", "xone") for head in shape.get(name) for x in shapes.items(head)]
    return [*lists, *shape.get("not"), *shape.get("qualifiedValueShape")]


def recursion_paths(shapes: ShapesGraph, start: str, cut: frozenset[str] = frozenset()) -> list[Path]:
    """The paths by which a shape comes to ask for itself, each by steps of sh:property and sh:node of which the last is a sh:node; none if it doesn't,
    or if it also does in other ways, whose answer isn't a least fixpoint. Ways through the shapes ``cut`` don't count."""
    found: list[Path] = []
    plain = True

    def reaches(node: str, seen: set[str]) -> bool:
        shape = shapes.shapes.get(node)
        if shape is None or node in seen or node in cut:
            return False
        seen.add(node)
        return any(x == start or reaches(x, seen) for x in [*_asked(shapes, shape), *shape.get("node"), *shape.get("property")])

    def visit(node: str, way: list[Path], above: tuple[str, ...]) -> None:
        nonlocal plain
        shape = shapes.shapes.get(node)
        if shape is None or shape.deactivated:
            return
        way = [*way, shape.path] if shape.path is not None else way
        plain = plain and not any(x == start or reaches(x, set()) for x in _asked(shapes, shape)) and start not in shape.get("property")
        for inner in shape.get("node"):
            if inner == start and way:
                found.append(way[0] if len(way) == 1 else ("seq", way))
        for inner in [*shape.get("node"), *shape.get("property")]:
            if inner != start and inner not in above and inner not in cut:
                visit(inner, way, (*above, inner))

    visit(start, [], (start,))
    return found if plain else []


@dataclass
class Run:
    """One validation. ``allow`` holds the severities that don't count.

    A shape that comes back to itself by sh:property and sh:node alone fails for the nodes from which, by its own paths, a node is reached that
    fails without recursion: this set is worked out once (``fixpoint``). Recursion through a negation, a choice or a count, all recursion
    with ``focus``, and all recursion without ``fixpoint``, is followed ``UNROLL`` times and then taken to conform, with a warning."""

    graph: Graph
    shapes: ShapesGraph
    allow: frozenset[str] = frozenset()
    focus: list[str] | None = None
    use_shapes: list[str] | None = None
    max_depth: int = 15
    fixpoint: bool = True
    #: Shapes at hand whose failing nodes (f) are known.
    assumed: dict[str, DataFrame] = field(default_factory=dict)
    advanced: bool = True
    stack: list[str] = field(default_factory=list)
    #: Whether the results beneath those of sh:node are kept, and those of each shape at hand.
    details: bool = False
    nested: list[list[DataFrame]] = field(default_factory=lambda: [[]])
    #: Python functions by the names that shapes give them.
    hooks: dict[str, Hook] = field(default_factory=dict)

    UNROLL = 2

    def __post_init__(self) -> None:
        small_tasks(self.graph.spark)

    def recursive(self, node: str) -> bool:
        if self.stack.count(node) < self.UNROLL:
            return False
        warnings.warn(f"{node} is taken to conform within itself: {' -> '.join(self.stack)}", ShapeRecursionWarning, stacklevel=2)
        return True

    def known_failing(self, node: str) -> DataFrame | None:
        """The nodes (f) that fail a shape which is being worked out; None where that isn't known."""
        return self.assumed.get(node) if node in self.stack else None

    def _fixpoint(self, node: str, nodes: DataFrame) -> DataFrame | None:
        """(f): of the nodes, and of all that the shape asks itself for from them, those that fail it; None if it doesn't come back to itself."""
        paths = recursion_paths(self.shapes, node, frozenset(self.assumed))
        if not paths:
            return None
        path = paths[0] if len(paths) == 1 else ("alt", paths)
        start = settle(nodes.select("f").distinct())
        asked = settle(start.unionByName(closure(self.graph, start, path).select(F.col("v").alias("f"))).distinct())
        self.assumed[node] = self.graph.spark.createDataFrame([], "f string")
        before, self.details = self.details, False
        try:
            lowest = settle(self.failing(node, asked, any_result=True))
        finally:
            self.details = before
            del self.assumed[node]
        back = closure(self.graph, lowest, inverted(path)).select(F.col("v").alias("f")).join(asked, "f", "left_semi")
        return settle(lowest.unionByName(back).distinct())

    def empty(self) -> DataFrame:
        return self.graph.spark.createDataFrame([], ROOTED)

    def failing(self, node: str, nodes: DataFrame, any_result: bool = False) -> DataFrame:
        """Distinct nodes (f) that don't conform to the shape; with ``any_result``, that have any result."""
        found = self.results(node, nodes)
        return (found if any_result else found.where("counts")).select(F.col("root").alias("f")).distinct()

    def results(self, node: str, nodes: DataFrame) -> DataFrame:
        """Results of a shape for the nodes (f), distinct; what stands beneath them is left out."""
        return self.results_and_nested(node, nodes)[0]

    def results_and_nested(self, node: str, nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
        """Results of a shape for the nodes (f), distinct, and the results beneath them."""
        shape = self.shapes.shapes.get(node)
        if shape is None:
            raise ReportableRuntimeError(f"{node} isn't a shape")
        if shape.deactivated or self.stack.count(node) > self.UNROLL:
            return self.empty(), []
        if self.fixpoint and self.focus is None and node not in self.assumed and node not in self.stack and (failing := self._fixpoint(node, nodes)) is not None:
            self.assumed[node] = failing
            try:
                return self.results_and_nested(node, nodes)
            finally:
                del self.assumed[node]
        if len(self.stack) >= self.max_depth:
            raise ReportableRuntimeError("Validation path too deep!")
        if self.focus is not None and self.stack:
            nodes = nodes.where(F.col("f").isin(*self.focus))
        self.stack.append(node)
        self.nested.append([])
        try:
            parts = self._results(shape, nodes)
        finally:
            self.stack.pop()
            nested = self.nested.pop()
        return reduce(DataFrame.unionByName, parts) if parts else self.empty(), nested

    def _results(self, shape: Shape, nodes: DataFrame) -> list[DataFrame]:
        found = nodes.select("f", F.col("f").alias("v")) if shape.path is None else values(self.graph, nodes, shape.path)
        own_path = path_text(shape.path) if shape.path is not None else None
        parts = []
        for name, (component, function, message) in COMPONENTS.items():
            if sh(name) not in shape.params:
                continue
            if name == "node":
                parts += self._node_results(shape, found, own_path, self._message(shape, name, message, own_path))
                continue
            bad = function(self, shape, nodes, found)
            if bad is not None:
                parts.append(self._rows(shape, bad, f"{component}ConstraintComponent", own_path, self._message(shape, name, message, own_path)))
        for inner in shape.get("property"):
            if not self.recursive(inner):
                got, nested = self.results_and_nested(inner, found.select(F.col("v").alias("f")).distinct())
                # A value is judged once; its results count for each focus node that reaches it.
                reached = found.select(F.col("v").alias("root"), F.col("f").alias("above"))
                up = lambda x: x if shape.path is None else x.join(reached, "root").withColumn("root", F.col("above")).select(*x.columns)
                parts.append(up(got))
                self.nested[-1] += [up(x) for x in nested]
        if self.advanced:
            from .sparql_shapes import sparql_results

            parts += sparql_results(self, shape, nodes, found, own_path)
        return parts

    def _node_results(self, shape: Shape, found: DataFrame, path: str | None, messages) -> list[DataFrame]:
        """A result for each value that has any result of a shape of sh:node, and with ``details`` these beneath it."""
        parts = []
        for inner in shape.get("node"):
            if (known := self.known_failing(inner)) is not None:
                bad = found.join(known.withColumnRenamed("f", "v"), "v", "left_semi").select("f", "v")
                parts.append(self._rows(shape, bad, "NodeConstraintComponent", path, messages))
                continue
            if self.recursive(inner):
                continue
            bad, got, nested = nodes_failing(self, inner, found)
            rows = self._rows(shape, bad, "NodeConstraintComponent", path, messages)
            parts.append(rows)
            if self.details:
                above = rows.select(F.col("value").alias("_v"), F.col("root").alias("_root"), digest_of_result().alias("_above")).distinct()
                lower = [got.withColumn("result", digest_of_result()).withColumn("parent", F.lit("")), *nested]
                # Numbers beneath a result are made of its own number and theirs, so that each result has its own copies.
                joined = reduce(DataFrame.unionByName, lower).distinct().join(above, F.col("root") == F.col("_v"))
                within = lambda c: F.when(F.col(c) == "", F.col("_above")).otherwise(F.sha2(F.concat("_above", c), 256))
                self.nested[-1].append(joined.select(*names(RESULTS), F.col("_root").alias("root"), within("result").alias("result"), within("parent").alias("parent")))
        return parts

    def _message(self, shape: Shape, name: str, template: str, own_path: str | None):
        if shape.messages:
            return F.array(*[F.lit(lexical_of(m)) for m in shape.messages])
        given = [self.shapes.items(x) if name in LIST_PARAMETERS else [x] for x in shape.get(name)]
        shown = ", ".join(f"[{', '.join(g)}]" if name in LIST_PARAMETERS else g[0] for g in given)
        text = F.lit(template.replace("{p}", shown).replace("{path}", own_path or ""))
        text = F.replace(text, F.lit("{f}"), F.coalesce("f", F.lit(""))) if "{f}" in template else text
        text = F.replace(text, F.lit("{v}"), F.coalesce("v", F.lit(""))) if "{v}" in template else text
        return F.array(text)

    def _rows(self, shape: Shape, bad: DataFrame, component: str, path: str | None, messages, source: str | None = None, constraint: str | None = None, always: bool = False) -> DataFrame:
        own = "path" in bad.columns
        return bad.select(
            F.col("f").alias("focus"),
            (F.coalesce("path", F.lit(path)) if own else F.lit(path).cast("string")).alias("path"),
            F.col("v").alias("value"),
            F.lit(component if component.startswith("<") else sh(component)).alias("component"),
            F.lit(source or shape.node).alias("source_shape"),
            F.lit(shape.severity).alias("severity"),
            messages.cast("array<string>").alias("messages"),
            F.lit(always or shape.severity not in self.allow).alias("counts"),
            F.lit(constraint).cast("string").alias("source_constraint"),
            F.col("f").alias("root"),
        )

    def targeted(self) -> list[Shape]:
        found = [s for s in self.shapes.shapes.values() if self.shapes.has_target(s)]
        if self.use_shapes is not None:
            found = [self.shapes.shapes[n] for n in self.use_shapes if n in self.shapes.shapes]
        return sorted(found, key=lambda s: s.order)

    def all_results(self) -> DataFrame:
        """The bag of results of all targeted shapes."""
        return self._all()[0]

    def all_nested(self) -> DataFrame:
        """(result, parent, the columns of results): all results beneath others, for ``details``. A ``parent`` is the ``result`` of another row, or
        the ``digest_of_result`` of one of ``all_results``."""
        before, self.details = self.details, True
        try:
            nested = self._all()[1]
        finally:
            self.details = before
        columns = [*names(RESULTS), "result", "parent"]
        none = self.graph.spark.createDataFrame([], NESTED)
        return reduce(DataFrame.unionByName, nested, none).select(*columns).distinct()

    def first_result(self) -> DataFrame:
        """One result that counts, of the first shape that has any; else one that doesn't, if there is one. A shape is planned only after a job
        over those before it has found nothing that counts."""
        schema, other = self.empty().drop("root").schema, []
        for shape in self.targeted():
            found = self._of_target(shape)[0].drop("root")
            row = found.orderBy(F.col("counts").desc()).limit(1).collect()
            if row and row[0]["counts"]:
                return self.graph.spark.createDataFrame(row, schema)
            other = other or row
        return self.graph.spark.createDataFrame(other, schema)

    def _of_target(self, shape: Shape) -> tuple[DataFrame, list[DataFrame]]:
        """The results of a shape for its targets, and what is beneath them."""
        from .sparql_shapes import custom_target

        if self.focus is not None and self.use_shapes is not None:
            nodes = constants(self.graph, self.focus)
        else:
            nodes = focus_nodes(self.graph, self.shapes, shape, (lambda t: custom_target(self, t)) if self.advanced else None)
            if self.focus is not None:
                nodes = nodes.where(F.col("f").isin(*self.focus))
        return self.results_and_nested(shape.node, nodes)

    def _all(self) -> tuple[DataFrame, list[DataFrame]]:
        parts, beneath = [], []
        for shape in self.targeted():
            found, nested = self._of_target(shape)
            parts.append(found)
            beneath += nested
        return (reduce(DataFrame.unionByName, parts) if parts else self.empty()).drop("root"), beneath
