"""SPARQL inside shapes: sh:sparql constraints, SPARQL constraint components, SPARQL targets and functions,
and sh:expression constraints."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import OWL, RDF, RDFS, SUBCLASS, TRUE, TYPE, XSD, c_truth, lexical_of
from ..sources.graph import TripleTable
from .expressions import expression_values
from .hooks import chosen, functions_by_hook, hook_of, judged
from .shapes import SH, ConstraintLoadError, Shape, ShapesGraph, ValidationFailure, sh
from .sparql import Engine
from .sparql_parser import Query, SparqlError, parse_query, variables

FIRST_PREFIXES = {"rdf": RDF, "rdfs": RDFS, "owl": OWL}
RESERVED = ("this", "shapesGraph", "currentShape", "path", "PATH", "value")


def prefixes_of(shapes: ShapesGraph, node: str) -> dict[str, str]:
    """Those that sh:prefixes of the node and all sh:declare of ontologies give."""
    owners = [*shapes.values(node, "prefixes"), *dict.fromkeys(s for s, po in shapes.out.items() if sh("declare") in po)]
    out = dict(FIRST_PREFIXES)
    for owner in reversed(owners):
        for d in shapes.values(owner, "declare"):
            name, space = shapes.value(d, "prefix"), shapes.value(d, "namespace")
            if name and space:
                out[lexical_of(name)] = lexical_of(space)
    return out


def check_allowed(q: Query, bound: tuple[str, ...]) -> None:
    """What SHACL forbids in queries with pre-bound variables."""
    def walk(parts: list) -> None:
        for part in parts:
            kind = part[0]
            if kind in ("minus", "values"):
                raise ValidationFailure(f"{kind.upper()} isn't allowed in a constraint's query")
            if kind == "bind" and part[2] in bound:
                raise ValidationFailure(f"?{part[2]} is bound already")
            if kind == "sub":
                inner = part[1]
                if inner.project is None or any(b not in {n for n, _ in inner.project} for b in bound if b in variables(q) and b != "path"):
                    raise ValidationFailure("a nested SELECT has to return all pre-bound variables")
                if any(e is not None and n in bound for n, e in inner.project):
                    raise ValidationFailure("a pre-bound variable can't be assigned")
                walk(inner.where)
            elif kind == "optional":
                walk(part[1])
            elif kind == "graph":
                walk(part[2])
            elif kind == "union":
                for g in part[1]:
                    walk(g)
            elif kind == "filter":
                for g in _inner_groups(part[1]):
                    walk(g)

    if any(e is not None and n in bound for n, e in q.project or ()):
        raise ValidationFailure("a pre-bound variable can't be assigned")
    walk(q.where)


def _inner_groups(e):
    if isinstance(e, tuple) and e and e[0] in ("exists", "not exists"):
        yield e[1]
    elif isinstance(e, (tuple, list)):
        for x in e:
            yield from _inner_groups(x)


def read(shapes: ShapesGraph, node: str, text: str, path: str | None, bound: tuple[str, ...] = ()) -> Query:
    try:
        q = parse_query(text, prefixes_of(shapes, node), path)
    except SparqlError as e:
        raise ValidationFailure(f"the query of {node}: {e}") from e
    if bound:
        check_allowed(q, bound)
    return q


def functions_of(shapes: ShapesGraph) -> dict[str, tuple[list[str], Query]]:
    """Custom SPARQL functions: parameters by sh:order, then by local name, and the query."""
    out = {}
    for node in shapes.subjects.get((TYPE, sh("SPARQLFunction")), []):
        for name in ("select", "ask", "returnType"):
            if len(shapes.values(node, name)) > 1:
                raise ConstraintLoadError(f"{node} has more than one sh:{name}")
        if shapes.values(node, "ask") and shapes.values(node, "returnType") not in ([], [f"<{XSD}boolean>"]):
            raise ConstraintLoadError(f"{node} answers by ASK, so its sh:returnType can only be xsd:boolean")
        text = shapes.values(node, "select") or shapes.values(node, "ask")
        if text:
            out[node] = ([n for n, _, _ in parameters(shapes, node)], read(shapes, node, lexical_of(text[0]), None))
    return out


def parameters(shapes: ShapesGraph, node: str) -> list[tuple[str, str, bool]]:
    """(local name, path, optional) of the parameters of a component, function or target type."""
    found = []
    for p in shapes.values(node, "parameter"):
        path = shapes.value(p, "path")
        if path is None or not path.startswith("<"):
            raise ConstraintLoadError(f"a parameter of {node} needs an IRI as its path")
        order = shapes.value(p, "order")
        name = re.split("[#/:]", path[1:-1])[-1]
        found.append((float(lexical_of(order)) if order else 0.0, name, path, TRUE in shapes.values(p, "optional")))
    return [(name, path, optional) for _, name, path, optional in sorted(found)]


#: The name of the shapes graph that $shapesGraph stands for.
SHAPES_GRAPH = "<urn:graphwright:shapes>"


def shapes_table(run) -> TripleTable:
    """The shapes as a table of triples: as many rows as their text has."""
    rows = [(s, p, o) for s, po in run.shapes.out.items() for p, values in po.items() for o in values]
    return TripleTable(run.graph.spark, run.graph.spark.createDataFrame(rows, "s string, p string, o string"))


def with_constants(part, given: dict[str, str]):
    """A part of a query in which variables stand for given terms: patterns then filter by these terms, and need no join with them."""
    if isinstance(part, Query):
        project = None if part.project is None else [(n, ("term", given[n]) if e is None and n in given else with_constants(e, given)) for n, e in part.project]
        changed = {f: with_constants(getattr(part, f), given) for f in ("where", "group", "having", "order", "template")}
        return replace(part, project=project, **changed)
    if isinstance(part, tuple) and len(part) == 2 and part[0] == "var" and part[1] in given:
        return ("term", given[part[1]])
    if isinstance(part, (tuple, list)):
        return type(part)(with_constants(x, given) for x in part)
    return part


def engine(run) -> Engine:
    if not hasattr(run, "sparql"):
        run.sparql = Engine(run.graph, functions_of(run.shapes) | functions_by_hook(run, parameters), shapes=lambda: shapes_table(run))
    return run.sparql


def _message(run, messages: list[str], columns: list[str], given: dict[str, str]) -> Column | None:
    """Templates with {$x} and {?x} replaced by selected variables and parameters."""
    def one(m: str) -> Column:
        text = F.lit(lexical_of(m))
        for name in set(re.findall(r"\{[?$](\w+)\}", lexical_of(m))):
            value = F.coalesce(F.col(f"`{name}`"), F.lit("")) if name in columns else F.lit(given[name]) if name in given else None
            if value is not None:
                for mark in ("{$%s}" % name, "{?%s}" % name):
                    text = F.replace(text, F.lit(mark), value)
        return text

    return F.array(*[one(m) for m in messages]) if messages else None


def _seed(nodes: DataFrame, found: DataFrame | None, given: dict[str, str]) -> DataFrame:
    base = nodes.select(F.col("f").alias("this")) if found is None else found.select(F.col("f").alias("this"), F.col("v").alias("value"))
    return base.select("*", *[F.lit(x).alias(n) for n, x in given.items()])


def _selected(run, shape: Shape, solved: DataFrame, path: str | None, component: str, messages, constraint: str | None = None, always: bool = False) -> DataFrame:
    columns = solved.columns
    value = F.col("value") if "value" in columns else (F.col("this") if shape.path is None else F.lit(None).cast("string"))
    out = solved.select(F.col("this").alias("f"), value.alias("v"), (F.when(F.startswith("path", F.lit("<")), F.col("path")) if "path" in columns else F.lit(None).cast("string")).alias("path"), (messages if messages is not None else F.array()).cast("array<string>").alias("m"))
    return run._rows(shape, out.distinct(), component, path, F.col("m"), constraint=constraint, always=always)


def sparql_results(run, shape: Shape, nodes: DataFrame, found: DataFrame, path: str | None) -> list[DataFrame]:
    shapes, out = run.shapes, []
    for node in shape.get("sparql"):
        if TRUE in shapes.values(node, "deactivated"):
            continue
        texts = shapes.values(node, "select")
        if not texts:
            raise ConstraintLoadError(f"{node} needs sh:select")
        bound = ("this", "shapesGraph", "currentShape", "value")
        q = read(shapes, node, lexical_of(texts[0]), path, bound)
        given = {n: x for n, x in (("currentShape", shape.node), ("shapesGraph", SHAPES_GRAPH)) if n in variables(q)}
        solved = engine(run).solve(q, _seed(nodes, None, given))
        messages = _message(run, shapes.values(node, "message") or shape.messages, solved.columns, {})
        out.append(_selected(run, shape, solved, path, "SPARQLConstraintComponent", messages, node))
    for node in shape.get("js"):
        if TRUE in shapes.values(node, "deactivated"):
            continue
        if (hook := hook_of(run, node)) is None:
            raise ConstraintLoadError(f"{node} needs sh:jsFunctionName")
        rows = found.select(F.col("f").alias("this"), F.col("v").alias("value"))
        out.append(_judged(run, shape, judged(run, hook, rows, {}), path, "JSConstraintComponent", shapes.values(node, "message") or shape.messages, {}, node))
    for component in _components(shapes):
        if got := _component(run, shape, component, nodes, found, path):
            out.append(got)
    for node in shape.get("expression"):
        values = expression_values(run, node, found.select(F.col("v").alias("f")).distinct()).groupBy("f").agg(F.collect_set("v").alias("x"))
        joined = found.join(values.withColumnRenamed("f", "v"), "v", "left").where(~F.coalesce(F.col("x") == F.array(F.lit(TRUE)), F.lit(False))).select("f", "v")
        messages = [*shapes.values(node, "message"), *shape.messages] if node in shapes.out else shape.messages
        text = F.array(*[F.lit(lexical_of(m)) for m in messages]) if messages else F.array(F.lit("The expression isn't true for this value."))
        out.append(run._rows(shape, joined, "ExpressionConstraintComponent", path, text, constraint=node))
    return out


def _judged(run, shape: Shape, solved: DataFrame, path: str | None, component: str, template: list[str], given: dict[str, str], constraint: str | None = None, always: bool = False) -> DataFrame:
    """Results of a hook: its own messages, else those of the shapes, else one for all."""
    other = _message(run, template, solved.columns, given)
    messages = F.when(F.size("m") > 0, F.col("m")).otherwise(other if other is not None else F.array(F.lit("A function finds this value wrong.")))
    return _selected(run, shape, solved, path, component, messages, constraint, always)


def _components(shapes: ShapesGraph) -> list[str]:
    kinds = [sh("ConstraintComponent"), *shapes.subjects.get((SUBCLASS, sh("ConstraintComponent")), [])]
    return [c for c in dict.fromkeys(s for k in kinds for s in shapes.subjects.get((TYPE, k), [])) if not c.startswith(f"<{SH}")]


def _component(run, shape: Shape, component: str, nodes: DataFrame, found: DataFrame, path: str | None) -> DataFrame | None:
    shapes = run.shapes
    wanted = parameters(shapes, component)
    if all(optional for *_, optional in wanted) or any(not optional and p not in shape.params for _, p, optional in wanted):
        return None
    given = {n: shape.params[p][0] for n, p, _ in wanted if p in shape.params}
    if any(n in RESERVED for n in given):
        raise ConstraintLoadError(f"a parameter of {component} has a reserved name")
    names = ("propertyValidator",) if shape.path is not None else ("nodeValidator",)
    validator = next((v for n in (*names, "validator") for v in shapes.values(component, n)), None)
    if validator is None:
        return None
    bound = ("this", "value", *given)
    template = shapes.values(validator, "message") or shapes.values(component, "message") or shape.messages
    shown = {n: lexical_of(x) for n, x in given.items()}
    if (hook := hook_of(run, validator)) is not None:
        # A validator for property shapes is asked once for a focus node, others once for each value.
        if whole := validator in shapes.values(component, "propertyValidator"):
            rows = nodes.select(F.col("f").alias("this"), F.lit(None).cast("string").alias("value"))
        else:
            rows = found.select(F.col("f").alias("this"), F.col("v").alias("value"))
        solved = judged(run, hook, rows.distinct(), given | ({"path": path} if whole else {}))
        return _judged(run, shape, solved, path, component, template, shown, always=True)
    if asks := shapes.values(validator, "ask"):
        q = read(shapes, validator, lexical_of(asks[0]), path, bound)
        seed = _seed(nodes, found, given)
        good = engine(run).solve(q, seed).select("this", "value").distinct().withColumn("_good", F.lit(True))
        bad = seed.join(good, ["this", "value"], "left").where("_good IS NULL").drop("_good")
        messages = _message(run, template, bad.columns, shown)
        return _selected(run, shape, bad, path, component, messages, always=True)
    q = read(shapes, validator, lexical_of(shapes.values(validator, "select")[0]), path, bound)
    solved = engine(run).solve(q, _seed(nodes, None, given))
    if "failure" in solved.columns and (failed := solved.where(F.coalesce(c_truth(F.col("failure")), F.lit(False))).select("this").first()):
        raise ValidationFailure(f"the validator of {component} failed at {failed['this']}")
    return _selected(run, shape, solved, path, component, _message(run, template, solved.columns, shown), always=True)


def custom_target(run, node: str) -> DataFrame:
    """Focus nodes of sh:target: a SPARQL target, one by a hook, or an instance of a type of these with its parameters."""
    shapes = run.shapes
    for owner in (node, *shapes.values(node, TYPE)):
        if (hook := hook_of(run, owner)) is not None:
            given = {n: shapes.values(node, p)[0] for n, p, _ in parameters(shapes, owner) if shapes.values(node, p)} if owner != node else {}
            return chosen(run, hook, node, given)
    if texts := shapes.values(node, "select"):
        return engine(run).solve(read(shapes, node, lexical_of(texts[0]), None)).select(F.col("this").alias("f"))
    for kind in shapes.values(node, TYPE):
        if texts := shapes.values(kind, "select"):
            given = {n: shapes.values(node, p)[0] for n, p, _ in parameters(shapes, kind) if shapes.values(node, p)}
            q = with_constants(read(shapes, kind, lexical_of(texts[0]), None), given)
            return engine(run).solve(q).select(F.col("this").alias("f"))
    raise ConstraintLoadError(f"the target {node} can't be evaluated")


