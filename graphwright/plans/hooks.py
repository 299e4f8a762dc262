"""Python functions in shapes, where SHACL's JavaScript extension has functions: constraints (sh:js), validators of components, functions,
rules, targets and target types. A shape names a function by sh:jsFunctionName; the run has a ``Hook`` for the name. sh:jsLibrary isn't read.

A function runs in the tasks, over Arrow batches, and gets terms as texts. What it may see of the graph are the triples of the predicates
``sees`` whose subject is the node that it is asked for: ``seen[node][predicate]`` is the sorted list of objects. No function has the whole graph.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.terms import FALSE, TRUE, TYPE, XSD, lexical_of
from ..sources.graph import Graph
from .settle import settle
from .shapes import ConstraintLoadError, ReportableRuntimeError, ValidationFailure, sh


@dataclass(frozen=True)
class Hook:
    """``sees``: predicates, as terms. A node with more than ``most`` triples of them is a ValidationFailure: none is left out unsaid, and
    no task has to hold more for a node."""

    function: Callable
    sees: tuple[str, ...] = ()
    most: int = 1000


def hook_of(run, node: str) -> Hook | None:
    """The hook that a node names; None if it names none."""
    names = run.shapes.values(node, "jsFunctionName")
    if not names:
        return None
    if len(names) > 1:
        raise ConstraintLoadError(f"{node} names more than one function")
    if (name := lexical_of(names[0])) not in run.hooks:
        raise ReportableRuntimeError(f"{node} asks for the function {name}, and the run has no hook of that name")
    return run.hooks[name]


def to_term(x) -> str | None:
    """A term for what a function answers: terms stay, other texts, numbers and truth values become literals; None stays None."""
    if x is None:
        return None
    if isinstance(x, bool):
        return TRUE if x else FALSE
    if isinstance(x, str):
        return x if x[:2] == "_:" or (x[:1] == "<" and x[-1:] == ">") or (x[:1] == '"' and '"' in x[1:]) else f'"{x}"^^<{XSD}string>'
    if isinstance(x, (int, float)):
        return f'"{x}"^^<{XSD}{"integer" if isinstance(x, int) else "double"}>'
    raise TypeError(f"{x!r} is no term")


def _mapped(rows: DataFrame, schema: str, make: Callable[[dict], Iterable[dict]]) -> DataFrame:
    """The rows that ``make`` gives for each row."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([made for row in batch.to_pylist() for made in make(row)], schema=arrow)

    return rows.mapInArrow(run, schema)


def _with_seen(graph: Graph, hook: Hook, rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The rows with ``seen_`` columns: the triples that the hook may see of the node in each of the columns."""
    if not hook.sees:
        return rows
    nodes = settle(reduce(DataFrame.unionByName, [rows.select(F.lit(c).alias("c"), F.col(c).alias("n")) for c in columns]).where(~F.startswith("n", F.lit('"'))).distinct())
    told = reduce(DataFrame.unionByName, [graph.pred(p).select(F.col("s").alias("n"), F.lit(p).alias("p"), "o") for p in hook.sees])
    told = settle(told.join(nodes.select("n"), "n", "left_semi").distinct())
    if many := told.groupBy("n").count().where(F.col("count") > hook.most).first():
        raise ValidationFailure(f"{many['n']} has {many['count']} triples that a function asks to see, more than {hook.most}")
    told = told.groupBy("n").agg(F.collect_list(F.struct("p", "o")).alias("seen"))
    # No literal is a subject: it gets a key that meets none and that repeated values don't share.
    key = lambda c: F.when(F.startswith(c, F.lit('"')), F.concat(F.lit('"'), F.xxhash64(*columns).cast("string"))).otherwise(F.col(c))
    for c in columns:
        if nodes.where(F.col("c") == c).isEmpty():  # literals all
            continue
        rows = rows.withColumn("_n", key(c)).join(told.select(F.col("n").alias("_n"), F.col("seen").alias(f"seen_{c}")), "_n", "left").drop("_n")
    return rows


def _seen(row: dict, columns: tuple[str, ...]) -> dict[str, dict[str, list[str]]]:
    out: dict[str, dict[str, list[str]]] = {}
    for c in columns:
        if row[c] is not None:
            out[row[c]] = found = {}
            for x in row.get(f"seen_{c}") or ():
                found.setdefault(x["p"], []).append(x["o"])
            for objects in found.values():
                objects.sort()
    return out


def judged(run, hook: Hook, rows: DataFrame, given: dict[str, str]) -> DataFrame:
    """(this, value, path, m): what ``function(this, value, seen, **given)`` finds wrong with the rows (this, value). It answers True or None if
    all is well, False, a message, a dict of ``value``, ``path`` and ``message`` as far as it has them, or a list of such answers."""
    function, columns = hook.function, ("this", "value")

    def make(row: dict) -> Iterator[dict]:
        answer = function(row["this"], row["value"], _seen(row, columns), **given)
        for x in answer if isinstance(answer, (list, tuple)) else [answer]:
            if x is None or x is True:
                continue
            if x is not False and not isinstance(x, (str, dict)):
                raise TypeError(f"a constraint's function answered {x!r}")
            told = x if isinstance(x, dict) else {"message": x} if isinstance(x, str) else {}
            yield {"this": row["this"], "value": to_term(told.get("value", row["value"])), "path": told.get("path"), "m": [told["message"]] if "message" in told else []}

    return _mapped(_with_seen(run.graph, hook, rows, columns), "this string, value string, path string, m array<string>", make)


def answered(hook: Hook, arguments: DataFrame, names: list[str]) -> DataFrame:
    """Arguments with ``_result``: the answer of ``function(*arguments)``, which sees no triples; None is no answer."""
    function = hook.function
    schema = ", ".join(f"`{n}` string" for n in [*names, "_result"])
    return _mapped(arguments.select(*names), schema, lambda row: [row | {"_result": to_term(function(*[row[n] for n in names]))}])


def inferred(run, hook: Hook, nodes: DataFrame) -> DataFrame:
    """(s, p, o): the triples that ``function(this, seen)`` gives for the nodes (f)."""
    function = hook.function
    rows = _with_seen(run.graph, hook, nodes.select(F.col("f").alias("this")), ("this",))
    make = lambda row: [dict(zip("spo", map(to_term, x), strict=True)) for x in function(row["this"], _seen(row, ("this",))) or ()]
    return _mapped(rows, "s string, p string, o string", make).distinct()


def chosen(run, hook: Hook, node: str, given: dict[str, str]) -> DataFrame:
    """(f): the subjects of the predicates ``sees`` for which ``function(this, seen, **given)`` is true."""
    if not hook.sees:
        raise ConstraintLoadError(f"the function of the target {node} has to see a predicate, whose subjects it is asked about")
    function = hook.function
    nodes = reduce(DataFrame.unionByName, [run.graph.pred(p).select(F.col("s").alias("this")) for p in hook.sees]).distinct()
    make = lambda row: [{"f": row["this"]}] if function(row["this"], _seen(row, ("this",)), **given) else []
    return _mapped(_with_seen(run.graph, hook, nodes, ("this",)), "f string", make)


def functions_by_hook(run, parameters: Callable) -> dict[str, tuple[list[str], Hook]]:
    """Functions of SPARQL and of node expressions: parameters and hook."""
    return {n: ([p for p, *_ in parameters(run.shapes, n)], hook_of(run, n)) for n in run.shapes.subjects.get((TYPE, sh("JSFunction")), []) if run.shapes.values(n, "jsFunctionName")}
