"""Query test cases: a SELECT query with the rows that it has to give, as SPARQL JSON in a graph or as a frame of any size."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.terms import TYPE, XSD, lexical_of
from ..plans.settle import settle
from ..plans.shapes import ReportableRuntimeError, ShapesGraph
from ..plans.sparql import Engine
from ..plans.sparql_parser import SparqlError, parse_query
from ..plans.sparql_shapes import functions_of, prefixes_of
from ..sources.graph import Graph, TripleTable

DASH = "http://datashapes.org/dash#"


def numbered(frame: DataFrame) -> DataFrame:
    """The rows with ``_at``, their places from 0 in the order that a sorted frame has. Only a row a partition meets in one task: its size."""
    placed = settle(frame.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id")))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", (before - F.col("_first")).alias("_shift"))
    return placed.join(F.broadcast(starts), "_part").select(*frame.columns, (F.col("_id") + F.col("_shift")).alias("_at"))


def differences(actual: DataFrame, expected: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The rows that the two have in different numbers, with ``surplus``: how many more ``actual`` has (negative: fewer). Unbound is null, and
    like null only. With ``order`` both also have ``_at``, and ``order`` names columns of ``actual`` alone, by which it is sorted: a row then has
    to stand among the rows of the same values of these. Rows that the order leaves open may be in any order, and one that is out of its place
    is missing there and too much where it stands. Without ``order`` both are bags."""
    names = [c for c in expected.columns if c != "_at"]
    keys = [f"`{c}`" for c in names]
    if order is not None:
        places = actual.select("_at", *[F.col(f"`{c}`") for c in order])
        expected = expected.join(places, "_at", "left")
        keys += [f"`{c}`" for c in order]
    both = actual.select(*keys, F.lit(1).alias("_n")).unionByName(expected.select(*keys, F.lit(-1).alias("_n")))
    return both.groupBy(*keys).agg(F.sum("_n").alias("surplus")).where("surplus != 0").select(*[F.col(f"`{c}`") for c in names], "surplus")


@dataclass
class QueryTest:
    passed: bool
    message: str | None = None
    #: The rows that differ (``differences``), if the variables are the same.
    wrong: DataFrame | None = None


def expected_rows(spark: SparkSession, text: str) -> DataFrame:
    """Rows of SPARQL JSON with their place ``_at``: a column of terms for each variable, null where it is unbound."""
    try:
        told = json.loads(text)
        names, rows = told["head"]["vars"], told["results"]["bindings"]
        made = [(i, *[_json_term(row[n]) if n in row else None for n in names]) for i, row in enumerate(rows)]
    except (ValueError, KeyError, TypeError) as e:
        raise ReportableRuntimeError(f"the expected result isn't SPARQL JSON: {e!r}") from e
    return spark.createDataFrame(made, ", ".join(["_at long", *[f"`{n}` string" for n in names]]))


def _json_term(x: dict) -> str:
    kind, value = x["type"], x["value"]
    if kind == "uri":
        return f"<{value}>"
    if kind == "bnode":
        return f"_:{value}"
    if kind not in ("literal", "typed-literal"):
        raise ValueError(f"{kind} is no type of term")
    return f'"{value}"@{x["xml:lang"]}' if "xml:lang" in x else f'"{value}"^^<{x.get("datatype", XSD + "string")}>'


def check_query(engine: Engine, query: str, prefixes: dict[str, str], expected: DataFrame) -> QueryTest:
    """A SELECT query against its expected rows (a column of terms for each variable, and for a query with ORDER BY their places ``_at``, from 0)."""
    try:
        q = parse_query(query, prefixes)
    except SparqlError as e:
        raise ReportableRuntimeError(f"the query can't be read: {e}") from e
    if q.form != "SELECT":
        raise ReportableRuntimeError("a query test case asks by SELECT")
    engine.keep_order = q
    actual = engine.solve(q)
    by = [f"_order{i}" for i in range(len(q.order))]
    names, wanted = [c for c in actual.columns if c not in by], [c for c in expected.columns if c != "_at"]
    if set(names) != set(wanted):
        return QueryTest(False, f"the variables are {', '.join(sorted(names))} and not {', '.join(sorted(wanted))}")
    if q.order:
        actual = numbered(actual)
    wrong = differences(actual, expected, by if q.order else None)
    first = wrong.first()
    if first is None:
        return QueryTest(True, None, wrong)
    row = ", ".join(f"?{n} = {first[n]}" for n in wanted)
    return QueryTest(False, f"{abs(first['surplus'])} {'more' if first['surplus'] > 0 else 'fewer'} than expected, or out of place: {row}", wrong)


def run_query_tests(spark: SparkSession, tests: ShapesGraph, data: Graph | None = None) -> dict[str, QueryTest]:
    """Each dash:QueryTestCase of a graph of tests: its sh:select over the data, or over the graph of tests itself, against dash:expectedResult."""
    if data is None:
        rows = [(s, p, o) for s, po in tests.out.items() for p, values in po.items() for o in values]
        data = TripleTable(spark, spark.createDataFrame(rows, "s string, p string, o string"))
    out = {}
    for node in tests.subjects.get((TYPE, f"<{DASH}QueryTestCase>"), []):
        given = [tests.value(node, "select"), tests.value(node, f"<{DASH}expectedResult>")]
        if None in given:
            raise ReportableRuntimeError(f"the test case {node} needs sh:select and dash:expectedResult")
        query, text = map(lexical_of, given)
        out[node] = check_query(Engine(data, functions_of(tests)), query, prefixes_of(tests, node), expected_rows(spark, text))
    return out
