"""Query test cases: rows, their order, unbound cells, and what isn't one."""

import json

import pytest

from graphwright.operators.query_tests import check_query, expected_rows, numbered, run_query_tests
from graphwright.plans.shapes import ReportableRuntimeError, ShapesGraph
from graphwright.plans.sparql import Engine
from graphwright.sources.graph import from_text

PREFIXES = {"ex": "urn:ex:"}
DATA = "@prefix ex: <urn:ex:> . ex:a ex:p 3 . ex:b ex:p 1 . ex:c ex:p 1 . ex:d ex:p 2 ; ex:q ex:z . "
ORDERED = "SELECT ?s ?z WHERE { ?s ex:p ?v OPTIONAL { ?s ex:q ?z } } ORDER BY ?v"
#: The order of a bag means nothing.
BAG = ORDERED.replace(" ORDER BY ?v", "")


def told(*names, variables=("s", "z")):
    row = lambda n: {"s": {"type": "uri", "value": f"urn:ex:{n}"}} | ({"z": {"type": "uri", "value": "urn:ex:z"}} if n == "d" else {})
    return json.dumps({"head": {"vars": list(variables)}, "results": {"bindings": [row(n) for n in names]}})


@pytest.mark.parametrize(
    "query, rows, passed",
    [
        (ORDERED, "bcda", True), (ORDERED, "cbda", True), (ORDERED, "bdca", False), (ORDERED, "bcd", False), (ORDERED, "bcdaa", False), (ORDERED, "bbda", False), (ORDERED, "", False),
        (BAG, "dacb", True), (BAG, "dacbb", False), (BAG, "dab", False), (BAG + " LIMIT 0", "", True), (ORDERED + " LIMIT 2", "bc", True), (ORDERED + " LIMIT 2 OFFSET 2", "da", True),
    ],
)
def test_rows(spark, query, rows, passed):
    got = check_query(Engine(from_text(spark, DATA)), query, PREFIXES, expected_rows(spark, told(*rows)))
    assert got.passed == passed and (got.message is None) == passed


def test_other_variables(spark):
    got = check_query(Engine(from_text(spark, DATA)), BAG, PREFIXES, expected_rows(spark, told("a", variables=("s",))))
    assert not got.passed and "variables" in got.message


def test_literals(spark):
    bindings = [{"v": {"type": "literal", "value": "x", "xml:lang": "en"}}, {"v": {"type": "literal", "value": "x"}}, {"v": {"type": "typed-literal", "value": "1", "datatype": "urn:ex:t"}}]
    text = json.dumps({"head": {"vars": ["v"]}, "results": {"bindings": bindings}})
    graph = from_text(spark, '@prefix ex: <urn:ex:> . ex:a ex:p "x"@en , "x" , "1"^^ex:t .')
    assert check_query(Engine(graph), "SELECT ?v WHERE { ?s ex:p ?v }", PREFIXES, expected_rows(spark, text)).passed


def test_cases_of_a_graph(spark):
    case = "ex:%s a dash:QueryTestCase ; sh:prefixes ex: ; sh:select '%s' ; dash:expectedResult '%s' . "
    text = "@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix dash: <http://datashapes.org/dash#> . " + DATA + 'ex: sh:declare [ sh:prefix "ex" ; sh:namespace "urn:ex:" ] . '
    got = run_query_tests(spark, ShapesGraph.from_text(text + case % ("good", ORDERED, told(*"bcda")) + case % ("bad", ORDERED, told(*"abcd"))))
    assert {n: t.passed for n, t in got.items()} == {"<urn:ex:good>": True, "<urn:ex:bad>": False}
    with pytest.raises(ReportableRuntimeError):
        run_query_tests(spark, ShapesGraph.from_text(text + "ex:none a dash:QueryTestCase ."))


@pytest.mark.parametrize("text", ["no JSON", "{}", '{"head": {"vars": ["v"]}, "results": {"bindings": [{"v": {"type": "odd", "value": ""}}]}}'])
def test_what_is_no_result(spark, text):
    with pytest.raises(ReportableRuntimeError):
        expected_rows(spark, text)
    with pytest.raises(ReportableRuntimeError):
        check_query(Engine(from_text(spark, DATA)), "ASK { ?s ?p ?o }", PREFIXES, expected_rows(spark, told()))


def test_numbers_over_many_parts(spark):
    frame = spark.range(1000, numPartitions=7).selectExpr("(id * 37) % 1000 AS x").repartition(5).orderBy("x")
    assert [(r._at, r.x) for r in numbered(frame).orderBy("_at").collect()] == [(i, i) for i in range(1000)]
