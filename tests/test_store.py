"""Stored graphs: numbers of terms, joins without a shuffle, hot nodes, named graphs."""

import pytest
from pyspark.sql import functions as F

from graphwright.plans.sparql import Engine
from graphwright.plans.sparql_parser import parse_query
from graphwright.sources.graph import TripleTable, from_text, mapped
from graphwright.sources.store import StoredGraph, hot_nodes, move_clashing, number_terms, open_store, write_store

TEXT = "@prefix e: <urn:e:> . " + " ".join(f"e:a{i} e:p e:b{i % 7} ; e:q {i} ." for i in range(40)) + " ".join(f"e:b{i} e:r e:c{i % 2} ; e:r e:b{i} ." for i in range(7))
QUERY = "SELECT ?a ?n ?c WHERE { ?a <urn:e:p> ?b . ?a <urn:e:q> ?n . ?b <urn:e:r> ?c }"


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.fixture
def graph(spark):
    return from_text(spark, TEXT)


@pytest.fixture
def large(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_terms_of_one_hash_get_other_numbers(spark):
    terms = spark.range(200).select(F.concat(F.lit("<t"), F.col("id").cast("string"), F.lit(">")).alias("term"))
    terms, hashed = terms.unionByName(terms), lambda c, turn: F.pmod(F.xxhash64(c, F.lit(turn)), F.lit(997))
    first = number_terms(terms, hashed)
    moved = move_clashing(terms, first, hashed)
    got = first.select("term", "id").unionByName(moved).collect()
    assert len(got) == 200 == len({r["id"] for r in got}) == len({r["term"] for r in got})
    assert 0 < moved.count() < 100


@pytest.mark.parametrize("clashing", [False, True])
def test_same_graph_and_answers(spark, graph, tmp_path, clashing):
    hashed = (lambda c, turn: F.pmod(F.xxhash64(c, F.lit(turn)), F.lit(2003))) if clashing else None
    options = {"hashed": hashed} if clashing else {}
    stored = write_store(graph, str(tmp_path / "s"), 4, **options)
    assert rows(stored.triples()) == rows(graph.triples())
    assert rows(stored.pred("<urn:e:r>")) == rows(graph.pred("<urn:e:r>"))
    for text in (QUERY, "SELECT ?p ?o WHERE { <urn:e:b3> ?p ?o . ?o ?p ?o2 }", "SELECT ?x WHERE { ?x <urn:e:r> ?x . ?a <urn:e:p> ?x }", "SELECT ?a WHERE { ?a <urn:e:none> ?b . ?a <urn:e:p> ?b }"):
        q = parse_query(text)
        want, got = rows(Engine(graph).solve(q)), rows(Engine(stored).solve(q))
        assert got == want and (want or "none" in text)
    again = open_store(spark, str(tmp_path / "s"), **options)
    assert rows(Engine(again).solve(parse_query(QUERY))) == rows(Engine(graph).solve(parse_query(QUERY)))


def test_joins_of_patterns_need_no_shuffle(spark, graph, tmp_path, large):
    stored = write_store(graph, str(tmp_path / "s"), 4)
    star = stored.solution_numbers([("?a", "<urn:e:p>", "?b"), ("?a", "<urn:e:q>", "?n")])
    step = stored.solution_numbers([("?a", "<urn:e:p>", "?b"), ("?b", "<urn:e:r>", "?c")])
    for found in (star, step):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    both = stored.solution_numbers([("?a", "<urn:e:p>", "?b"), ("?a", "<urn:e:q>", "?n"), ("?b", "<urn:e:r>", "?c"), ("?b", "<urn:e:r>", "?d")])
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # what was found around ?b, on its way to ?a


def test_hot_nodes_lie_outside_the_buckets(spark, graph, tmp_path):
    every = write_store(graph, str(tmp_path / "h"), 64, hot_rows=1)
    assert every.hot["o"] and every.hot["s"]
    assert rows(every.triples()) == rows(graph.triples())
    assert rows(Engine(every).solve(parse_query(QUERY))) == rows(Engine(graph).solve(parse_query(QUERY)))
    assert rows(Engine(open_store(spark, str(tmp_path / "h"))).solve(parse_query(QUERY))) == rows(Engine(graph).solve(parse_query(QUERY)))


def test_named_and_empty_graphs(spark, tmp_path):
    graph = from_text(spark, "@prefix e: <urn:e:> . e:a e:p e:b . GRAPH e:g { e:a e:p e:b , e:c } GRAPH e:h { e:a e:p e:b }", name="x.trig")
    stored = write_store(graph, str(tmp_path / "s"), 2)
    assert isinstance(stored, StoredGraph) and stored.named_graphs
    assert rows(stored.triples()) == [("<urn:e:a>", "<urn:e:p>", "<urn:e:b>"), ("<urn:e:a>", "<urn:e:p>", "<urn:e:c>")]
    assert rows(stored.quads()) == rows(graph.quads())
    assert rows(stored.named("<urn:e:h>").triples()) == [("<urn:e:a>", "<urn:e:p>", "<urn:e:b>")]
    empty = write_store(TripleTable(spark, spark.createDataFrame([], "s string, p string, o string")), str(tmp_path / "e"), 2)
    assert rows(empty.triples()) == []


def test_values_of_few_valued_predicates_need_no_shuffle(spark, tmp_path, large):
    graph = mapped(spark, "/root/testdata/sf0.01", ("customer",))
    stored = write_store(graph, str(tmp_path / "s"), 4, hot_rows=100)
    names = [f"<urn:ex:c_{x}>" for x in ("mktsegment", "nationkey", "name")]
    assert names[0] in stored.few and names[1] in stored.few and names[2] not in stored.few
    found = stored.decoded(stored.solution_numbers([("?c", names[0], "?m"), ("?c", names[1], "?n")]).select("m", "n"), ["m", "n"], frozenset("mn"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hash" not in plan
    q = parse_query(f"SELECT ?c ?m ?n ?t WHERE {{ ?c {names[0]} ?m . ?c {names[1]} ?n . ?c {names[2]} ?t }}")
    assert rows(Engine(stored).solve(q)) == rows(Engine(graph).solve(q))
    assert open_store(spark, str(tmp_path / "s")).few == stored.few
    assert rows(stored.triples()) == rows(graph.triples().distinct())


def test_terms_of_a_table_are_given_once_a_row(spark):
    graph = mapped(spark, "/root/testdata/sf0.001", ("customer", "orders"))
    every = graph.each_term()
    triples = graph.triples()
    want = triples.select("s").union(triples.select("p")).union(triples.select("o")).distinct()
    assert rows(every.distinct()) == rows(want)
    assert every.count() < triples.count() * 1.5


def test_hot_nodes_are_those_of_a_count(spark):
    quads = spark.range(3000).select(F.xxhash64(F.col("id") % 40).alias("s"), (F.col("id") % 7).alias("o")).unionByName(spark.range(500).select(F.lit(1).cast("long").alias("s"), F.lit(1 + (1 << 16)).cast("long").alias("o")))
    for side, limit in (("s", 80), ("s", 74), ("s", 600), ("o", 430), ("o", 499)):
        assert sorted(hot_nodes(quads, side, limit)) == sorted(r[side] for r in quads.groupBy(side).count().where(F.col("count") > limit).collect())
