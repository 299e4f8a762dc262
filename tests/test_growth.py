"""What larger tables show: ties between keys of different lengths, classes of many equal nodes, shares of a task."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
@pytest.mark.parametrize("name", ["s_order", "s_offset"])
def test_ties_of_keys_of_different_lengths_are_in_the_order_of_the_sql(spark, tmp_path, name):
    part, con = f"{tmp_path}/part.parquet", duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (k AS p_partkey, 900.0 AS p_retailprice) FROM (SELECT * FROM '{SF}/part.parquet' LIMIT 1), range(1, 2000) t(k)) TO '{part}' (FORMAT parquet)")
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{part}'")
    got = [(r["p"], r["s"]) for r in entry.queries()[name](spark, str(tmp_path)).collect()]
    assert got == con.execute(entry.oracle_sql()[name]).fetchall()


def test_classes_in_blocks_are_the_same_closure_and_no_key_has_a_whole_class(spark):
    from graphwright.operators.equality import expanded

    names = [f"<urn:n:{i:03}>" for i in range(90)]
    equal = spark.createDataFrame([(n, names[0]) for n in names[:60]] + [(n, names[60]) for n in names[60:62]] + [("<urn:p>", "<urn:p>"), ("<urn:q>", "<urn:p>")], "node string, rep string")
    triples = spark.createDataFrame([(names[0], "<urn:same>", names[0]), (names[60], "<urn:p>", names[0]), (names[70], "<urn:p>", names[71])], "s string, p string, o string")
    want = {(a, "<urn:same>", b) for a in names[:60] for b in names[:60]} | {(a, p, b) for a in names[60:62] for b in names[:60] for p in ("<urn:p>", "<urn:q>")}
    want |= {(names[70], p, names[71]) for p in ("<urn:p>", "<urn:q>")}
    got = [tuple(r) for r in expanded(triples, equal, block=7).collect()]
    assert len(got) == len(want) and set(got) == want == {tuple(r) for r in expanded(triples, equal).collect()}
    from pyspark.sql import functions as F

    same = expanded(triples, equal, block=7).where("p = '<urn:same>'")
    parts = [r["count"] for r in same.groupBy(F.spark_partition_id()).count().collect()]
    assert len(parts) > 20 and max(parts) < 1000


def test_a_run_has_small_tasks_unless_the_session_has_its_own_size(spark):
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    try:
        for given, want in (("64m", "8m"), ("5m", "5m"), ("67108864b", "8m")):
            spark.conf.set(name, given)
            entry.queries()["v_min_inclusive"](spark, SF)
            assert spark.conf.get(name) == want
    finally:
        spark.conf.set(name, before)


def test_shapes_within_one_another_are_not_one_stage(spark):
    plan = entry.queries()["l_nested_not"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") <= 8


@pytest.mark.parametrize("path", ["( ex:in [ sh:inversePath ex:at ] ex:at )", "( ( ex:in [ sh:inversePath ex:at ] ) ex:at )", "( ex:in [ sh:inversePath ( [ sh:inversePath ex:at ] ex:at ) ] )"])
def test_a_sequence_goes_on_from_distinct_nodes(spark, path):
    """40 nodes and 30 others meet in one place: what each of the 40 reaches beyond the 30 is one row, not 30."""
    from graphwright.operators.paths import follow
    from graphwright.plans.shapes import ShapesGraph
    from graphwright.sources.graph import from_text

    head = "@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix ex: <urn:ex:> .\n"
    data = " ".join(f"ex:n{i} ex:in ex:p{i % 2} ." for i in range(80)) + " ".join(f"ex:m{i} ex:at ex:p0 , ex:q{i % 3} ." for i in range(30))
    shapes = ShapesGraph.from_text(head + f"ex:S a sh:PropertyShape ; sh:path {path} .")
    nodes = spark.createDataFrame([(f"<urn:ex:n{i}>",) * 2 for i in range(80)], "f string, v string")
    got = [tuple(r) for r in follow(from_text(spark, head + data), nodes, shapes.path(shapes.value("<urn:ex:S>", "path"))).collect()]
    want = {(f"<urn:ex:n{i}>", f"<urn:ex:{v}>") for i in range(0, 80, 2) for v in ("p0", "q0", "q1", "q2")}
    assert len(got) == len(want) and set(got) == want
