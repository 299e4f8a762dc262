"""Turtle and other files read by tasks, against the parser of whole texts; the writer; isomorphism."""

import random

import pytest
from pyspark.sql import functions as F

from graphwright.api import load
from graphwright.operators.isomorphism import canonical, isomorphic
from graphwright.sources import files
from graphwright.sources.graph import TripleTable, from_text

HARD = '''@prefix ex: <urn:ex:> .
# a comment with "quotes" and a . full stop
PREFIX a: <urn:a#>
@base <http://base.example/x/> .
ex:s ex:p "one . two" , """long
text . with \\""" quotes # no comment
[ ( { and lines .
""" ; ex:q <rel> , 1.5 , 2e3 , -4 , true .
ex:s2 ex:p [ ex:q ( 1 2 [ ex:r "x" ] ) ; ex:r \'\'\'single
. ''
end\'\'\'@en-GB ] . _:lab ex:p _:lab2 .
@prefix ex: <urn:other:> .
ex:s ex:p a:x , "it's" , 'say "no"' .
<#frag> ex:p <http://h.example/a#b> . # last
_:lab a ex:T .
GRAPH <urn:g> { ex:a ex:b ex:c . ex:d ex:e "in . graph" }
ex:dotted.name ex:p ex:o.o .
'''


@pytest.mark.parametrize("chunk", [1, 200])
def test_turtle_in_chunks_of_any_size(spark, tmp_path, chunk):
    """Cut at every line, in a few places and nowhere: the same triples, whatever statement, text or block a cut falls into."""
    (tmp_path / "one.ttl").write_text(HARD, newline="")
    got = files.read_turtle(spark, str(tmp_path / "one.ttl"), chunk)
    want = from_text(spark, HARD, name="one.trig")
    named = "s NOT LIKE '\\_:%' AND o NOT LIKE '\\_:%'"
    rows = lambda g: sorted(map(str, g.frame.where(named).collect()))
    assert rows(got) == rows(want) and got.frame.count() == want.frame.count()
    assert isomorphic(got.triples(), want.triples())


def test_blocks_of_a_file_dealt_to_many_tasks(spark, tmp_path):
    rng = random.Random(2)
    text = ["@prefix ex: <urn:ex:> ."]
    for i in range(3000):
        value = rng.choice(['"a"', f'"""t{i} .\n@prefix ex: <urn:wrong:> .\n{"x" * rng.randint(0, 200)}"""', f"[ ex:q {i} ]", f"( {i} ex:m )"])
        text.append(f"ex:s{i} ex:p {value} ;\n   ex:n {i} .")
    whole = "\n".join(text)
    (tmp_path / "big.ttl").write_text(whole)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = files.read_turtle(spark, str(tmp_path / "big.ttl"), 3000)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = from_text(spark, whole)
    assert got.frame.count() == want.frame.count()
    plain = lambda g: {tuple(r) for r in g.triples().where("p = '<urn:ex:n>' OR o LIKE '\"%'").where("s LIKE '<%'").collect()}
    assert plain(got) == plain(want) and len(plain(got)) > 3000


def test_blank_nodes_of_files_stay_apart_and_errors_are_told(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.ttl").write_text(f"@prefix {name}: <urn:{name}:> . _:x {name}:p 1 . [] {name}:p 2 .")
    (tmp_path / "empty.ttl").write_text("")
    got = files.read_turtle(spark, str(tmp_path / "*.ttl")).triples().collect()
    assert len(got) == 4 and len({r.s for r in got}) == 4
    (tmp_path / "bad.ttl").write_text("<urn:a> <urn:b> .\n")
    with pytest.raises(Exception, match="a term expected"):
        files.read_turtle(spark, str(tmp_path / "bad.ttl")).frame.count()


def test_other_formats_a_file_a_task(spark, tmp_path):
    (tmp_path / "a.rdf").write_text('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="urn:e:"><rdf:Description rdf:about="urn:a"><e:p>x</e:p></rdf:Description></rdf:RDF>')
    (tmp_path / "b.jsonld").write_text('{"@id": "urn:b", "urn:e:p": "y"}')
    got = {(r.s, r.o.split('"')[1]) for r in files.read_documents(spark, [str(tmp_path / "a.rdf"), str(tmp_path / "b.jsonld")]).triples().collect()}
    assert got == {("<urn:a>", "x"), ("<urn:b>", "y")}


def test_load_reads_large_files_by_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("graphwright.api.SMALL_FILE", 10)
    (tmp_path / "one.ttl").write_text(HARD)
    assert load(spark, str(tmp_path / "one.ttl")).count() == from_text(spark, HARD, name="x.trig").count()


def test_written_turtle_reads_back(spark, tmp_path):
    terms = ['"a\\b\n\"q\"\t"^^<http://www.w3.org/2001/XMLSchema#string>', '"x"@en', '"5"^^<http://www.w3.org/2001/XMLSchema#integer>', "<urn:ex:name>", "<urn:ex:not/a/name>", "<urn:x:y>", "_:b"]
    rows = [(f"<urn:ex:s{i % 3}>", "<urn:ex:p>", o) for i, o in enumerate(terms * 2)]
    frame = spark.createDataFrame(rows, "s string, p string, o string").distinct()
    files.write_turtle(frame.repartition(3).sortWithinPartitions("s"), str(tmp_path / "out"), {"ex": "urn:ex:", "xsd": "http://www.w3.org/2001/XMLSchema#"})
    back = files.read_turtle(spark, str(tmp_path / "out"))
    plain = lambda f: {tuple(r) for r in f.where("o NOT LIKE '\\_:%'").collect()}
    assert plain(back.triples()) == plain(frame)
    quads = spark.createDataFrame([("<urn:ex:a>", "<urn:ex:p>", f"<urn:ex:o{i}>", f"<urn:ex:g{i % 2}>" if i else None) for i in range(7)], "s string, p string, o string, g string")
    files.write_turtle(quads.coalesce(1), str(tmp_path / "trig"))
    assert {tuple(r) for r in files.read_turtle(spark, str(tmp_path / "trig")).frame.collect()} == {tuple(r) for r in quads.collect()}


# Isomorphism


def _graph(spark, rows):
    return spark.createDataFrame([(s, "<urn:p>" if len(r) == 0 else r[0], o) for s, o, *r in rows], "s string, p string, o string")


def _renamed(rows, rng):
    names = {}
    name = lambda t: names.setdefault(t, f"_:r{rng.getrandbits(40)}") if t.startswith("_:") else t
    out = [(name(s), name(o), *r) for s, o, *r in rows]
    rng.shuffle(out)
    return out


def test_isomorphism_of_renamed_and_changed_graphs(spark):
    rng = random.Random(4)
    for _ in range(2):
        n = rng.randint(4, 9)
        rows = list({(f"_:n{rng.randrange(n)}", rng.choice([f"_:n{rng.randrange(n)}", "<urn:x>"]), rng.choice(["<urn:p>", "<urn:q>"])) for _ in range(2 * n)})
        one = _graph(spark, rows)
        assert isomorphic(one, _graph(spark, _renamed(rows, rng)))
        changed = list(rows)
        s, o, p = changed[0]
        changed[0] = (s, o, "<urn:r>")
        assert not isomorphic(one, _graph(spark, _renamed(changed, rng)))


def test_isomorphism_where_nodes_look_alike(spark):
    """Regular graphs, in which every blank node has the same neighbourhood: two triangles aren't a ring of six."""
    ring = lambda *sizes: [(f"_:{k}x{i}", f"_:{k}x{(i + 1) % n}") for k, n in enumerate(sizes) for i in range(n)]
    rng = random.Random(1)
    assert not isomorphic(_graph(spark, ring(4)), _graph(spark, ring(2, 2)))
    labels = {r.s for r in canonical(_graph(spark, ring(2, 2))).collect()}
    assert len(labels) == 4 and labels == {r.s for r in canonical(_graph(spark, _renamed(ring(2, 2), rng))).collect()}


def test_isomorphism_without_blank_nodes_and_of_empty_graphs(spark):
    one = _graph(spark, [("<urn:a>", "<urn:b>")])
    assert isomorphic(one, one.union(one)) and not isomorphic(one, _graph(spark, [("<urn:a>", "<urn:c>")]))
    assert isomorphic(one.limit(0), one.limit(0)) and not isomorphic(one, one.limit(0))
    assert not isomorphic(_graph(spark, [("_:a", "_:b")]), _graph(spark, [("_:a", "_:a")]))


def test_report_graphs_are_compared(spark):
    from graphwright.api import validate

    shapes = "@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix ex: <urn:ex:> . ex:S a sh:NodeShape ; sh:targetSubjectsOf ex:p ; sh:property [ sh:path ex:p ; sh:maxCount 1 ; sh:nodeKind sh:IRI ] ."
    data = "@prefix ex: <urn:ex:> . ex:a ex:p 1 , 2 . ex:b ex:p ex:x ."
    one, two = (validate(spark, data, shapes).report_triples() for _ in range(2))
    # The inner shape is a blank node of the shapes graph.
    assert isomorphic(one, two.withColumn("s", F.when(F.startswith("s", F.lit("_:")), F.concat("s", F.lit("z"))).otherwise(F.col("s"))).withColumn("o", F.when(F.startswith("o", F.lit("_:")), F.concat("o", F.lit("z"))).otherwise(F.col("o"))))
    assert not isomorphic(one, validate(spark, data + " ex:c ex:p 1 .", shapes).report_triples())
    assert isinstance(load(spark, one), TripleTable)
