"""Meta-validation, early stop, descriptions in reports, destinations, headers and formats of expanded graphs."""

import pytest
from pyspark.sql import functions as F

from graphwright.api import expand_quads, meta_validate, validate
from graphwright.operators.clones import clones
from graphwright.plans.shapes import ConstraintLoadError, ReportableRuntimeError, ShapesGraph
from graphwright.plans.sparql_shapes import functions_of
from graphwright.sources.formats import header_comments, parse_text
from graphwright.sources.graph import from_text, nquads
from graphwright.sources.turtle import parse
from graphwright.sources.writers import to_nquads, to_trig

HEAD = "@prefix e: <urn:e:> . @prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n"
GOOD = HEAD + 'e:S a sh:NodeShape ; sh:targetClass e:C ; sh:message "no" ; sh:or ( [ sh:path e:p ; sh:minCount 1 ] e:T ) ; sh:property [ sh:path ( e:p e:q ) ; sh:in ( 1 2 ) ; sh:pattern "a" ; sh:flags "i" ; sh:minInclusive 2.5 ] . e:T a sh:NodeShape ; sh:closed true ; sh:ignoredProperties ( e:p ) .'
BAD = {
    "minCount": "e:S sh:targetClass e:C ; sh:property [ sh:path e:p ; sh:minCount 'x' ] .",
    "maxCount": "e:S sh:targetClass e:C ; sh:property [ sh:path e:p ; sh:maxCount 1 , 2 ] .",
    "nodeKind": "e:S a sh:NodeShape ; sh:nodeKind e:Other .",
    "class": "e:S a sh:NodeShape ; sh:class 'C' .",
    "in": "e:S a sh:NodeShape ; sh:in e:NoList .",
    "targetNode": "e:S sh:targetNode [ ] ; sh:class e:C .",
    "path": "e:S a sh:NodeShape ; sh:path e:p .",
    "closed": "e:S a sh:NodeShape ; sh:closed 'yes' .",
}


@pytest.mark.parametrize("good", [True, False])
def test_meta_validation(spark, good):
    found = meta_validate(spark, GOOD if good else HEAD + " ".join(text.replace("e:S ", f"e:S{i} ") for i, text in enumerate(BAD.values())))
    if good:
        assert found.conforms, found.text()
    else:
        assert {f"<http://www.w3.org/ns/shacl#{name}>" for name in BAD} == {r.path for r in found.results.collect()}


def test_validate_with_meta_shacl(spark):
    data = HEAD + "e:a a e:C ; e:p 1 ."
    with pytest.raises(ReportableRuntimeError, match="well formed"):
        validate(spark, data, HEAD + BAD["in"], meta_shacl=True)
    assert validate(spark, data, HEAD + "e:S a sh:NodeShape ; sh:targetClass e:C ; sh:property [ sh:path e:p ; sh:minCount 1 ] .", meta_shacl=True).conforms


def test_early_stop_plans_no_further_shape(spark, monkeypatch):
    from graphwright.plans.compile import Run

    planned = []
    whole = Run._of_target
    monkeypatch.setattr(Run, "_of_target", lambda self, shape: planned.append(shape.node) or whole(self, shape))
    shape = lambda i, more: f"e:S{i} a sh:NodeShape ; sh:order {i} ; sh:targetClass e:C ; sh:property [ sh:path e:p ; sh:minInclusive {more} ] ."
    data = HEAD + "e:a a e:C ; e:p 5 ."
    many = [f"{shape(i, 9)}" for i in range(20)]
    found = validate(spark, data, HEAD + "\n".join(many), abort_on_first=True)
    assert not found.conforms and found.results.count() == 1 and planned == ["<urn:e:S0>"]
    planned.clear()
    found = validate(spark, data, HEAD + shape(0, 1) + shape(1, "9 ; sh:severity sh:Info") + shape(2, 9) + shape(3, 9), abort_on_first=True, allow_infos=True)
    assert not found.conforms and [r.counts for r in found.results.collect()] == [True] and len(planned) == 3
    found = validate(spark, data, HEAD + shape(0, 1) + shape(1, "1"), abort_on_first=True)
    assert found.conforms and found.results.isEmpty()


def test_values_without_iri_are_described(spark):
    data = HEAD + "e:a a e:C ; e:p [ e:q [ e:r 1 ] ; e:list ( 1 2 ) ] . e:b a e:C ; e:p [ e:q 2 ] . e:other e:q [ e:r 9 ] ."
    found = validate(spark, data, HEAD + "e:S a sh:NodeShape ; sh:targetClass e:C ; sh:property [ sh:path e:p ; sh:nodeKind sh:IRI ] .")
    triples = {tuple(r) for r in found.report_triples().collect()}
    values = {o for _, p, o in triples if p.endswith("#value>")}
    inner = {o for s, p, o in triples if s in values and p == "<urn:e:q>"}
    assert len(values) == 2 and len(inner) == 2
    assert sorted(o[:3] for s, p, o in triples if p == "<urn:e:r>") == ['"1"']
    assert sum(p.endswith("#first>") for _, p, _ in triples) == 2


def test_clones_of_cycles_shared_nodes_and_depth(spark):
    graph = from_text(spark, HEAD + "_:x e:p _:y , e:i . _:y e:p _:x . _:z e:p _:y . " + " ".join(f"_:d{i} e:p _:d{i + 1} ." for i in range(30)))
    roots = spark.createDataFrame([("_:x",), ("_:z",), ("_:x",), ("<urn:e:i>",), (None,), ("_:d0",)], "f string")
    got = clones(graph, roots)
    by = {r["root"]: r["n"] for r in got.groupBy("root").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert by == {"_:x": 3, "_:z": 4, "_:d0": 11}
    names = [{r["s"] for r in got.where(F.col("root") == root).collect()} for root in ("_:x", "_:z")]
    assert not names[0] & names[1] and "_:x" in names[0] and "_:z" in names[1]
    assert clones(graph, roots.limit(0)).isEmpty()


def test_quads_of_an_expanded_graph(spark, tmp_path):
    data = tmp_path / "d.ttl"
    data.write_text(HEAD + "e:p rdfs:subPropertyOf e:q . e:a e:p e:b .")
    shapes = tmp_path / "s.ttl"
    shapes.write_text(HEAD + "e:S a sh:NodeShape .")
    found = {tuple(r) for r in expand_quads(spark, str(data), str(shapes), inference="rdfs").select("s", "p", "o", "g").collect()}
    assert ("<urn:e:a>", "<urn:e:q>", "<urn:e:b>", "<urn:graphwright:inferred>") in found and ("<urn:e:a>", "<urn:e:p>", "<urn:e:b>", None) in found
    assert set(parse(to_trig(found))[0]) == set(parse(to_nquads(found))[0]) == found
    frame = spark.createDataFrame(sorted(found, key=str), "s string, p string, o string, g string")
    assert set(parse("\n".join(r.value for r in nquads(frame).collect()))[0]) == found


def test_header_comments():
    text = "# baseURI: http://e.org/x\n#  Prefix: e\n\n# nothing\n<a> <p> 'b' .\n# base: http://late.org/"
    assert header_comments(text) == {"base": "http://e.org/x", "prefix": "e"}
    assert parse_text(text)[0][0] == "<http://e.org/a>"
    assert parse_text(text, base="http://given.org/")[0][0] == "<http://given.org/a>"
    assert header_comments("") == {} == header_comments("<a> <b> <c> .\n# base: x")


def test_return_types_of_functions():
    head = HEAD + "e:f a sh:SPARQLFunction ; "
    with pytest.raises(ConstraintLoadError):
        functions_of(ShapesGraph.from_text(head + 'sh:ask "ASK { FILTER(true) }" ; sh:returnType xsd:string .'))
    with pytest.raises(ConstraintLoadError):
        functions_of(ShapesGraph.from_text(head + 'sh:select "SELECT ?x WHERE { BIND(1 AS ?x) }" ; sh:returnType xsd:integer , xsd:string .'))
    assert functions_of(ShapesGraph.from_text(head + 'sh:ask "ASK { FILTER(true) }" ; sh:returnType xsd:boolean .'))
