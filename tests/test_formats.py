"""Formats of graphs and reports, sources of all kinds, imports, ontologies and the command line."""

import io
import json
import re

import pytest

from graphwright import cli
from graphwright.api import load, load_shapes, validate
from graphwright.functions.terms import RDF, SH, TYPE, XSD
from graphwright.sources.formats import FormatError, format_of, parse_text
from graphwright.sources.graph import from_text
from graphwright.sources.inoculate import ontology_triples
from graphwright.sources.writers import WRITERS

TTL = '@prefix e: <urn:e:> . e:a a e:T ; e:p 1 , "x\\n\\"y"@en , "z" , 2.5e0 ; e:q [ e:r ( e:b "c" ) ] .'
SHAPES = "@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix e: <urn:e:> . e:S a sh:NodeShape ; sh:targetClass e:T ; sh:property [ sh:path e:p ; sh:maxCount 2 ] ."


def shape_of(triples):
    """Triples with blank nodes alike."""
    return sorted(tuple(re.sub("^_:.*", "_:", x) for x in t[:3]) for t in triples)


@pytest.mark.parametrize("form", list(WRITERS))
def test_round_trips(form):
    triples = [q[:3] for q in parse_text(TTL)]
    assert shape_of(parse_text(WRITERS[form](triples))) == shape_of(triples)


def test_sniffing():
    assert format_of("x.rdf", "") == "xml" and format_of(None, '<?xml version="1.0"?>') == "xml" and format_of(None, '{"@id": "x"}') == "json-ld"
    assert format_of(None, "[ ] a <urn:x> .") == "turtle" and format_of(None, "<urn:g> { <a> <b> <c> }") == "turtle" and format_of(None, "# note\n@prefix") == "turtle"
    for text in ("<!DOCTYPE html><html>", "<rdf:RDF", '{"@context": "http://x/c", "a": 1}'):
        with pytest.raises(FormatError):
            parse_text(text)


def test_xml_forms():
    text = f"""<rdf:RDF xmlns:rdf="{RDF}" xmlns:e="urn:e:" xml:base="http://b/x"><e:T rdf:ID="a" e:n="v"><e:p xml:lang="en">hi</e:p><e:i rdf:datatype="{XSD}int">5</e:i>
      <e:q rdf:parseType="Resource"><e:r rdf:resource="y"/></e:q><e:l rdf:parseType="Collection"><rdf:Description rdf:about="z"/></e:l><e:k rdf:nodeID="k"/><e:s><e:U rdf:nodeID="k"/></e:s></e:T>
      <rdf:Seq><rdf:li>1</rdf:li><rdf:li>2</rdf:li></rdf:Seq></rdf:RDF>"""
    got = {q[:3] for q in parse_text(text)}
    a = "<http://b/x#a>"
    assert {(a, TYPE, "<urn:e:T>"), (a, "<urn:e:n>", f'"v"^^<{XSD}string>'), (a, "<urn:e:p>", '"hi"@en'), (a, "<urn:e:i>", f'"5"^^<{XSD}int>'), (a, "<urn:e:k>", "_:nk"), ("_:nk", TYPE, "<urn:e:U>")} <= got
    assert {p for _, p, _ in got} >= {f"<{RDF}_1>", f"<{RDF}_2>", f"<{RDF}first>", "<urn:e:r>"} and any(o == "<http://b/y>" for *_, o in got)


def test_jsonld_forms():
    text = {
        "@context": {"e": "urn:e:", "@vocab": "urn:v:", "knows": {"@id": "e:knows", "@type": "@id"}, "age": {"@id": "e:age", "@type": XSD + "byte"}, "xs": {"@id": "e:xs", "@container": "@list"}, "by": {"@reverse": "e:made"}, "not": None},
        "@graph": [{"@id": "urn:a", "@type": "P", "name": [{"@value": "n", "@language": "en"}, "m"], "knows": ["urn:b", {"@id": "urn:c", "e:n": 7.5}], "age": "7", "xs": [1, True], "by": "urn:d", "not": 1}, {"@id": "urn:g", "@graph": [{"@id": "urn:z", "e:p": 1}]}],
    }
    got = set(parse_text(json.dumps(text)))
    want = {("<urn:a>", TYPE, "<urn:v:P>", None), ("<urn:a>", "<urn:v:name>", '"n"@en', None), ("<urn:a>", "<urn:e:knows>", "<urn:c>", None), ("<urn:c>", "<urn:e:n>", f'"7.5E0"^^<{XSD}double>', None), ("<urn:a>", "<urn:e:age>", f'"7"^^<{XSD}byte>', None), ("<urn:d>", "<urn:e:made>", "<urn:a>", None), ("<urn:z>", "<urn:e:p>", f'"1"^^<{XSD}integer>', "<urn:g>")}
    assert want <= got and len(got) == len(want) + 2 + 5


def test_sources_of_all_kinds(spark, tmp_path):
    want = shape_of(parse_text(TTL))
    triples = [q[:3] for q in parse_text(TTL)]
    for ending, form in (("ttl", "turtle"), ("rdf", "xml"), ("jsonld", "json-ld"), ("nt", "nt")):
        path = tmp_path / f"x.{ending}"
        path.write_text(WRITERS[form](triples), encoding="utf-8")
        for source in (path, str(path), path.as_uri()):
            assert shape_of(load(spark, source).triples().collect()) == want
    assert shape_of(load(spark, TTL.encode()).triples().collect()) == want and shape_of(load(spark, io.StringIO(TTL)).triples().collect()) == want


def test_imports_from_files(spark, tmp_path):
    (tmp_path / "b.ttl").write_text(SHAPES)
    (tmp_path / "a.ttl").write_text(f"<urn:o> <http://www.w3.org/2002/07/owl#imports> <{(tmp_path / 'b.ttl').as_uri()}> , <{(tmp_path / 'none.ttl').as_uri()}> .")
    assert "<urn:e:S>" in load_shapes(spark, str(tmp_path / "a.ttl")).shapes
    assert not validate(spark, TTL, str(tmp_path / "a.ttl")).conforms


def test_ontology_gives_terms_only(spark):
    text = """@prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix e: <urn:e:> .
      e:U rdfs:subClassOf e:T , [ a owl:Restriction ; owl:onProperty e:p ; owl:someValuesFrom [ owl:unionOf ( e:X e:Y ) ] ] . e:i a owl:NamedIndividual , e:T ; e:p 9 . e:data a e:T ; e:p 1 , 2 , 3 ."""
    got = {(s, p) for s, p, _ in ontology_triples(from_text(spark, text)).collect()}
    assert ("<urn:e:i>", "<urn:e:p>") in got and not any(s == "<urn:e:data>" for s, _ in got) and sum(p.endswith("rest>") for _, p in got) == 2
    assert ontology_triples(from_text(spark, "<urn:a> <urn:b> <urn:c> .")).count() == 0
    found = validate(spark, "<urn:z> a <urn:e:U> ; <urn:e:p> 1 , 2 , 3 .", SHAPES, ont_graph=text)
    assert [r.focus for r in found.results.collect()] == ["<urn:z>"]


def test_reports_and_command_line(spark, tmp_path, capsys):
    found = validate(spark, TTL, SHAPES)
    triples = {tuple(r) for r in found.report_triples().collect()}
    for form in WRITERS:
        back = parse_text(found.serialize(form))
        assert len(back) == len(triples) and sum(p == f"<{SH}result>" for _, p, *_ in back) == 1
    assert "MaxCountConstraintComponent" in found.table() and "Conforms: False" in found.table()
    (tmp_path / "d.ttl").write_text(TTL)
    (tmp_path / "s.ttl").write_text(SHAPES)
    for form in ("human", "table", "turtle", "json-ld"):
        assert cli.main([str(tmp_path / "d.ttl"), "-s", str(tmp_path / "s.ttl"), "-f", form]) == 1
    assert "Conforms" in capsys.readouterr().out
    assert cli.main([str(tmp_path / "d.ttl"), "-s", str(tmp_path / "d.ttl")]) == 0 and cli.main([str(tmp_path / "gone.ttl")]) == 2
    assert cli.main([str(tmp_path / "d.ttl"), "-s", str(tmp_path / "s.ttl"), "--rules"]) == 0 and "<urn:e:a> <urn:e:p>" in capsys.readouterr().out
