"""Recursion to a fixpoint, long paths by doubling, equal nodes as components, contradictions."""

import random

import pytest

from graphwright.api import validate
from graphwright.functions.terms import OWL, SH, TYPE
from graphwright.operators import paths
from graphwright.operators.equality import clashes, components
from graphwright.operators.inference import owl_rl
from graphwright.plans.shapes import ShapeRecursionWarning
from graphwright.sources.graph import from_text

HEAD = f"@prefix sh: <{SH}> . @prefix ex: <urn:ex:> . @prefix owl: <{OWL}> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n"


def ex(name):
    return f"<urn:ex:{name}>"


def test_a_violation_far_down_a_recursive_shape(spark):
    data = HEAD + " ".join(f"ex:n{i} ex:next ex:n{i + 1} ; ex:age {i} ." for i in range(55)) + " ex:n55 ex:age 99 . ex:m0 ex:next ex:m1 . ex:m1 ex:next ex:m0 ."
    shapes = HEAD + "ex:S a sh:NodeShape ; sh:targetNode ex:n0 , ex:n20 , ex:m0 ; sh:property [ sh:path ex:next ; sh:node ex:T ] . ex:T a sh:NodeShape ; sh:property [ sh:path ex:age ; sh:maxInclusive 90 ] , [ sh:path ex:next ; sh:node ex:S ] ."
    assert sorted((r.focus, r.value) for r in validate(spark, data, shapes).results.collect()) == [(ex("n0"), ex("n1")), (ex("n20"), ex("n21"))]
    with pytest.warns(ShapeRecursionWarning):
        assert validate(spark, data, shapes, recursion="unroll").conforms


def test_recursion_through_a_negation_is_unrolled(spark):
    shapes = HEAD + "ex:S a sh:NodeShape ; sh:targetNode ex:a ; sh:not [ sh:property [ sh:path ex:next ; sh:node ex:S ] ] ."
    with pytest.warns(ShapeRecursionWarning):
        validate(spark, HEAD + "ex:a ex:next ex:b . ex:b ex:next ex:a .", shapes)


def test_closure_by_doubling(spark, monkeypatch):
    """From all nodes of a chain, a ring and a tree, with few rounds before the doubling; the same pairs as hop by hop."""
    monkeypatch.setattr(paths, "LONG", 3)
    rng = random.Random(3)
    edges = [(f"c{i}", f"c{i + 1}") for i in range(30)] + [(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)] + [(f"t{i}", f"t{rng.randrange(i)}") for i in range(1, 30)]
    graph = from_text(spark, HEAD + " ".join(f"ex:{a} ex:next ex:{b} ." for a, b in edges))
    reach, calls = {}, []
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    for a in out:
        seen, todo = set(), [a]
        while todo:
            for y in out.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        reach[a] = seen
    monkeypatch.setattr(paths, "all_reached", lambda one, make=paths.all_reached: calls.append(1) or make(one))
    start = graph.triples().selectExpr("s AS f").distinct()
    got = {(r.f, r.v) for r in paths.closure(graph, start, ("pred", ex("next"))).collect()}
    assert got == {(ex(a), ex(b)) for a, bs in reach.items() for b in bs} and calls == [1]
    one = spark.createDataFrame([(ex("c0"),)], "f string")
    assert paths.closure(graph, one, ("pred", ex("next"))).count() == 30 and calls == [1]


def test_components(spark):
    rng = random.Random(8)
    pairs = [(f"a{i:04d}", f"a{i + 1:04d}") for i in range(300)] + [("hub", f"s{i}") for i in range(300)] + [(f"x{rng.randrange(80)}", f"x{rng.randrange(80)}") for _ in range(60)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.node: r.rep for r in components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == {x: root(x) for a, b in pairs if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a string, b string")).collect() == []


def test_equal_nodes_share_their_triples(spark):
    """Against the rules of equality said one by one, with equal properties and classes among the equal nodes."""
    text = HEAD + "ex:a owl:sameAs ex:b . ex:b owl:sameAs ex:c . ex:a ex:p ex:x . ex:y ex:q ex:c . ex:p owl:sameAs ex:r . ex:K owl:sameAs ex:L . ex:x a ex:K . ex:K rdfs:subClassOf ex:M ."
    graph = from_text(spark, text)
    known = {tuple(r) for r in graph.triples().collect()}
    first, same, sub = set(known), f"<{OWL}sameAs>", "<http://www.w3.org/2000/01/rdf-schema#subClassOf>"
    while True:
        eq = {(s, o) for s, p, o in known if p == same}
        new = {(o, same, s) for s, o in eq} | {(s, same, y) for s, o in eq for x, y in eq if o == x}
        new |= {tuple(b if i == k and t == a else t for k, t in enumerate(row)) for row in known for a, b in eq for i in range(3)}
        new |= {(s, TYPE, d) for s, p, o in known if p == TYPE for c, q, d in known if q == sub and c == o}
        new |= {(a, sub, d) for a, p, b in known if p == sub for c, q, d in known if q == sub and b == c}
        if new <= known:
            break
        known |= new
    assert {tuple(r) for r in owl_rl(graph).collect()} == known - first


def test_keys_and_functional_properties(spark):
    text = HEAD + """ex:P owl:hasKey ( ex:k1 ex:k2 ) . ex:a a ex:P ; ex:k1 1 ; ex:k2 2 . ex:b a ex:P ; ex:k1 1 , 7 ; ex:k2 2 . ex:c a ex:P ; ex:k1 1 ; ex:k2 3 . ex:d ex:k1 1 ; ex:k2 2 .
      ex:f a owl:FunctionalProperty . ex:u ex:f ex:v , ex:w . ex:b ex:f ex:g . ex:a ex:f ex:h ."""
    same = {(r.s, r.o) for r in owl_rl(from_text(spark, text)).collect() if r.p == f"<{OWL}sameAs>" and r.s != r.o}
    pairs = [("a", "b"), ("v", "w"), ("g", "h")]
    assert same == {(ex(x), ex(y)) for p in pairs for x, y in (p, p[::-1])}


def test_clashes(spark):
    text = HEAD + """ex:A owl:disjointWith ex:B . ex:x a ex:A , ex:B . ex:y a owl:Nothing . ex:p owl:propertyDisjointWith ex:q . ex:z ex:p 1 ; ex:q 1 , 2 .
      ex:i a owl:IrreflexiveProperty . ex:x ex:i ex:x , ex:y . ex:s a owl:AsymmetricProperty . ex:x ex:s ex:y . ex:y ex:s ex:x . ex:x owl:sameAs ex:w ; owl:differentFrom ex:w .
      ex:all a owl:AllDisjointClasses ; owl:members ( ex:C ex:D ex:E ) . ex:v a ex:C , ex:E ."""
    got = {(r.rule, r.node) for r in clashes(from_text(spark, text)).collect()}
    assert got == {("cax-dw", ex("x")), ("cls-nothing", ex("y")), ("prp-pdw", ex("z")), ("prp-irp", ex("x")), ("prp-asyp", ex("x")), ("prp-asyp", ex("y")), ("eq-diff", ex("w")), ("cax-adc", ex("v"))}
    assert clashes(from_text(spark, HEAD + "ex:a ex:p ex:b .")).collect() == []
