"""Shapes of shapes: what a shapes graph has to be like before it is used. They cover the core parameters and their cardinality."""

from __future__ import annotations

from ..functions.terms import SH, TYPE

_INTEGERS = "minCount maxCount minLength maxLength qualifiedMinCount qualifiedMaxCount".split()
_BOOLEANS = "deactivated closed uniqueLang qualifiedValueShapesDisjoint".split()
_BOUNDS = "minExclusive minInclusive maxExclusive maxInclusive".split()
_IRIS = "targetClass targetSubjectsOf targetObjectsOf class equals disjoint lessThan lessThanOrEquals".split()
_LISTS = "and or xone in languageIn ignoredProperties".split()
_SHAPES = "node not qualifiedValueShape".split()
#: What a shape without a path can't have.
_OF_PROPERTIES = "path minCount maxCount uniqueLang lessThan lessThanOrEquals qualifiedValueShape qualifiedMinCount qualifiedMaxCount".split()
#: May be given once.
_ONCE = [*_INTEGERS, *_BOOLEANS, *_BOUNDS, "datatype", "nodeKind", "in", "languageIn", "ignoredProperties", "severity", "flags"]


def _property(name: str, *constraints: str) -> str:
    return f"sh:property [ sh:path sh:{name} ; {' ; '.join(constraints)} ]"


def subjects(triples: list[tuple[str, str, str]]) -> list[str]:
    """What is to be looked at as a shape: nodes with a parameter or a target, those typed as shapes, and the shapes that they name."""
    kinds = {f"<{SH}{n}>" for n in ("NodeShape", "PropertyShape")}
    marks = {f"<{SH}{n}>" for n in [*_INTEGERS, *_BOUNDS, *_IRIS, *_LISTS, *_SHAPES, "targetNode", "property", "datatype", "nodeKind", "pattern", "closed", "uniqueLang"]}
    inner = {f"<{SH}{n}>" for n in [*_SHAPES, "property"]}
    found = [s for s, p, o in triples if p in marks or p == TYPE and o in kinds] + [o for _, p, o in triples if p in inner and not o.startswith('"')]
    return list(dict.fromkeys(found))


def meta_shapes(used: set[str] | None = None) -> str:
    """The shapes of shapes in Turtle, of the nodes of class m:Subject; of predicates with the names ``used`` alone, if they are given."""
    once = {n: ["sh:maxCount 1"] for n in _ONCE}
    rules: dict[str, list[str]] = {n: list(once.get(n, [])) for n in dict.fromkeys([*_INTEGERS, *_BOOLEANS, *_BOUNDS, *_IRIS, *_LISTS, *_SHAPES, *_ONCE])}
    for names, constraint in (
        (_INTEGERS, "sh:datatype xsd:integer ; sh:minInclusive 0"), (_BOOLEANS, "sh:datatype xsd:boolean"), (_BOUNDS, "sh:nodeKind sh:Literal"), (_IRIS, "sh:nodeKind sh:IRI"),
        (_LISTS, "sh:node m:List"), (_SHAPES, "sh:nodeKind sh:BlankNodeOrIRI"), (["datatype", "severity"], "sh:nodeKind sh:IRI"), (["flags"], "sh:datatype xsd:string"),
        (["nodeKind"], "sh:in ( sh:BlankNode sh:IRI sh:Literal sh:BlankNodeOrIRI sh:BlankNodeOrLiteral sh:IRIOrLiteral )"),
    ):
        for n in names:
            rules[n].append(constraint)
    rules |= {"pattern": ["sh:datatype xsd:string"], "targetNode": ["sh:nodeKind sh:IRIOrLiteral"], "property": ["sh:nodeKind sh:BlankNodeOrIRI"], "message": ["sh:or ( [ sh:datatype xsd:string ] [ sh:datatype rdf:langString ] )"]}
    rules = {n: c for n, c in rules.items() if used is None or n in used}
    return (
        "@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> . @prefix m: <urn:graphwright:meta:> .\n"
        + " ;\n  ".join(["m:Shape a sh:NodeShape ; sh:targetClass m:Subject", *(_property(n, *c) for n, c in rules.items())])
        + " .\n"
        + " ; ".join(["m:NodeShape a sh:NodeShape ; sh:targetClass sh:NodeShape", *(_property(n, "sh:maxCount 0") for n in _OF_PROPERTIES if used is None or n in used)])
        + " .\nm:PropertyShape a sh:NodeShape ; sh:targetClass sh:PropertyShape ; sh:targetObjectsOf sh:property ; sh:nodeKind sh:BlankNodeOrIRI ; "
        + _property("path", "sh:minCount 1 ; sh:maxCount 1", "sh:nodeKind sh:BlankNodeOrIRI")
        + " .\nm:List a sh:NodeShape ; sh:property [ sh:path [ sh:zeroOrMorePath rdf:rest ] ; sh:hasValue rdf:nil ] .\n"
    )
