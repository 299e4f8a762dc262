"""Serialisations of a small graph (a report, a shapes graph) on the driver: Turtle, RDF/XML, JSON-LD and N-Triples. Large
graphs are written as N-Triples by Spark."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from xml.sax.saxutils import escape, quoteattr

from ..functions.terms import RDF, RDFS, SH, TYPE, XSD, datatype_of, is_literal, lang_of, lexical_of

Triple = tuple[str, str, str]
#: Common prefixes.
PREFIXES = {"rdf": RDF, "rdfs": RDFS, "sh": SH, "xsd": XSD}


def grouped(triples: Iterable[Triple]) -> dict[str, dict[str, list[str]]]:
    """subject -> predicate -> objects, all sorted, types first."""
    out: dict[str, dict[str, list[str]]] = {}
    for s, p, o in sorted(set(triples), key=lambda x: (x[0], x[1] != TYPE, x[1], x[2])):
        out.setdefault(s, {}).setdefault(p, []).append(o)
    return out


def quoted(text: str) -> str:
    for char, to in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = text.replace(char, to)
    return f'"{text}"'


def nt_term(term: str) -> str:
    return quoted(lexical_of(term)) + term[term.rindex('"') + 1 :] if is_literal(term) else term


def to_ntriples(triples: Iterable[Triple]) -> str:
    return "".join(f"{s} {p} {nt_term(o)} .\n" for s, p, o in sorted(set(triples)))


def to_nquads(quads: Iterable[tuple[str, str, str, str | None]]) -> str:
    return "".join(f"{s} {p} {nt_term(o)} {g + ' ' if g else ''}.\n" for s, p, o, g in sorted(set(quads), key=lambda q: (q[:3], q[3] or "")))


def to_trig(quads: Iterable[tuple[str, str, str, str | None]]) -> str:
    """Statements of no graph first, then a block for each graph, without prefixes."""
    graphs: dict[str, list[Triple]] = {}
    for s, p, o, g in quads:
        graphs.setdefault(g or "", []).append((s, p, o))
    return "".join(to_ntriples(graphs[g]) if not g else f"{g} {{\n{to_ntriples(graphs[g])}}}\n" for g in sorted(graphs))


def to_turtle(triples: Iterable[Triple], prefixes: dict[str, str] | None = None) -> str:
    known = PREFIXES | (prefixes or {})
    used: set[str] = set()

    def short(full: str) -> str:
        for name, space in known.items():
            if full.startswith(space) and re.fullmatch(r"[A-Za-z_][A-Za-z0-9_-]*", full[len(space) :]):
                used.add(name)
                return f"{name}:{full[len(space):]}"
        return f"<{full}>"

    def shown(term: str) -> str:
        if term.startswith("<"):
            return short(term[1:-1])
        if not is_literal(term):
            return term
        if lang_of(term):
            return quoted(lexical_of(term)) + "@" + lang_of(term)
        kind = datatype_of(term)
        return quoted(lexical_of(term)) + ("" if kind == XSD + "string" else "^^" + short(kind))

    blocks = []
    for s, found in grouped(triples).items():
        lines = [("a" if p == TYPE else shown(p)) + " " + " , ".join(map(shown, os)) for p, os in found.items()]
        blocks.append(shown(s) + " " + " ;\n    ".join(lines) + " .\n")
    return "".join(f"@prefix {n}: <{known[n]}> .\n" for n in sorted(used)) + "\n" + "\n".join(blocks)


def to_jsonld(triples: Iterable[Triple]) -> str:
    """Expanded JSON-LD: an array of nodes."""
    name = lambda t: t[1:-1] if t.startswith("<") else t

    def value(o: str) -> dict:
        if not is_literal(o):
            return {"@id": name(o)}
        if lang_of(o):
            return {"@value": lexical_of(o), "@language": lang_of(o)}
        return {"@value": lexical_of(o)} | ({"@type": datatype_of(o)} if datatype_of(o) != XSD + "string" else {})

    nodes = []
    for s, found in grouped(triples).items():
        node = {"@id": name(s)}
        for p, os in found.items():
            node["@type" if p == TYPE and all(not is_literal(o) for o in os) else name(p)] = [name(o) for o in os] if p == TYPE and all(not is_literal(o) for o in os) else [value(o) for o in os]
        nodes.append(node)
    return json.dumps(nodes, indent=1, ensure_ascii=False)


def to_xml(triples: Iterable[Triple]) -> str:
    spaces: dict[str, str] = {RDF: "rdf"}

    def tag(p: str) -> str:
        found = re.fullmatch(r"<(.*?)([A-Za-z_][A-Za-z0-9_.-]*)>", p)
        if not found:
            raise ValueError(f"{p} can't be an XML name")
        return spaces.setdefault(found[1], f"ns{len(spaces)}") + ":" + found[2]

    body = []
    for s, found in grouped(triples).items():
        about = f'rdf:nodeID="{s[2:]}"' if s.startswith("_:") else f"rdf:about={quoteattr(s[1:-1])}"
        lines = []
        for p, os in found.items():
            for o in os:
                if o.startswith("<"):
                    lines.append(f"    <{tag(p)} rdf:resource={quoteattr(o[1:-1])}/>")
                elif not is_literal(o):
                    lines.append(f'    <{tag(p)} rdf:nodeID="{o[2:]}"/>')
                else:
                    more = f" xml:lang={quoteattr(lang_of(o))}" if lang_of(o) else "" if datatype_of(o) == XSD + "string" else f" rdf:datatype={quoteattr(datatype_of(o))}"
                    lines.append(f"    <{tag(p)}{more}>{escape(lexical_of(o))}</{tag(p)}>")
        body.append(f"  <rdf:Description {about}>\n" + "\n".join(lines) + "\n  </rdf:Description>\n")
    return '<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF' + "".join(f" xmlns:{n}={quoteattr(u)}" for u, n in spaces.items()) + ">\n" + "".join(body) + "</rdf:RDF>\n"


WRITERS = {"turtle": to_turtle, "n3": to_turtle, "xml": to_xml, "json-ld": to_jsonld, "nt": to_ntriples}
