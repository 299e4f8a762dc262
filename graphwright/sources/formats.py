"""RDF/XML and JSON-LD on the driver, and telling formats apart by names and first characters. Bulk data come as N-Triples,
N-Quads or HexTuples, which Spark reads in parallel; these formats can't be split."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from itertools import count
from typing import Any
from urllib.parse import urljoin

from ..functions.terms import RDF, TYPE, XSD, iri, literal
from .turtle import parse as parse_turtle

Quad = tuple[str, str, str, str | None]
FIRST, REST, NIL = iri(RDF + "first"), iri(RDF + "rest"), iri(RDF + "nil")
XML = "{http://www.w3.org/XML/1998/namespace}"
#: Endings of file names.
ENDINGS = {
    "ttl": "turtle", "turtle": "turtle", "n3": "turtle", "trig": "turtle", "nt": "turtle", "ntriples": "turtle", "nq": "turtle", "nquads": "turtle", "rdf": "xml", "xml": "xml", "owl": "xml",
    "json": "json-ld", "jsonld": "json-ld",
}


class FormatError(ValueError):
    pass


def format_of(name: str | None, text: str) -> str:
    """turtle (N-Triples, TriG and N-Quads too), xml or json-ld: by the name's ending, else by the text's first characters."""
    ending = re.search(r"\.([a-z0-9]+)$", (name or "").lower())
    if ending and ending[1] in ENDINGS:
        return ENDINGS[ending[1]]
    start = text.lstrip("﻿ \t\r\n")[:200].lower()
    if start.startswith(("<!doctype html", "<html")):
        raise FormatError("this is a web page, no RDF")
    if start.startswith(("<?xml", "<rdf:", "<!doctype rdf", "<!--")):
        return "xml"
    # A list of Turtle starts with [ too: JSON goes on with an object or ends.
    if start.startswith("{") and re.match(r'\{\s*("|\})', start) or re.match(r"\[\s*(\{|\])", start) and _is_json(text):
        return "json-ld"
    return "turtle"


def _is_json(text: str) -> bool:
    try:
        json.loads(text)
        return True
    except ValueError:
        return False


def parse_text(text: str, name: str | None = None, base: str = "", scope: str = "") -> list[Quad]:
    """The quads of a text in any of the formats; ``scope`` keeps blank nodes of several texts apart."""
    kind = format_of(name, text)
    if kind == "xml":
        return list(parse_xml(text, base, scope))
    if kind == "json-ld":
        return list(parse_jsonld(text, base, scope))
    return parse_turtle(text, base or header_comments(text).get("base", ""), scope)[0]


def header_comments(text: str) -> dict[str, str]:
    """What the comments before the first statement of a Turtle text tell: "base" (``# baseURI: iri``, or ``# base: iri``) and "prefix"
    (``# prefix: name``); of several the last."""
    told = {}
    for line in text.lstrip("\ufeff").splitlines():
        line = line.strip()
        if line and not line.startswith("#"):
            break
        name, colon, value = line.lstrip("# \t\xa0").partition(":")
        name = {"baseuri": "base", "base": "base", "prefix": "prefix"}.get(name.strip().lower())
        if colon and name and value.strip():
            told[name] = value.strip()
    return told


# RDF/XML


def parse_xml(text: str, base: str = "", scope: str = "") -> Iterator[Quad]:
    try:
        root = ET.fromstring(text.encode() if isinstance(text, str) else text)
    except ET.ParseError as e:
        raise FormatError(f"not well-formed XML: {e}") from e
    numbers = count()
    blank = lambda name=None: f"_:{scope}x{next(numbers)}" if name is None else f"_:{scope}n{name}"
    name_of = lambda tag: tag[1:].replace("}", "") if tag.startswith("{") else tag
    own = lambda e, n: e.get(f"{{{RDF}}}{n}")

    def node(e: ET.Element, base: str, lang: str | None, out: list[Quad]) -> str:
        base, lang = e.get(XML + "base", base), e.get(XML + "lang", lang)
        if own(e, "about") is not None:
            s = iri(urljoin(base, own(e, "about")))
        elif own(e, "ID") is not None:
            s = iri(urljoin(base, "#" + own(e, "ID")))
        else:
            s = blank(own(e, "nodeID"))
        if name_of(e.tag) != RDF + "Description":
            out.append((s, TYPE, iri(name_of(e.tag)), None))
        for key, value in e.attrib.items():
            full = name_of(key)
            if key.startswith(XML) or full in (RDF + n for n in ("about", "ID", "nodeID")) or not key.startswith("{"):
                continue
            out.append((s, iri(full), iri(urljoin(base, value)) if full == RDF + "type" else literal(value, lang=lang), None))
        item = count(1)
        for child in e:
            prop(s, child, base, lang, out, item)
        return s

    def prop(s: str, e: ET.Element, base: str, lang: str | None, out: list[Quad], item) -> None:
        base, lang = e.get(XML + "base", base), e.get(XML + "lang", lang)
        full = name_of(e.tag)
        p = iri(RDF + f"_{next(item)}" if full == RDF + "li" else full)
        kind, inner = own(e, "parseType"), list(e)
        plain = {name_of(k): v for k, v in e.attrib.items() if k.startswith("{") and not k.startswith((XML, f"{{{RDF}}}"))}
        if kind == "Resource":
            o = blank()
            numbered = count(1)
            for child in inner:
                prop(o, child, base, lang, out, numbered)
        elif kind == "Collection":
            members = [node(x, base, lang, out) for x in inner]
            heads = [blank() for _ in members] + [NIL]
            for i, m in enumerate(members):
                out += [(heads[i], FIRST, m, None), (heads[i], REST, heads[i + 1], None)]
            o = heads[0]
        elif kind is not None:
            o = literal((e.text or "") + "".join(ET.tostring(x, encoding="unicode") for x in inner), RDF + "XMLLiteral")
        elif own(e, "resource") is not None or own(e, "nodeID") is not None or plain and not inner:
            o = iri(urljoin(base, own(e, "resource"))) if own(e, "resource") is not None else blank(own(e, "nodeID"))
            out += [(o, iri(k), literal(v, lang=lang), None) for k, v in plain.items()]
        elif inner:
            if len(inner) > 1:
                raise FormatError(f"the property {full} has several nodes")
            o = node(inner[0], base, lang, out)
        elif own(e, "datatype") is not None:
            o = literal(e.text or "", urljoin(base, own(e, "datatype")))
        else:
            o = literal(e.text or "", lang=lang)
        out.append((s, p, o, None))
        if own(e, "ID") is not None:
            told = iri(urljoin(base, "#" + own(e, "ID")))
            out += [(told, TYPE, iri(RDF + "Statement"), None), *[(told, iri(RDF + n), x, None) for n, x in (("subject", s), ("predicate", p), ("object", o))]]

    found: list[Quad] = []
    if name_of(root.tag) == RDF + "RDF":
        base, lang = root.get(XML + "base", base), root.get(XML + "lang")
        for e in root:
            node(e, base, lang, found)
    else:
        node(root, base, None, found)
    yield from found


# JSON-LD


class Context:
    """Term definitions of an inline context."""

    def __init__(self, base: str):
        self.base, self.vocab, self.lang = base, None, None
        self.terms: dict[str, dict] = {}

    def plus(self, given: Any) -> Context:
        out = Context(self.base)
        out.vocab, out.lang, out.terms = self.vocab, self.lang, dict(self.terms)
        for part in given if isinstance(given, list) else [given]:
            if part is None:
                out = Context(self.base)
            elif isinstance(part, str):
                raise FormatError(f"the context {part} isn't fetched; put it into the document")
            else:
                out.base = urljoin(out.base, part["@base"]) if part.get("@base") else out.base
                out.vocab, out.lang = part.get("@vocab", out.vocab), part.get("@language", out.lang)
                for term, d in part.items():
                    if not term.startswith("@"):
                        out.terms[term] = {"@id": d} if isinstance(d, str) else dict(d or {"@id": None})
        return out

    def expand(self, name: str, vocab: bool, depth: int = 0) -> str | None:
        """The full IRI, a keyword or a blank node; None for what means nothing."""
        if name.startswith(("@", "_:")):
            return name
        if vocab and name in self.terms and depth < 20:
            own = self.terms[name].get("@id", self.terms[name].get("@reverse", name))
            if own is None:
                return None
            if own != name:
                return self.expand(own, True, depth + 1)
        if ":" in name:
            return self.expand_compact(name, depth)
        return (self.vocab + name if self.vocab is not None else None) if vocab else urljoin(self.base, name)

    def expand_compact(self, name: str, depth: int) -> str:
        head, _, rest = name.partition(":")
        if not rest.startswith("//") and head in self.terms and depth < 20 and (space := self.expand(head, True, depth + 1)):
            return space + rest
        return name


def parse_jsonld(text: str, base: str = "", scope: str = "") -> Iterator[Quad]:
    try:
        document = json.loads(text)
    except ValueError as e:
        raise FormatError(f"not JSON: {e}") from e
    numbers = count()
    out: list[Quad] = []

    def term(name: str) -> str:
        return f"_:{scope}n{name[2:]}" if name.startswith("_:") else iri(name)

    def value(v: Any, d: dict, context: Context, g: str | None) -> list[str]:
        """The terms of a value under a term definition."""
        if v is None:
            return []
        if isinstance(v, list):
            return [x for y in v for x in value(y, d, context, g)]
        kind, lang = d.get("@type"), d.get("@language", context.lang)
        if isinstance(v, dict):
            keys = {context.expand(k, True): k for k in v}
            if "@context" in v:
                context = context.plus(v["@context"])
            if "@list" in keys:
                return [chain(v[keys["@list"]], d, context, g)]
            if "@set" in keys:
                return value(v[keys["@set"]], d, context, g)
            if "@value" in keys:
                inner = {"@type": context.expand(v[keys["@type"]], True) if "@type" in keys else None, "@language": v.get(keys.get("@language"), None)}
                return value(v[keys["@value"]], inner, context, g)
            if d.get("@container") == "@language":
                return [literal(x, lang=k) for k, xs in v.items() for x in (xs if isinstance(xs, list) else [xs]) if x is not None]
            return [node(v, context, g)]
        if isinstance(v, str) and kind in ("@id", "@vocab"):
            full = context.expand(v, kind == "@vocab")
            return [term(full)] if full else []
        typed = context.expand(kind, True) if kind and not kind.startswith("@") else None
        if isinstance(v, bool):
            return [literal("true" if v else "false", typed or XSD + "boolean")]
        if isinstance(v, int) or isinstance(v, float) and v.is_integer() and typed != XSD + "double" and abs(v) < 1e21:
            return [literal(str(int(v)), typed or XSD + "integer")]
        if isinstance(v, float):
            digits = re.sub(r"(\.\d*?)0+E", r"\1E", f"{v:.15E}").replace(".E", ".0E")
            return [literal(re.sub(r"E([+-])0*(\d)", lambda m: "E" + m[1].replace("+", "") + m[2], digits), typed or XSD + "double")]
        return [literal(v, typed) if typed else literal(v, lang=lang)]

    def chain(items: Any, d: dict, context: Context, g: str | None) -> str:
        members = [x for y in (items if isinstance(items, list) else [items]) for x in value(y, d, context, g)]
        heads = [f"_:{scope}l{next(numbers)}" for _ in members] + [NIL]
        for i, m in enumerate(members):
            out.extend([(heads[i], FIRST, m, g), (heads[i], REST, heads[i + 1], g)])
        return heads[0]

    def node(v: dict, context: Context, g: str | None) -> str:
        if "@context" in v:
            context = context.plus(v["@context"])
        keys = {k: context.expand(k, True) for k in v if k != "@context"}
        named = next((v[k] for k, full in keys.items() if full == "@id"), None)
        s = term(context.expand(named, False)) if named is not None else f"_:{scope}b{next(numbers)}"
        for k, full in keys.items():
            d = context.terms.get(k, {})
            if full == "@type":
                out.extend((s, TYPE, term(context.expand(x, True) or x), g) for x in (v[k] if isinstance(v[k], list) else [v[k]]))
            elif full == "@graph":
                for x in v[k] if isinstance(v[k], list) else [v[k]]:
                    node(x, context, s if named is not None else g)
            elif full == "@reverse":
                for p, xs in v[k].items():
                    out.extend((o, iri(context.expand(p, True)), s, g) for o in value(xs, {"@type": "@id"}, context, g))
            elif full and full.startswith("_:") or full is None or full.startswith("@"):
                continue
            elif "@reverse" in d:
                out.extend((o, iri(context.expand(d["@reverse"], True)), s, g) for o in value(v[k], {"@type": "@id"} | d, context, g))
            elif d.get("@container") == "@list":
                out.append((s, iri(full), chain(v[k], d, context, g), g))
            else:
                out.extend((s, iri(full), o, g) for o in value(v[k], d, context, g))
        return s

    for top in document if isinstance(document, list) else [document]:
        if not isinstance(top, dict):
            raise FormatError("a JSON-LD document holds objects")
        if set(top) <= {"@context", "@graph"}:
            context = Context(base).plus(top["@context"]) if "@context" in top else Context(base)
            inner = top.get("@graph", [])
            for x in inner if isinstance(inner, list) else [inner]:
                node(x, context, None)
        else:
            node(top, Context(base), None)
    yield from out
