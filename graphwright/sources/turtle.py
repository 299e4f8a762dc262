"""Parser of Turtle, TriG, N-Triples and N-Quads texts: whole ones on the driver (shapes, axioms), pieces of large files in tasks."""

from __future__ import annotations

import re
from urllib.parse import urljoin

from ..functions.terms import FALSE, RDF, TRUE, TYPE, XSD

Quad = tuple[str, str, str, str | None]

_TOKEN = re.compile(
    r"""(?P<space>[ \t\r\n]+|\#[^\r\n]*)
    |(?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''')
    |(?P<short>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<iri><[^<>"{}|^`\x00-\x20]*>)
    |(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<blank>_:[\w\-.]*[\w\-])
    |(?P<name>[^\W\d_][\w\-.]*:(?:[\w\-:%]|\\.|\.(?=[\w\-:%\\.]))*|:(?:[\w\-:%]|\\.|\.(?=[\w\-:%\\.]))*|[A-Za-z]+)
    |(?P<mark>\^\^|[.;,\[\](){}])""",
    re.X | re.S,
)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
_ONE = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


class TurtleError(ValueError):
    """A text that isn't of the format."""


def _unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ONE.get(m[3], m[3]), text) if "\\" in text else text


class _Reader:
    def __init__(self, text: str, base: str, scope: str):
        self.base, self.scope, self.prefixes, self.quads, self.fresh, self.graph = base, scope, {}, [], 0, None
        self.stem = f"{scope}n"  # of the names of blank nodes without a label
        self.tokens: list[tuple[str, str, int]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise TurtleError(f"line {text.count(chr(10), 0, at) + 1}: unexpected {text[at : at + 20]!r}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0], at))
            at = m.end()
        self.tokens.append(("end", "", at))
        self.i, self.text = 0, text

    def fail(self, wanted: str) -> TurtleError:
        kind, value, at = self.tokens[self.i]
        return TurtleError(f"line {self.text.count(chr(10), 0, at) + 1}: {wanted} expected, not {value!r}")

    def take(self, mark: str | None = None) -> tuple[str, str]:
        kind, value, _ = self.tokens[self.i]
        if mark is not None and value != mark:
            raise self.fail(mark)
        self.i += 1
        return kind, value

    @property
    def next(self) -> str:
        return self.tokens[self.i][1]

    def blank(self) -> str:
        self.fresh += 1
        return f"_:{self.stem}{self.fresh}"

    def resolve(self, value: str) -> str:
        value = _unescape(value[1:-1])
        return f"<{urljoin(self.base, value) if self.base and not re.match('[A-Za-z][A-Za-z0-9+.-]*:', value) else value}>"

    def named(self, value: str) -> str:
        prefix, _, local = value.partition(":")
        if prefix not in self.prefixes:
            raise self.fail(f"a declared prefix instead of {prefix}:")
        return f"<{self.prefixes[prefix]}{re.sub(r'\\\\(.)', r'\\1', local)}>"

    def term(self) -> str:
        kind, value = self.take()
        if kind == "iri":
            return self.resolve(value)
        if kind == "blank":
            return f"_:{self.scope}{value[2:]}"
        if kind in ("long", "short"):
            text = _unescape(value[3:-3] if kind == "long" else value[1:-1])
            if self.tokens[self.i][0] == "at":
                return f'"{text}"{self.take()[1]}'
            if self.next == "^^":
                self.take()
                return f'"{text}"^^{self.term()}'
            return f'"{text}"^^<{XSD}string>'
        if kind == "number":
            name = "double" if "e" in value.lower() else "decimal" if "." in value else "integer"
            return f'"{value}"^^<{XSD}{name}>'
        if kind == "name":
            if ":" in value:
                return self.named(value)
            if value in ("true", "false"):
                return TRUE if value == "true" else FALSE
            if value == "a":
                return TYPE
        if value == "[":
            node = self.blank()
            if self.next != "]":
                self.pairs(node)
            self.take("]")
            return node
        if value == "(":
            items = []
            while self.next != ")":
                items.append(self.term())
            self.take(")")
            head = f"<{RDF}nil>"
            for item in reversed(items):
                cell = self.blank()
                self.quads += [(cell, f"<{RDF}first>", item, self.graph), (cell, f"<{RDF}rest>", head, self.graph)]
                head = cell
            return head
        self.i -= 1
        raise self.fail("a term")

    def pairs(self, subject: str) -> None:
        while True:
            predicate = self.term()
            while True:
                self.quads.append((subject, predicate, self.term(), self.graph))
                if self.next != ",":
                    break
                self.take()
            if self.next != ";":
                return
            while self.next == ";":
                self.take()
            if self.next in (".", "]", "}", ""):
                return

    def statement(self) -> None:
        word = self.next.lower()
        if word in ("@prefix", "prefix"):
            self.take()
            name = self.take()[1]
            self.prefixes[name[:-1]] = self.resolve(self.take()[1])[1:-1]
            if word[0] == "@":
                self.take(".")
        elif word in ("@base", "base"):
            self.take()
            self.base = self.resolve(self.take()[1])[1:-1]
            if word[0] == "@":
                self.take(".")
        elif word == "{" or word == "graph":
            if word == "graph":
                self.take()
            self.block(None if word == "{" else self.term())
        else:
            anonymous = self.next == "["
            subject = self.term()
            if self.next == "{":
                self.block(subject)
                return
            if not (anonymous and self.next == "."):
                self.pairs(subject)
                if self.next not in (".", ""):  # a fourth term: N-Quads
                    s, p, o, _ = self.quads.pop()
                    self.quads.append((s, p, o, self.term()))
            self.take(".")

    def block(self, graph: str | None) -> None:
        self.take("{")
        self.graph = graph
        while self.next != "}":
            subject = self.term()
            if self.next not in (".", "}"):
                self.pairs(subject)
            if self.next == ".":
                self.take()
        self.take("}")
        self.graph = None


def parse_piece(text: str, base: str, before: list[tuple[str | None, str]], scope: str, stem: str) -> list[Quad]:
    """Quads of some statements of a larger text. ``before`` has what was declared before them, in order: (prefix, or None for the base; IRI).
    ``scope`` goes before the labels of blank nodes, ``stem`` before the numbers of those without one."""
    reader = _Reader(text.lstrip("\ufeff"), base, scope)
    reader.stem = stem
    for prefix, value in before:
        if prefix is None:
            reader.base = reader.resolve(value)[1:-1]
        else:
            reader.prefixes[prefix] = reader.resolve(value)[1:-1]
    while reader.tokens[reader.i][0] != "end":
        reader.statement()
    return list(dict.fromkeys(reader.quads))


def parse(text: str, base: str = "", scope: str = "") -> tuple[list[Quad], dict[str, str]]:
    """(quads without repeats in order, prefixes) of a Turtle, TriG, N-Triples or N-Quads text. ``scope`` goes
    before blank node labels, so that those of different files stay apart."""
    reader = _Reader(text.lstrip("\ufeff"), base, scope)
    while reader.tokens[reader.i][0] != "end":
        reader.statement()
    return list(dict.fromkeys(reader.quads)), reader.prefixes
