"""Parser of SPARQL queries (SELECT, ASK, CONSTRUCT) to a small algebra of tuples and dataclasses."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.terms import FALSE, RDF, TRUE, TYPE, XSD, iri, literal

_TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\r\n]*)
    |(?P<iri><[^<>"{}|^`\x00-\x20]*>)
    |(?P<var>[?$]\w+)
    |(?P<str>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<num>\d+\.?\d*[eE][+-]?\d+|\d*\.\d+|\d+)
    |(?P<blank>_:\w+)
    |(?P<name>(?:[^\W\d_][\w\-.]*)?:(?:[\w\-%]|\\.|\.(?=[\w\-]))*|[A-Za-z_]\w*)
    |(?P<op>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].;,*/+\-?|^!=<>])""",
    re.X | re.S,
)
AGGREGATES = ("COUNT", "SUM", "MIN", "MAX", "AVG", "SAMPLE", "GROUP_CONCAT")


class SparqlError(ValueError):
    """A text that isn't a query this engine reads."""


@dataclass
class Query:
    form: str
    project: list[tuple[str, tuple | None]] | None = None  # None: all
    distinct: bool = False
    where: list = field(default_factory=list)
    group: list[tuple[str, tuple]] = field(default_factory=list)
    having: list[tuple] = field(default_factory=list)
    order: list[tuple[bool, tuple]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0
    template: list[tuple] = field(default_factory=list)


class Parser:
    def __init__(self, text: str, prefixes: dict[str, str] | None = None, path: str | None = None):
        if path is not None:  # $PATH stands for the path's text
            text = re.sub(r"[$?]PATH\b", lambda _: path, text)
        self.prefixes, self.tokens, self.i, self.blanks = dict(prefixes or {}), [], 0, 0
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise SparqlError(f"unexpected {text[at : at + 20]!r}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.tokens.append(("end", ""))

    @property
    def next(self) -> str:
        return self.tokens[self.i][1]

    @property
    def kind(self) -> str:
        return self.tokens[self.i][0]

    def word(self) -> str:
        return self.next.upper() if self.kind == "name" else self.next

    def take(self, want: str | None = None) -> str:
        if want is not None and self.word() != want:
            raise SparqlError(f"{want} expected, not {self.next!r}")
        self.i += 1
        return self.tokens[self.i - 1][1]

    def accept(self, *words: str) -> bool:
        if self.word() in words:
            self.i += 1
            return True
        return False

    def query(self) -> Query:
        while self.word() in ("PREFIX", "BASE"):
            if self.take().upper() == "PREFIX":
                name = self.take()[:-1]
                self.prefixes[name] = self.take()[1:-1]
            else:
                self.take()
        out = self.body()
        if self.kind != "end":
            raise SparqlError(f"unexpected {self.next!r} after the query")
        return out

    def body(self) -> Query:
        form = self.take().upper()
        q = Query(form)
        if form == "SELECT":
            q.distinct = self.accept("DISTINCT") or self.accept("REDUCED")
            if self.accept("*"):
                q.project = None
            else:
                q.project = []
                while self.kind == "var" or self.next == "(":
                    if self.accept("("):
                        e = self.expression()
                        self.take("AS")
                        q.project.append((self.take()[1:], e))
                        self.take(")")
                    else:
                        q.project.append((self.take()[1:], None))
        elif form == "CONSTRUCT":
            self.take("{")
            q.template = self.triples("}")
            self.take("}")
        elif form != "ASK":
            raise SparqlError(f"{form} queries aren't read")
        while self.accept("FROM"):
            self.accept("NAMED")
            self.take()
        self.accept("WHERE")
        q.where = self.group()
        if self.accept("GROUP"):
            self.take("BY")
            while self.kind == "var" or self.next == "(" or (self.kind == "name" and self.word() not in ("HAVING", "ORDER", "LIMIT", "OFFSET")) or self.kind == "iri":
                if self.kind == "var":
                    name = self.take()[1:]
                    q.group.append((name, ("var", name)))
                elif self.accept("("):
                    e = self.expression()
                    q.group.append((self.take()[1:] if self.accept("AS") else f"_g{len(q.group)}", e))
                    self.take(")")
                else:
                    q.group.append((f"_g{len(q.group)}", self.primary()))
        if self.accept("HAVING"):
            while self.next == "(" or self.kind in ("name", "iri") and self.word() not in ("ORDER", "LIMIT", "OFFSET"):
                q.having.append(self.primary())
        if self.accept("ORDER"):
            self.take("BY")
            while self.kind == "var" or self.next == "(" or self.word() in ("ASC", "DESC") or (self.kind == "name" and self.word() not in ("LIMIT", "OFFSET")):
                down = self.word() == "DESC"
                if self.word() in ("ASC", "DESC"):
                    self.take()
                q.order.append((down, self.primary()))
        while self.word() in ("LIMIT", "OFFSET"):
            if self.take().upper() == "LIMIT":
                q.limit = int(self.take())
            else:
                q.offset = int(self.take())
        if self.word() == "VALUES":
            q.where.append(self.values())
        return q

    def group(self) -> list:
        self.take("{")
        out: list = []
        if self.word() == "SELECT":
            out.append(("sub", self.body()))
        while self.next != "}":
            word = self.word()
            if self.accept("."):
                continue
            if word == "FILTER":
                self.take()
                out.append(("filter", self.exists() if self.word() in ("EXISTS", "NOT") else self.primary()))
            elif word == "OPTIONAL":
                self.take()
                out.append(("optional", self.group()))
            elif word == "MINUS":
                self.take()
                out.append(("minus", self.group()))
            elif word == "BIND":
                self.take()
                self.take("(")
                e = self.expression()
                self.take("AS")
                out.append(("bind", e, self.take()[1:]))
                self.take(")")
            elif word == "VALUES":
                out.append(self.values())
            elif word == "GRAPH":
                self.take()
                out.append(("graph", self.node([]), self.group()))
            elif word == "SERVICE":
                raise SparqlError("SERVICE can't be used")
            elif word == "{":
                parts = [self.group()]
                while self.accept("UNION"):
                    parts.append(self.group())
                out.append(("union", parts))
            else:
                got = self.triples("}", "FILTER", "OPTIONAL", "MINUS", "BIND", "VALUES", "GRAPH", "SERVICE", "{")
                if out and out[-1][0] == "bgp":
                    out[-1][1].extend(got)
                else:
                    out.append(("bgp", got))
        self.take("}")
        return out

    def values(self) -> tuple:
        self.take("VALUES")
        one = self.kind == "var"
        names = []
        if one:
            names.append(self.take()[1:])
        else:
            self.take("(")
            while self.next != ")":
                names.append(self.take()[1:])
            self.take(")")
        self.take("{")
        rows = []
        while self.next != "}":
            if not one:
                self.take("(")
            row = []
            for _ in names:
                row.append(None if self.accept("UNDEF") else self.node([])[1])
            rows.append(tuple(row))
            if not one:
                self.take(")")
        self.take("}")
        return ("values", names, rows)

    def fresh(self) -> tuple:
        self.blanks += 1
        return ("var", f"_b{self.blanks}")

    def triples(self, *ends: str) -> list[tuple]:
        out: list[tuple] = []
        while self.word() not in ends and self.kind != "end":
            if self.accept("."):
                continue
            s = self.node(out)
            if self.next not in (".", "}"):
                self.pairs(s, out)
        return out

    def pairs(self, s: tuple, out: list[tuple]) -> None:
        while True:
            p = ("var", self.take()[1:]) if self.kind == "var" else ("path", self.path())
            while True:
                out.append((s, p, self.node(out)))
                if not self.accept(","):
                    break
            if self.next != ";":
                return
            while self.accept(";"):
                pass
            if self.next in (".", "]", "}") or self.word() in ("FILTER", "OPTIONAL", "BIND"):
                return

    def path(self) -> tuple:
        parts = [self.sequence()]
        while self.accept("|"):
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self) -> tuple:
        parts = [self.step()]
        while self.accept("/"):
            parts.append(self.step())
        return parts[0] if len(parts) == 1 else ("seq", parts)

    def step(self) -> tuple:
        if self.accept("^"):
            return ("inv", self.step())
        if self.accept("!"):
            out: tuple = ("neg", self.negated())
        elif self.accept("("):
            out = self.path()
            self.take(")")
        elif self.word() == "A" and self.next == "a":
            self.take()
            out = ("pred", TYPE)
        else:
            out = ("pred", self.named())
        while self.next in ("*", "+", "?"):
            out = (self.take(), out)
        return out

    def negated(self) -> tuple[list[str] | None, list[str] | None]:
        """The predicates that a step may not be of, forwards and backwards; None where no such step is meant."""
        forward, backward = [], []
        many = self.accept("(")
        while not (many and self.accept(")")):
            into = backward if self.accept("^") else forward
            if self.word() == "A" and self.next == "a":
                self.take()
                into.append(TYPE)
            else:
                into.append(self.named())
            self.accept("|")
            if not many:
                break
        return (forward or (None if backward else []), backward or None)

    def named(self) -> str:
        if self.kind == "iri":
            return self.take()
        if self.kind == "name" and ":" in self.next:
            prefix, _, local = self.take().partition(":")
            if prefix not in self.prefixes:
                raise SparqlError(f"the prefix {prefix}: isn't declared")
            return iri(self.prefixes[prefix] + local.replace("\\", ""))
        raise SparqlError(f"an IRI expected, not {self.next!r}")

    def node(self, out: list[tuple]) -> tuple:
        kind = self.kind
        if kind == "var":
            return ("var", self.take()[1:])
        if kind == "blank":
            return ("var", "_n" + self.take()[2:])
        if self.accept("["):
            s = self.fresh()
            if self.next != "]":
                self.pairs(s, out)
            self.take("]")
            return s
        if self.accept("("):
            items = []
            while self.next != ")":
                items.append(self.node(out))
            self.take(")")
            head: tuple = ("term", iri(RDF + "nil"))
            for x in reversed(items):
                cell = self.fresh()
                out += [(cell, ("path", ("pred", iri(RDF + "first"))), x), (cell, ("path", ("pred", iri(RDF + "rest"))), head)]
                head = cell
            return head
        return ("term", self.constant())

    def constant(self) -> str:
        kind = self.kind
        if kind == "str":
            raw = self.take()
            n = 3 if raw[:3] in ('"""', "'''") else 1
            text = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), raw[n:-n])
            if self.kind == "lang":
                return literal(text, lang=self.take()[1:])
            if self.accept("^^"):
                return literal(text, self.named()[1:-1])
            return literal(text)
        sign = self.take() if self.next in ("+", "-") else ""
        if self.kind == "num":
            raw = self.take()
            name = "double" if "e" in raw.lower() else "decimal" if "." in raw else "integer"
            return literal(sign.replace("+", "") + raw, XSD + name)
        if self.word() in ("TRUE", "FALSE") and ":" not in self.next:
            return TRUE if self.take().upper() == "TRUE" else FALSE
        return self.named()

    # Expressions

    def exists(self) -> tuple:
        no = self.accept("NOT")
        self.take("EXISTS")
        return ("not exists" if no else "exists", self.group())

    def expression(self) -> tuple:
        left = self.conjunction()
        while self.accept("||"):
            left = ("||", left, self.conjunction())
        return left

    def conjunction(self) -> tuple:
        left = self.relation()
        while self.accept("&&"):
            left = ("&&", left, self.relation())
        return left

    def relation(self) -> tuple:
        left = self.sum()
        if self.next in ("=", "!=", "<", ">", "<=", ">="):
            return (self.take(), left, self.sum())
        no = self.word() == "NOT"
        if self.word() == "IN" or no:
            self.i += 1 + no
            self.take("(")
            items = []
            while self.next != ")":
                items.append(self.expression())
                self.accept(",")
            self.take(")")
            return ("not in" if no else "in", left, items)
        return left

    def sum(self) -> tuple:
        left = self.product()
        while self.next in ("+", "-"):
            left = (self.take(), left, self.product())
        return left

    def product(self) -> tuple:
        left = self.unary()
        while self.next in ("*", "/"):
            left = (self.take(), left, self.unary())
        return left

    def unary(self) -> tuple:
        if self.accept("!"):
            return ("!", self.unary())
        if self.next in ("-", "+") and self.tokens[self.i + 1][0] != "num":
            return (self.take() + "1", self.unary())
        return self.primary()

    def primary(self) -> tuple:
        if self.accept("("):
            e = self.expression()
            self.take(")")
            return e
        if self.kind == "var":
            return ("var", self.take()[1:])
        word = self.word()
        if word in ("EXISTS", "NOT"):
            return self.exists()
        if self.kind == "name" and ":" not in self.next and word not in ("TRUE", "FALSE"):
            self.take()
            if word in AGGREGATES:
                self.take("(")
                distinct = self.accept("DISTINCT")
                e = None if self.accept("*") else self.expression()
                sep = " "
                if self.accept(";"):
                    self.take("SEPARATOR")
                    self.take("=")
                    sep = self.take()[1:-1]
                self.take(")")
                return ("agg", word, distinct, e, sep)
            return ("fn", word, self.arguments())
        term = self.constant()
        return ("call", term, self.arguments()) if self.next == "(" and term.startswith("<") else ("term", term)

    def arguments(self) -> list[tuple]:
        self.take("(")
        out = []
        while self.next != ")":
            out.append(self.expression())
            self.accept(",")
        self.take(")")
        return out


def parse_query(text: str, prefixes: dict[str, str] | None = None, path: str | None = None) -> Query:
    return Parser(text, prefixes, path).query()


def variables(part) -> set[str]:
    """All variables in a part of a query."""
    if isinstance(part, Query):
        return variables(part.where) | {n for n, _ in part.project or ()}
    if isinstance(part, tuple) and len(part) == 2 and part[0] == "var":
        return {part[1]}
    if isinstance(part, tuple) and part and part[0] == "bind":
        return variables(part[1]) | {part[2]}
    if isinstance(part, tuple) and part and part[0] == "values":
        return set(part[1])
    if isinstance(part, (tuple, list)):
        return set().union(*(variables(x) for x in part)) if part else set()
    return set()
