"""The shapes graph on the driver: triples indexed by subject, property paths, shapes and load checks."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from ..functions.terms import RDF, RDFS, SH, TRUE, TYPE, datatype_of, is_literal, lexical_of
from ..sources.turtle import parse


class ShapeRecursionWarning(UserWarning):
    """A shape that refers to itself through a negation, a choice or a count was followed a few times, then taken to conform."""


class ReportableRuntimeError(RuntimeError):
    """A problem that the caller is to be told of."""


class ShapeLoadError(ReportableRuntimeError):
    """A shape that isn't well formed."""


class ConstraintLoadError(ReportableRuntimeError):
    """A constraint whose parameters aren't well formed."""


class RuleLoadError(ReportableRuntimeError):
    """A rule that isn't well formed."""


class ValidationFailure(ReportableRuntimeError):
    """Validation can't be carried out."""


def sh(name: str) -> str:
    return f"<{SH}{name}>"


#: A path: ("pred", iri), ("inv", path), ("seq", [path]), ("alt", [path]), ("?", path), ("*", path), ("+", path).
Path = tuple
PATH_DEPTH = 10


@dataclass
class Shape:
    node: str
    path: Path | None
    params: dict[str, list[str]]
    severity: str = sh("Violation")
    messages: list[str] = field(default_factory=list)
    deactivated: bool = False
    order: float = 0.0

    def get(self, name: str) -> list[str]:
        return self.params.get(sh(name), [])


#: Parameters whose values are shapes, or lists of shapes, and the names that make a subject a shape.
SHAPE_VALUES = ("property", "node", "not", "qualifiedValueShape")
SHAPE_LISTS = ("and", "or", "xone")
TARGETS = ("targetNode", "targetClass", "targetSubjectsOf", "targetObjectsOf", "target")
PARAMETERS = (
    *SHAPE_VALUES, *SHAPE_LISTS, "class", "datatype", "nodeKind", "minCount", "maxCount", "minExclusive", "minInclusive", "maxExclusive", "maxInclusive", "minLength", "maxLength",
    "pattern", "languageIn", "uniqueLang", "equals", "disjoint", "lessThan", "lessThanOrEquals", "closed", "hasValue", "in", "sparql", "expression", "rule", "js",
)


class ShapesGraph:
    """Shapes found in a set of triples: typed ones, subjects of targets and parameters, and values of
    parameters that expect shapes."""

    def __init__(self, triples: list[tuple[str, str, str]], prefixes: dict[str, str] | None = None):
        self.prefixes = prefixes or {}
        self.out: dict[str, dict[str, list[str]]] = defaultdict(lambda: defaultdict(list))
        self.subjects: dict[tuple[str, str], list[str]] = defaultdict(list)
        for s, p, o in triples:
            if o not in self.out[s][p]:
                self.out[s][p].append(o)
                self.subjects[p, o].append(s)
        self.shapes: dict[str, Shape] = {}
        self._find()

    @classmethod
    def from_text(cls, text: str, base: str = "") -> ShapesGraph:
        quads, prefixes = parse(text, base, "s")
        return cls([q[:3] for q in quads], prefixes)

    def values(self, s: str, name: str) -> list[str]:
        return self.out[s].get(name if name.startswith("<") else sh(name), []) if s in self.out else []

    def value(self, s: str, name: str) -> str | None:
        found = self.values(s, name)
        return found[0] if found else None

    def items(self, node: str) -> list[str]:
        """The entries of an RDF list; a cycle raises ValueError."""
        out, seen = [], set()
        while node != f"<{RDF}nil>":
            if node in seen:
                raise ValueError(f"the list at {node} has a cycle")
            seen.add(node)
            out += self.values(node, f"<{RDF}first>")
            rest = self.values(node, f"<{RDF}rest>")
            if not rest:
                break
            node = rest[0]
        return out

    def is_list(self, node: str) -> bool:
        return node == f"<{RDF}nil>" or bool(self.values(node, f"<{RDF}first>"))

    def path(self, node: str, depth: int = 0) -> Path:
        if depth > PATH_DEPTH:
            raise ReportableRuntimeError("the property path is nested too deep")
        if is_literal(node):
            raise ReportableRuntimeError("a literal can't be a property path")
        if node.startswith("<") and not self.is_list(node):
            return ("pred", node)
        if self.is_list(node):  # a list wins over other keys at one node
            parts = self.items(node)
            if len(parts) < 2:
                raise ReportableRuntimeError("a sequence path needs two items or more")
            return ("seq", [self.path(x, depth + 1) for x in parts])
        if inner := self.values(node, "inversePath"):
            return ("inv", self.path(inner[0], depth + 1))
        if inner := self.values(node, "alternativePath"):
            parts = self.items(inner[0])
            if len(parts) < 2:
                raise ReportableRuntimeError("an alternative path needs two items or more")
            return ("alt", [self.path(x, depth + 1) for x in parts])
        for name, mark in (("zeroOrMorePath", "*"), ("oneOrMorePath", "+"), ("zeroOrOnePath", "?")):
            if inner := self.values(node, name):
                return (mark, self.path(inner[0], depth + 1))
        raise ReportableRuntimeError(f"{node} isn't a property path")

    def _find(self) -> None:
        found: dict[str, None] = {}
        for s, po in list(self.out.items()):
            types = po.get(TYPE, [])
            if sh("NodeShape") in types or sh("PropertyShape") in types or any(sh(t) in po for t in TARGETS):
                found[s] = None
            if sh("NodeShape") in types and sh("PropertyShape") in types:
                raise ShapeLoadError(f"{s} is a node shape and a property shape")
            if any(sh(p) in po for p in PARAMETERS) and not po.get(f"<{SH}parameter>") and sh("Parameter") not in types:
                found[s] = None
            for name in SHAPE_VALUES:
                found |= dict.fromkeys(x for x in po.get(sh(name), []) if not is_literal(x))
            for name in SHAPE_LISTS:
                for head in po.get(sh(name), []):
                    if not self.is_list(head):
                        raise ShapeLoadError(f"sh:{name} of {s} isn't a list")
                    found |= dict.fromkeys(self.items(head))
        for s in found:
            po = self.out[s] if s in self.out else {}
            paths = po.get(sh("path"), [])
            if sh("NodeShape") in po.get(TYPE, []) and paths:
                raise ShapeLoadError(f"the node shape {s} has a path")
            if (sh("PropertyShape") in po.get(TYPE, []) and not paths) or len(paths) > 1:
                raise ShapeLoadError(f"the property shape {s} needs one path")
            for used in self.subjects.get((sh("property"), s), []):
                if not paths and used in self.out:
                    raise ShapeLoadError(f"{s}, the value of sh:property, has no path")
            order = po.get(sh("order"), [])
            self.shapes[s] = Shape(
                s,
                self.path(paths[0]) if paths else None,
                {p: list(o) for p, o in po.items()},
                (po.get(sh("severity")) or [sh("Violation")])[0],
                po.get(sh("message"), []),
                TRUE in po.get(sh("deactivated"), []),
                float(lexical_of(order[0])) if order else 0.0,
            )

    def implicit_class(self, shape: Shape) -> bool:
        types = shape.params.get(TYPE, [])
        return f"<{RDFS}Class>" in types or any(f"<{RDFS}Class>" in self.values(t, f"<{RDFS}subClassOf>") for t in types)

    def has_target(self, shape: Shape) -> bool:
        return any(sh(t) in shape.params for t in TARGETS) or self.implicit_class(shape)


def path_text(path: Path) -> str:
    """The path in SPARQL syntax."""
    kind = path[0]
    if kind == "pred":
        return path[1]
    if kind == "inv":
        return "^" + (path_text(path[1]) if path[1][0] == "pred" else f"({path_text(path[1])})")
    if kind in ("seq", "alt"):
        return (" / " if kind == "seq" else " | ").join(path_text(x) if x[0] in ("pred", "inv") else f"({path_text(x)})" for x in path[1])
    return (path_text(path[1]) if path[1][0] == "pred" else f"({path_text(path[1])})") + kind


def integer(term: str, what: str) -> int:
    if not is_literal(term) or not datatype_of(term).endswith("#integer"):
        raise ConstraintLoadError(f"{what} needs an xsd:integer")
    return int(lexical_of(term))
