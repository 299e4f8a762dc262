"""Entry points: validate, validate_each and expand."""

from __future__ import annotations

import gzip
import os
import re
from collections.abc import Sequence
from functools import reduce
from urllib.request import Request, urlopen

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.terms import OWL, SH, TYPE, iri
from .operators.inference import expand as infer
from .operators.rules import apply_rules
from .plans.compile import Run
from .plans.hooks import Hook
from .plans.meta import meta_shapes, subjects
from .plans.settle import settle
from .plans.shapes import ReportableRuntimeError, ShapesGraph, sh
from .report import ValidationResult
from .sources.graph import Graph, TripleTable, from_text
from .sources.formats import parse_text
from .sources.inoculate import ontology_triples

IMPORT_DEPTH = 3
#: Bytes of a file that is parsed on the driver at most.
SMALL_FILE = 4 << 20
Source = Graph | DataFrame | str | bytes | os.PathLike


def looks_like_text(source: str) -> bool:
    """Whether a string is RDF text rather than a path: by its first character, an early line break, its length."""
    return source[:1] in ("#", "@", "<", "\n", "{", "[") or "\n" in source[:32] or len(source) >= 140


def fetch(url: str) -> str:
    """What the web has at a URL, RDF preferred."""
    accept = "text/turtle, application/rdf+xml;q=0.9, application/ld+json;q=0.8, application/n-triples;q=0.7, */*;q=0.1"
    with urlopen(Request(url, headers={"Accept": accept}), timeout=60) as answer:  # noqa: S310  only for http and https
        return answer.read().decode(answer.headers.get_content_charset() or "utf-8")


def read_text(source) -> tuple[str, str | None]:
    """(text, name) of RDF text, bytes, an open file, a path, or the URL of a file or web page."""
    if hasattr(source, "read"):
        text, name = source.read(), getattr(source, "name", None)
        return text.decode() if isinstance(text, bytes) else text, name if isinstance(name, str) else None
    if isinstance(source, (bytes, bytearray)):
        return bytes(source).decode(), None
    source = str(source)
    if looks_like_text(source):
        return source, None
    if source.startswith(("http://", "https://")):
        return fetch(source), source
    path = source.removeprefix("file://")
    with (gzip.open(path, "rt", encoding="utf-8") if path.endswith(".gz") else open(path, encoding="utf-8")) as f:
        return f.read(), path.removesuffix(".gz")


def default_loader(name: str) -> str | None:
    """The text that an owl:imports names: a file, or a web page if it can be reached."""
    if name.startswith(("http://", "https://")):
        try:
            return fetch(name)
        except OSError:
            return None
    path = name.removeprefix("file://")
    return read_text(path)[0] if os.path.isfile(path) else None


def load(spark: SparkSession, source: Source, scope: str = "") -> Graph:
    """A graph, a frame (s, p, o), RDF text, bytes, an open file, a path or a URL. Files of N-Triples, N-Quads and HexTuples, and those of
    Turtle, TriG, RDF/XML and JSON-LD of more than SMALL_FILE, are read by tasks; small files and texts on the driver."""
    if isinstance(source, Graph):
        return source
    if isinstance(source, DataFrame):
        return TripleTable(spark, source.select("s", "p", "o").distinct())
    source = str(source) if isinstance(source, os.PathLike) else source
    if isinstance(source, str) and not looks_like_text(source) and re.search(r"\.(nt|nq|nquads)(\.gz|\.bz2)?$", source):
        from .sources.graph import read_ntriples

        return read_ntriples(spark, source)
    if isinstance(source, str) and not looks_like_text(source) and re.search(r"\.hext(\.gz|\.bz2)?$", source):
        from .sources.graph import read_hextuples

        return read_hextuples(spark, source)
    if isinstance(source, str) and not looks_like_text(source) and not source.startswith(("http://", "https://")):
        # A small file of this machine is parsed here; a large one, a folder, a pattern or one of another store by tasks.
        plain = source.removeprefix("file://")
        small = os.path.isfile(plain) and os.path.getsize(plain) <= SMALL_FILE
        turtle = re.search(r"\.(ttl|turtle|trig|n3)(\.gz|\.bz2)?$", source)
        if not small and (turtle or re.search(r"\.(rdf|owl|xml|jsonld|json)$", source)):
            from .sources.files import read_documents, read_turtle

            try:
                return (read_turtle if turtle else read_documents)(spark, source)
            except AnalysisException as e:
                if e.getCondition() == "PATH_NOT_FOUND":
                    raise FileNotFoundError(source) from e
                raise
    text, name = read_text(source)
    return from_text(spark, text, scope=scope, name=name)


def imported(text: str, loader, seen: set[str] | None = None, depth: int = 0, name: str | None = None) -> list[tuple[str, str, str]]:
    """Triples of a text and of what its owl:imports name, IMPORT_DEPTH deep; ``loader(iri)`` gives texts or None."""
    seen = seen if seen is not None else set()
    triples = [q[:3] for q in parse_text(text, name, scope=f"s{len(seen)}")]
    if depth < IMPORT_DEPTH:
        for _, _, o in [x for x in triples if x[1] == iri(OWL + "imports") and x[2].startswith("<")]:
            if o not in seen:
                seen.add(o)
                if (more := loader(o[1:-1])) is not None:
                    triples += imported(more, loader, seen, depth + 1, o[1:-1])
    return triples


def shape_triples(graph: Graph) -> list[tuple[str, str, str]]:
    """The triples of a data graph that tell of shapes: those of subjects with a sh: predicate or type, and of the blank
    nodes (lists, inner shapes, expressions) that are reached from them. The rest of the graph stays where it is."""
    triples = graph.triples()
    heads = triples.where(F.startswith("p", F.lit(f"<{SH}")) | ((F.col("p") == TYPE) & F.startswith("o", F.lit(f"<{SH}")))).select("s").distinct()
    seen, found = settle(heads), None
    fresh = seen
    while not fresh.isEmpty():
        part = settle(triples.join(fresh, "s", "left_semi").distinct())
        found = part if found is None else found.unionByName(part)
        fresh = settle(part.where(F.startswith("o", F.lit("_:"))).select(F.col("o").alias("s")).distinct().join(seen, "s", "left_anti"))
        seen = seen.unionByName(fresh)
    return [] if found is None else sorted({tuple(r) for r in found.collect()})


def _triples_of_shapes(spark: SparkSession, source: Source | ShapesGraph, import_loader=None) -> list[tuple[str, str, str]]:
    if isinstance(source, ShapesGraph):
        return [(s, p, o) for s, found in source.out.items() for p, values in found.items() for o in values]
    if not isinstance(source, (Graph, DataFrame)):
        text, name = read_text(source)
        return imported(text, import_loader or default_loader, name=name)
    return shape_triples(load(spark, source))


def load_shapes(spark: SparkSession, source: Source | ShapesGraph, import_loader=None) -> ShapesGraph:
    return source if isinstance(source, ShapesGraph) else ShapesGraph(_triples_of_shapes(spark, source, import_loader))


def meta_validate(spark: SparkSession, shacl_graph: Source | ShapesGraph, import_loader=None) -> ValidationResult:
    """A shapes graph against the shapes of shapes (``plans/meta.py``)."""
    triples = [*dict.fromkeys(tuple(q[:3]) for q in _triples_of_shapes(spark, shacl_graph, import_loader))]
    used = {p[len(SH) + 1 : -1] for _, p, _ in triples if p.startswith(f"<{SH}")}
    triples += [(s, TYPE, "<urn:graphwright:meta:Subject>") for s in subjects(triples)]
    graph = TripleTable(spark, settle(spark.createDataFrame(triples, "s string, p string, o string").coalesce(1)))
    run = Run(graph, ShapesGraph.from_text(meta_shapes(used)), fixpoint=False)
    return ValidationResult(run.all_results(), run.all_nested, graph)


def _expanded(term: str, prefixes: dict[str, str]) -> str:
    """An IRI or CURIE as a term."""
    if term.startswith(("<", "_:")):
        return term
    head, _, rest = term.partition(":")
    return iri(term) if head in ("http", "https", "urn", "file") or head not in prefixes else iri(prefixes[head] + rest)


def validate(
    spark: SparkSession, data_graph: Source | Sequence[Source], shacl_graph: Source | ShapesGraph | None = None, ont_graph: Source | None = None, advanced: bool = False,
    inference: str | None = None, abort_on_first: bool = False, allow_infos: bool = False, allow_warnings: bool = False, max_validation_depth: int = 15,
    focus_nodes: list[str] | None = None, use_shapes: list[str] | None = None, iterate_rules: bool = False, import_loader=None, prefixes: dict[str, str] | None = None, recursion: str = "fixpoint", meta_shacl: bool = False, hooks: dict[str, Hook] | None = None,
) -> ValidationResult:
    """Validates one graph, or the union of several, against shapes; without ``shacl_graph`` the data holds the shapes.

    ``advanced`` runs rules first and evaluates SPARQL targets and expressions. ``allow_infos`` and
    ``allow_warnings`` keep such results without counting them. ``abort_on_first`` keeps one result. ``recursion`` is "fixpoint", or "unroll":
    a shape within itself is then followed twice and taken to conform. With ``meta_shacl`` the shapes are validated first; shapes that
    don't conform to the shapes of shapes are a ReportableRuntimeError. ``hooks`` are Python functions by the names that shapes give them.
    """
    if meta_shacl and not (checked := meta_validate(spark, shacl_graph if shacl_graph is not None else data_graph, import_loader)).conforms:
        raise ReportableRuntimeError(f"the shapes aren't well formed\n{checked.text()}")
    if isinstance(data_graph, (list, tuple)):
        parts = [load(spark, g, f"d{i}").triples() for i, g in enumerate(data_graph)]
        graph: Graph = TripleTable(spark, reduce(DataFrame.unionByName, parts).distinct())
    else:
        graph = load(spark, data_graph)
    if shacl_graph is None:
        if not isinstance(graph, TripleTable):
            raise ReportableRuntimeError("mapped tables hold no shapes")
        shapes = ShapesGraph(shape_triples(graph))
    else:
        shapes = load_shapes(spark, shacl_graph, import_loader)
    if ont_graph is not None:
        graph = TripleTable(spark, graph.triples().unionByName(ontology_triples(load(spark, ont_graph, "o"))).distinct())
    graph = infer(graph, inference)
    known = shapes.prefixes | (prefixes or {})
    focus = [_expanded(x, known) for x in focus_nodes] if focus_nodes is not None else None
    used = [_expanded(x, known) for x in use_shapes] if use_shapes is not None else None
    if advanced and any(sh("rule") in s.params for s in shapes.shapes.values()):
        graph, _ = apply_rules(graph, shapes, iterate_rules, focus, used, hooks)
    allow = {sh("Info")} if allow_infos or allow_warnings else set()
    allow |= {sh("Warning")} if allow_warnings else set()
    if recursion not in ("fixpoint", "unroll"):
        raise ValueError("recursion is fixpoint or unroll")
    run = Run(graph, shapes, frozenset(allow), focus, used, max_validation_depth, recursion == "fixpoint", hooks=hooks or {})
    if abort_on_first:
        return ValidationResult(run.first_result(), None, graph)
    return ValidationResult(run.all_results(), run.all_nested, graph)


def validate_each(spark: SparkSession, data_graphs: Sequence[Source], shacl_graph: Source | ShapesGraph, **options) -> dict[int, ValidationResult]:
    shapes = load_shapes(spark, shacl_graph, options.pop("import_loader", None))
    return {i: validate(spark, g, shapes, **options) for i, g in enumerate(data_graphs)}


def expand(
    spark: SparkSession, data_graph: Source, shacl_graph: Source | ShapesGraph | None = None, ont_graph: Source | None = None, inference: str | None = None,
    focus_nodes: list[str] | None = None, use_shapes: list[str] | None = None, iterate_rules: bool = False, hooks: dict[str, Hook] | None = None,
) -> DataFrame:
    """(s, p, o) of the data graph with what inference and rules add."""
    graph = load(spark, data_graph)
    shapes = load_shapes(spark, shacl_graph if shacl_graph is not None else graph)
    if ont_graph is not None:
        graph = TripleTable(spark, graph.triples().unionByName(ontology_triples(load(spark, ont_graph, "o"))).distinct())
    focus = [_expanded(x, shapes.prefixes) for x in focus_nodes] if focus_nodes is not None else None
    used = [_expanded(x, shapes.prefixes) for x in use_shapes] if use_shapes is not None else None
    return apply_rules(infer(graph, inference), shapes, iterate_rules, focus, used, hooks)[0].triples().distinct()


def expand_quads(spark: SparkSession, data_graph: Source, shacl_graph: Source | ShapesGraph | None = None, destination: str = "urn:graphwright:inferred", **options) -> DataFrame:
    """(s, p, o, g) of the data graph in its own graphs (none: null), and of what an ontology, inference and rules add in the graph
    ``destination``. The options are those of ``expand``."""
    graph = load(spark, data_graph)
    base, named = graph.triples().distinct(), graph.quads().distinct()
    added = expand(spark, graph, shacl_graph, **options).join(base, ["s", "p", "o"], "left_anti").withColumn("g", F.lit(_expanded(destination, {})))
    plain = base.join(named, ["s", "p", "o"], "left_anti").withColumn("g", F.lit(None).cast("string"))
    return plain.unionByName(named).unionByName(added)
