"""Turtle, TriG, N3, RDF/XML and JSON-LD files of any number and size, read by all tasks, and a parallel writer of Turtle.

A Turtle file is read by lines, as Spark deals its blocks to tasks, and put together to chunks. A chunk may begin anywhere: within a
statement, within a text in triple quotes. So three passes follow, each over chunks in parallel:

1. Each chunk says for each of three beginnings (plain, within ``\"\"\"``, within ``'''``) how it ends, and by how much brackets are open.
   These few numbers of a chunk are strung together in the order of the file, so that each chunk's beginning is known.
2. Each chunk is cut at the ends of statements: what is whole, the end of a statement begun before, the beginning of one that goes
   on. Ends and beginnings are joined, in order; a statement that runs through many chunks is one row then.
3. Pieces are parsed, each with the prefixes and the base that stand before it in its file.

Blank nodes are named by file (labels) and by piece (those without a label). A graph block of TriG is one statement, so it is
parsed by one task. RDF/XML and JSON-LD files can't be cut: each file goes to one task as a whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.terms import XSD
from ..plans.settle import drop_settled, settle
from .graph import TripleTable, escaped
from .turtle import parse_piece

#: Characters of a chunk, about: a whole number of lines, one at least.
CHUNK = 1 << 20
QUADS = "s string, p string, o string, g string"
#: What matters for the ends of statements; texts, IRIs and comments are passed over. A full stop before white space ends a
#: statement: numbers and names don't end with one.
_MARK = re.compile(
    r'"""|\'\'\'|"(?:[^"\\\n\r]|\\.)*"|\'(?:[^\'\\\n\r]|\\.)*\'|<[^<>"{}|^`\x00-\x20]*>|#[^\n\r]*|[\[({]|[\])}]|\.(?=\s|#|\Z)|\\.', re.S
)
_CLOSE = {'"""': re.compile(r'\\.|"""', re.S), "'''": re.compile(r"\\.|'''", re.S)}
#: The beginnings of a chunk, by number.
_WITHIN = (None, '"""', "'''")
_DIRECTIVE = re.compile(r"(?:@(prefix|base)|(?<![\w:.\-@])(prefix|base))\s+(?:([^\s:<]*):\s*)?(<[^>]*>)", re.I)


def _scan(text: str, within: str | None, depth: int) -> tuple[str | None, int, int, int]:
    """(what the text ends within, open brackets, where the first statement's end is behind, where the last one's) for a
    text that begins within ``within`` and ``depth`` brackets; -1 if no statement ends in it."""
    at, first, last, n = 0, -1, -1, len(text)
    while at < n:
        if within is not None:
            m = _CLOSE[within].search(text, at)
            if not m:
                return within, depth, first, last
            at = m.end()
            if m[0] == within:
                within = None
            continue
        m = _MARK.search(text, at)
        if not m:
            break
        at, mark = m.end(), m[0]
        if mark in _CLOSE:
            within = mark
        elif mark in ("[", "(", "{"):
            depth += 1
        elif mark in ("]", ")", "}"):
            depth -= 1
            if mark == "}" and depth == 0:  # a graph block ends without a full stop
                first, last = (at if first < 0 else first), at
        elif mark == "." and depth == 0:
            first, last = (at if first < 0 else first), at
    return within, depth, first, last


def _chunk_rows(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines in the order of the file, put together: (file, start of the block, number within it, text)."""
        key, lines, held, number = None, [], 0, 0

        def out():
            return pa.RecordBatch.from_pydict({"file": [key[0]], "block": pa.array([key[1]], pa.int64()), "number": pa.array([number], pa.int64()), "text": ["\n".join(lines) + "\n"]})

        for batch in batches:
            for value, file, block in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if key != (file, block) or held >= size:
                    if lines:
                        yield out()
                    number = number + 1 if key == (file, block) else 0
                    key, lines, held = (file, block), [], 0
                lines.append(value)
                held += len(value) + 1
        if lines:
            yield out()

    return rows


def _summary_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = [[_scan(text, within, 0)[:2] for within in _WITHIN] for text in batch.column("text").to_pylist()]
        within = [[_WITHIN.index(w) for w, _ in e] for e in ends]
        depth = [[d for _, d in e] for e in ends]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(within, pa.list_(pa.int32())), pa.array(depth, pa.list_(pa.int32()))], names=["file", "block", "number", "ends", "depths"])


def _chain(chunks: pd.DataFrame) -> pd.DataFrame:
    """How each chunk of one file begins; a few numbers a chunk."""
    chunks = chunks.sort_values(["block", "number"])
    within, depth, begins, depths = 0, 0, [], []
    for ends, deeper in zip(chunks["ends"], chunks["depths"], strict=True):
        begins.append(within)
        depths.append(depth)
        depth += int(deeper[within])
        within = int(ends[within])
    return pd.DataFrame({"file": chunks["file"], "block": chunks["block"], "number": chunks["number"], "within": begins, "depth": depths})


def _part_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, number, kind, text): the end of a statement begun before (0), what begins in the chunk and goes on (1), whole statements (2)."""
    for batch in batches:
        rows: list[tuple] = []
        for file, block, number, text, within, depth in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            _, _, first, last = _scan(text, _WITHIN[within], depth)
            if first < 0:
                rows.append((file, block, number, 0, text))
            else:
                rows += [(file, block, number, 0, text[:first]), (file, block, number, 1, text[last:]), (file, block, number, 2, text[first:last])]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 5
        types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["file", "block", "number", "kind", "text"])


def _directives(text: str) -> list[tuple[str | None, str]]:
    """(prefix, or None for a base; IRI in angle brackets) that a piece declares, in order. Texts, IRIs and comments are passed over."""
    out, at, n = [], 0, len(text)
    said = _DIRECTIVE.search(text)
    while said:
        if said.start() < at:
            said = _DIRECTIVE.search(text, at)
            continue
        mark = _MARK.search(text, at)
        if mark and mark.start() < said.start():
            if mark[0] in _CLOSE:
                end = mark.end()
                while (m := _CLOSE[mark[0]].search(text, end)) and m[0] != mark[0]:
                    end = m.end()
                at = m.end() if m else n
            else:
                at = mark.end()
            continue
        kind = (said[1] or said[2]).lower()
        if (kind == "prefix") == (said[3] is not None):
            out.append((said[3] if kind == "prefix" else None, said[4]))
        at = said.end()
    return out


def _directive_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(f, b, n, k, i, p, iri) for f, b, n, k, text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True) for i, (p, iri) in enumerate(_directives(text))]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 7
        types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["file", "block", "number", "kind", "place", "prefix", "iri"])


def _scope(file: str) -> str:
    return "f" + blake2b(file.encode(), digest_size=8).hexdigest()


def _quads(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["s", "p", "o", "g"])


def read_turtle(spark: SparkSession, path: str | list[str], chunk: int = CHUNK, base: str = "") -> TripleTable:
    """Files of Turtle, TriG or N3 without formulas: a path, a folder, a pattern or a list of them, anywhere Spark reads.

    Every task parses chunks of about ``chunk`` characters; nothing of a file is held as a whole but the open ends of its statements and
    its directives. Rows are the same as those of ``from_text`` up to the names of blank nodes, which are told apart by file. A text that isn't
    of the format raises TurtleError in the task. Empty files have no triples. Files of ``.gz`` and the like are read by one task each.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    chunks = settle(lines.mapInArrow(_chunk_rows(chunk), "file string, block long, number long, text string"))
    key = ["file", "block", "number"]
    begins = chunks.mapInArrow(_summary_rows, "file string, block long, number long, ends array<int>, depths array<int>").groupBy("file").applyInPandas(_chain, "file string, block long, number long, within int, depth int")
    parts = settle(chunks.join(begins, key).select(*key, "text", "within", "depth").mapInArrow(_part_rows, "file string, block long, number long, kind int, text string"))
    # A statement that goes on ends with the next ends of statements, up to the next one that goes on.
    order = ["block", "number", "kind"]
    open_ = parts.where("kind < 2").withColumn("statement", F.sum("kind").over(Window.partitionBy("file").orderBy(*order)))
    joined = open_.groupBy("file", "statement").agg(F.array_sort(F.collect_list(F.struct(*order, "text"))).alias("x"))
    # What a file begins with is before all else of it.
    first = F.col("x")[0]["kind"] == 0
    stitched = joined.select("file", F.col("x")[0]["block"].alias("block"), F.col("x")[0]["number"].alias("number"), F.when(first, 0).otherwise(3).alias("kind"), F.array_join(F.transform("x", lambda y: y["text"]), "").alias("text"))
    pieces = settle(parts.where("kind = 2").unionByName(stitched).where(F.rlike("text", F.lit(r"\S"))).select("file", *order, "text"))
    drop_settled(chunks)
    said = sorted(tuple(r) for r in pieces.mapInArrow(_directive_rows, "file string, block long, number long, kind int, place int, prefix string, iri string").select("file", *order, "place", F.coalesce("prefix", F.lit("\n")), "iri").collect())
    by_file: dict[str, list[tuple]] = {}
    for file, *rest in said:
        by_file.setdefault(file, []).append(tuple(rest))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, block, number, kind, text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                known = by_file.get(file, [])
                before = [(None if p == "\n" else p, iri) for *_, p, iri in known[: bisect_left(known, (block, number, kind))]]
                scope = _scope(file)
                try:
                    yield _quads(parse_piece(text, base, before, f"{scope}L", f"{scope}P{block}x{number}x{kind}x"))
                except ValueError as e:
                    raise type(e)(f"{file}, after byte {block}: {e}") from e

    found = pieces.mapInArrow(parsed, QUADS).distinct()
    return TripleTable(spark, settle(found))


def read_documents(spark: SparkSession, path: str | list[str], base: str = "") -> TripleTable:
    """Files of RDF/XML, JSON-LD and the other formats, each told by its ending, else by its first characters: a file a row, parsed in its task."""
    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .formats import parse_text

        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = parse_text(content.decode(), file, base, _scope(file))
                yield _quads([(*q[:3], q[3] if len(q) > 3 else None) for q in rows])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return TripleTable(spark, settle(files.mapInArrow(parsed, QUADS).distinct()))


def shortened(term: Column, prefixes: dict[str, str]) -> Column:
    """A term as Turtle writes it: a prefixed name where one of the prefixes fits and the rest is a plain name."""
    out = F.when(F.endswith(term, F.lit(f"^^<{XSD}string>")) & F.startswith(term, F.lit('"')), F.substring(escaped(term), F.lit(1), F.length(escaped(term)) - len(f"^^<{XSD}string>"))).otherwise(escaped(term))
    for name, space in prefixes.items():
        rest = F.substring(term, F.lit(len(space) + 2), F.length(term) - len(space) - 2)
        fits = F.startswith(term, F.lit("<" + space)) & F.rlike(rest, F.lit(r"^[A-Za-z_][A-Za-z0-9_\-]*$"))
        out = F.when(fits, F.concat(F.lit(name + ":"), rest)).otherwise(out)
    return out


def write_turtle(frame: DataFrame, path: str, prefixes: dict[str, str] | None = None, rows: int = 1 << 20) -> None:
    """(s, p, o), perhaps with g, as files of Turtle, or TriG where there is a graph: a file a task, its prefixes first, the triples of a subject
    together where they follow each other in a task. Nothing is gathered or sorted over the whole table."""
    prefixes = prefixes or {}
    graphs = "g" in frame.columns
    terms = frame.select(*[shortened(F.col(c), prefixes).alias(c) for c in ("s", "p", "o")], *([shortened(F.col("g"), prefixes).alias("g")] if graphs else []))
    head = [f"@prefix {n}: <{space}> ." for n, space in prefixes.items()]

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, subject, graph = False, None, None
        for batch in batches:
            out = [] if begun else list(head)
            begun = True
            cols = [c.to_pylist() for c in batch.columns]
            for s, p, o, g in zip(*cols[:3], cols[3] if graphs else [None] * batch.num_rows, strict=True):
                if (s, g) == (subject, graph):
                    out[-1] = out[-1][:-2] + " ;" if not out[-1].endswith("} ") else out[-1]
                    out.append(f"    {p} {o} .")
                else:
                    if graph is not None:
                        out.append("}")
                    if g is not None:
                        out.append(f"{g} {{")
                    out.append(f"{s} {p} {o} .")
                    subject, graph = s, g
            # A statement doesn't go on in the next batch, whose lines are written apart.
            if graph is not None:
                out.append("}")
            subject = graph = None
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})

    terms.mapInArrow(lines, "value string").write.option("maxRecordsPerFile", 0).text(path)
