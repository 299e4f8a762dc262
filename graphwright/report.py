"""Sinks of validation results: the conformance flag, the report graph and the text report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions.terms import FALSE, SH, TRUE, TYPE, c_string
from .plans.compile import RESULTS, digest_of_result, names
from .plans.shapes import sh
from .operators.clones import clones
from .sources.graph import Graph, write_ntriples
from .sources.writers import WRITERS


@dataclass
class ValidationResult:
    """``results`` is a bag of rows; everything else is made from it when it is asked for."""

    results: DataFrame
    #: Gives the results beneath others (``Run.all_nested``); they are worked out when a report graph is asked for.
    nested: Callable[[], DataFrame] | None = None
    #: The data, of which a report graph shows the blank nodes that are focus nodes or values.
    graph: Graph | None = None

    @property
    def conforms(self) -> bool:
        return self.results.where("counts").isEmpty()

    def identified(self) -> DataFrame:
        """The results with ``result_id``: a hash of a row and its number among equal rows, the same in every run."""
        hashed = self.results.select(*names(RESULTS)).withColumn("_h", digest_of_result())
        number = F.row_number().over(Window.partitionBy("_h").orderBy("_h"))
        return hashed.withColumn("result_id", F.concat(F.lit("_:r"), F.substring("_h", 1, 32), F.lit("n"), number.cast("string"))).withColumnRenamed("_h", "digest")

    def report_triples(self) -> DataFrame:
        """(s, p, o) of the sh:ValidationReport. A path that isn't one predicate stands as its SPARQL text. Results that a result of sh:node
        is for stand beneath it by sh:detail. Focus nodes and values without an IRI have their triples in the report, 10 steps deep."""
        spark = self.results.sparkSession
        head = [("_:report", TYPE, sh("ValidationReport")), ("_:report", sh("conforms"), TRUE if self.conforms else FALSE)]
        path = F.when(F.rlike("path", F.lit("^<[^>]*>$")), F.col("path")).otherwise(c_string(F.col("path")))
        pair = lambda p, o: F.struct(F.lit(p).alias("p"), o.alias("o"))
        found = self.identified()
        links = found.select(F.lit("_:report").alias("s"), F.lit(sh("result")).alias("p"), F.col("result_id").alias("o"))
        shown = found.drop("digest")
        if self.nested is not None:
            beneath = self.nested()
            inner = F.concat(F.lit("_:d"), F.substring("result", 1, 32))
            uppermost = found.select(F.col("digest").alias("parent"), F.col("result_id").alias("above"))
            own = beneath.select(F.col("result").alias("parent"), inner.alias("above"))
            details = beneath.select("parent", inner.alias("o")).join(uppermost.unionByName(own), "parent")
            links = links.unionByName(details.select(F.col("above").alias("s"), F.lit(sh("detail")).alias("p"), "o"))
            shown = shown.unionByName(beneath.withColumn("result_id", inner).select(*shown.columns))
        rows = shown.select(
            F.col("result_id").alias("s"),
            F.explode(
                F.concat(
                    F.array(
                        pair(TYPE, F.lit(sh("ValidationResult"))), pair(sh("focusNode"), F.col("focus")), pair(sh("resultPath"), path), pair(sh("value"), F.col("value")),
                        pair(sh("sourceConstraintComponent"), F.col("component")), pair(sh("sourceShape"), F.col("source_shape")), pair(sh("resultSeverity"), F.col("severity")), pair(sh("sourceConstraint"), F.col("source_constraint")),
                    ),
                    F.transform("messages", lambda m: pair(sh("resultMessage"), c_string(m))),
                )
            ).alias("x"),
        ).select("s", "x.p", "x.o").where(F.col("o").isNotNull())
        out = spark.createDataFrame(head, "s string, p string, o string").unionByName(links).unionByName(rows)
        if self.graph is None:
            return out
        shown_nodes = shown.select(F.explode(F.array("focus", "value")).alias("f")).where(F.startswith("f", F.lit("_:")))
        return out.unionByName(clones(self.graph, shown_nodes).select("s", "p", "o"))

    def serialize(self, form: str = "turtle") -> str:
        """The report graph as turtle, n3, xml, json-ld or nt, made on the driver."""
        if form not in WRITERS:
            raise ValueError(f"there is no format {form}; these are known: {', '.join(WRITERS)}")
        return WRITERS[form](tuple(r) for r in self.report_triples().toLocalIterator())

    def table(self) -> str:
        """The results as a table of text, all of them, sorted; made on the driver."""
        names = ["focus", "path", "value", "component", "source_shape", "severity", "messages"]
        short = lambda c, x: "" if x is None else "; ".join(x) if c == "messages" else x.removeprefix(f"<{SH}").removesuffix(">") if x.startswith(f"<{SH}") else x
        rows = sorted([short(c, r[c]) for c in names] for r in self.results.toLocalIterator())
        width = [max(map(len, column)) for column in zip(names, *rows, strict=True)]
        line = lambda row: "| " + " | ".join(x.ljust(w) for x, w in zip(row, width, strict=True)) + " |"
        return "\n".join([line(names), "|" + "|".join("-" * (w + 2) for w in width) + "|", *map(line, rows)]) + f"\nConforms: {self.conforms}\n"

    def write(self, path: str) -> None:
        write_ntriples(self.report_triples(), path)

    def text(self) -> str:
        """The report as text, all results, sorted; made on the driver."""
        number = self.results.count()
        conforms = number == 0 or self.conforms
        name = lambda t: t[1:-1].rsplit("#", 1)[-1] if t and t.startswith("<http://www.w3.org/ns/shacl#") else t
        blocks = []
        for r in self.results.toLocalIterator():
            lines = [f"Constraint Violation in {name(r.component)} ({r.component[1:-1]}):", f"\tSeverity: sh:{name(r.severity)}", f"\tSource Shape: {r.source_shape}", f"\tFocus Node: {r.focus}"]
            lines += [f"\tSource Constraint: {r.source_constraint}"] * (r.source_constraint is not None)
            lines += [f"\tValue Node: {r.value}"] * (r.value is not None) + [f"\tResult Path: {r.path}"] * (r.path is not None) + [f"\tMessage: {m}" for m in sorted(r.messages or [])]
            blocks.append("\n".join(lines) + "\n")
        head = f"Validation Report\nConforms: {conforms}\n"
        return head + (f"Results ({number}):\n" + "".join(sorted(blocks)) if number else "")
