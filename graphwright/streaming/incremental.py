"""Validation of a stream of triples: each micro-batch's focus nodes are validated against the whole table.

This goes beyond batch validation and holds for shapes whose constraints read a focus node's own triples only
(no inverse or transitive paths, sh:class or SPARQL): another node's triples can't change their results.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.terms import SUBCLASS
from ..operators.targets import focus_nodes
from ..plans.compile import Run
from ..plans.shapes import ShapesGraph
from ..sources.graph import TripleTable


TRIPLE = "s string, p string, o string"


def validate_stream(stream: DataFrame, shapes: ShapesGraph, table: str, sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Adds each micro-batch of (s, p, o) to the Parquet folder ``table``, in a folder of its own that a repeated batch
    replaces, then gives the results of the target nodes that the batch touches to ``sink(results, batch id)``,
    once a batch. Of the table only the triples of these nodes and the class hierarchy are kept for a batch.
    ``available_now`` ends the query when what is there by now has been read."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows.select("s", "p", "o").write.mode("overwrite").parquet(f"{table}/batch={number}")
        known = spark.read.schema(TRIPLE + ", batch long").parquet(table).select("s", "p", "o")
        touched = spark.read.schema(TRIPLE).parquet(f"{table}/batch={number}").select("s").distinct()
        own = known.join(touched, "s", "left_semi").unionByName(known.where(F.col("p") == SUBCLASS)).distinct()
        run = Run(TripleTable(spark, own), shapes)
        nodes = touched.withColumnRenamed("s", "f")
        found = [run.results(shape.node, focus_nodes(run.graph, shapes, shape).join(nodes, "f", "left_semi")).drop("root") for shape in run.targeted()]
        sink(reduce(DataFrame.unionByName, found) if found else run.empty(), number)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
