"""Graphs as Spark frames: a triple table, or tables mapped to triples on the fly."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import RDF, SUBCLASS, TYPE, XSD


class Graph:
    """``pred(p)`` gives (s, o) of a predicate, ``triples()`` gives (s, p, o); both may repeat rows."""

    spark: SparkSession

    def pred(self, predicate: str) -> DataFrame:
        raise NotImplementedError

    def triples(self) -> DataFrame:
        raise NotImplementedError

    def each_term(self) -> DataFrame:
        """(term) of every term of ``triples()``, at least once."""
        return self.triples().select(F.explode(F.array("s", "p", "o")).alias("term"))

    def empty(self) -> DataFrame:
        return self.spark.createDataFrame([], "s string, o string")

    def count(self) -> int:
        """The number of different triples."""
        return self.triples().distinct().count()

    def contains(self, triples: DataFrame) -> DataFrame:
        """The rows (s, p, o) of ``triples`` that are in the graph."""
        return triples.join(self.triples(), ["s", "p", "o"], "left_semi")

    def quads(self) -> DataFrame:
        """(s, p, o, g) of the named graphs; those of a graph without names are none."""
        return self.spark.createDataFrame([], "s string, p string, o string, g string")

    def named(self, name: str) -> Graph:
        """The named graph."""
        return TripleTable(self.spark, self.quads().where(F.col("g") == name).drop("g"))


@dataclass
class TripleTable(Graph):
    """A frame with columns s, p, o and perhaps g; all graphs are seen as one. If it is read from a folder that
    ``store`` wrote, a constant predicate prunes the files that are read."""

    spark: SparkSession
    frame: DataFrame

    def pred(self, predicate: str) -> DataFrame:
        return self.frame.where(F.col("p") == predicate).select("s", "o")

    def triples(self) -> DataFrame:
        return self.frame.select("s", "p", "o")

    def quads(self) -> DataFrame:
        return self.frame.select("s", "p", "o", "g").where("g IS NOT NULL") if "g" in self.frame.columns else Graph.quads(self)

    def plus(self, more: DataFrame) -> TripleTable:
        return TripleTable(self.spark, self.triples().unionByName(more.select("s", "p", "o")).distinct())

    def store(self, path: str) -> TripleTable:
        """The table written to a folder for each predicate, and read from there."""
        self.triples().write.partitionBy("p").parquet(path)
        return TripleTable(self.spark, self.spark.read.schema("s string, o string, p string").parquet(path).select("s", "p", "o"))


@dataclass
class Layered(Graph):
    """A graph with triples added to it; nothing of the graph is written anew."""

    spark: SparkSession
    base: Graph
    added: DataFrame

    def pred(self, predicate: str) -> DataFrame:
        return self.base.pred(predicate).unionByName(self.added.where(F.col("p") == predicate).select("s", "o"))

    def triples(self) -> DataFrame:
        return self.base.triples().unionByName(self.added.select("s", "p", "o"))

    def quads(self) -> DataFrame:
        return self.base.quads()

    def missing(self, found: DataFrame) -> DataFrame:
        """The rows (s, p, o) of ``found`` that aren't in the graph. Of the graph only the predicates of ``found`` are
        read, if they are few."""
        names = [r["p"] for r in found.select("p").distinct().limit(FEW_PREDICATES + 1).collect()]
        if len(names) > FEW_PREDICATES:
            return found.join(self.triples(), ["s", "p", "o"], "left_anti")
        for p in names:
            found = found.join(self.pred(p).withColumn("p", F.lit(p)), ["s", "p", "o"], "left_anti")
        return found


@dataclass
class MappedTables(Graph):
    """Each predicate is a projection of tables: nothing is written as triples, and a scan reads the two mapped columns only."""

    spark: SparkSession
    parts: dict[str, list[tuple[DataFrame, Column, Column]]] = field(default_factory=dict)

    def add(self, predicate: str, frame: DataFrame, s: Column, o: Column) -> None:
        self.parts.setdefault(predicate, []).append((frame, s, o))

    def pred(self, predicate: str) -> DataFrame:
        found = [frame.select(s.alias("s"), o.alias("o")).where("s IS NOT NULL AND o IS NOT NULL") for frame, s, o in self.parts.get(predicate, ())]
        return reduce(DataFrame.unionByName, found) if found else self.empty()

    def triples(self) -> DataFrame:
        found = [self.pred(p).select("s", F.lit(p).alias("p"), "o") for p in self.parts]
        return reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], "s string, p string, o string")

    def each_term(self) -> DataFrame:
        """Of the predicates of a frame that share their subject's column, that is given once a row."""
        rows: dict[tuple[int, int], tuple[DataFrame, Column, list[Column]]] = {}
        for parts in self.parts.values():
            for frame, s, o in parts:
                rows.setdefault((id(frame), id(s)), (frame, s, []))[2].append(o)
        found = [self.spark.createDataFrame([(p,) for p in self.parts], "term string")]
        for frame, s, values in rows.values():
            given = frame.select(s.alias("s"), *[o.alias(f"o{i}") for i, o in enumerate(values)])
            names = given.columns[1:]
            given = given.where(F.col("s").isNotNull() & F.coalesce(*names).isNotNull())
            found.append(given.select(F.explode(F.array("s", *names)).alias("term")).where("term IS NOT NULL"))
        return reduce(DataFrame.unionByName, found)


#: Predicates of new triples that are looked up one by one.
FEW_PREDICATES = 16
EX = "urn:ex:"


def _key(kind: str, column: str) -> Column:
    return F.concat(F.lit(f"<urn:{kind}:"), F.col(column).cast("string"), F.lit(">"))


def _value(column: str, name: str) -> Column:
    return F.concat(F.lit('"'), F.col(column).cast("string"), F.lit(f'"^^<{XSD}{name}>'))


#: Table -> (kind, key column, {column: datatype, or the kind of the row that it refers to, led by @}).
DIRECT = {
    "region": ("region", "r_regionkey", {"r_name": "string"}),
    "nation": ("nation", "n_nationkey", {"n_name": "string", "n_regionkey": "@region"}),
    "customer": ("customer", "c_custkey", {"c_name": "string", "c_acctbal": "double", "c_mktsegment": "string", "c_nationkey": "@nation"}),
    "supplier": ("supplier", "s_suppkey", {"s_name": "string", "s_acctbal": "double", "s_nationkey": "@nation"}),
    "part": ("part", "p_partkey", {"p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "integer", "p_retailprice": "double"}),
    "orders": ("order", "o_orderkey", {"o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "dateTime", "o_orderpriority": "string", "o_custkey": "@customer"}),
    "lineitem": ("order", "l_orderkey", {"l_quantity": "double", "l_discount": "double", "l_returnflag": "string", "l_shipdate": "dateTime", "l_partkey": "@part", "l_suppkey": "@supplier"}),
    "events": ("event", "event_id", {"event_type": "string", "value": "double", "props": "string", "user_id": "@user"}),
}


def mapped(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = tuple(DIRECT)) -> MappedTables:
    """Tables as a graph by a direct mapping: row -> ``urn:kind:key``, column -> ``urn:ex:column``, foreign key -> IRI.
    Documents carry their text with its language, and turns of a conversation point to the next one."""
    graph = MappedTables(spark)
    for table in tables:
        frame = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        if table in DIRECT:
            kind, key, columns = DIRECT[table]
            s = _key(kind, key)
            if table != "lineitem":
                graph.add(TYPE, frame, s, F.lit(f"<{EX}{kind.capitalize()}>"))
            for column, what in columns.items():
                if what == "dateTime":
                    value = F.concat(F.lit('"'), F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(f'"^^<{XSD}dateTime>'))
                else:
                    value = _key(what[1:], column) if what[0] == "@" else _value(column, what)
                graph.add(f"<{EX}{column}>", frame, s, value)
        elif table == "documents":
            s = _key("doc", "doc_id")
            graph.add(TYPE, frame, s, F.lit(f"<{EX}Document>"))
            graph.add(f"<{EX}text>", frame, s, F.concat(F.lit('"'), F.col("text"), F.lit('"@'), F.col("lang")))
            graph.add(f"<{EX}source>", frame, s, F.concat(F.lit("<urn:source:"), F.col("source"), F.lit(">")))
            graph.add(f"<{EX}of>", frame, F.concat(F.lit("<urn:source:"), F.col("source"), F.lit(">")), F.concat(F.lit('"'), F.sha2("text", 256), F.lit('"@'), F.col("lang")))
        elif table == "conversations":
            turn = lambda n: F.concat(F.lit("<urn:turn:"), F.col("conv_id").cast("string"), F.lit(":"), n.cast("string"), F.lit(">"))
            graph.add(TYPE, frame, turn(F.col("turn")), F.lit(f"<{EX}Turn>"))
            graph.add(f"<{EX}role>", frame, turn(F.col("turn")), _value("role", "string"))
            graph.add(f"<{EX}next>", frame.where("turn > 0"), turn(F.col("turn") - 1), turn(F.col("turn")))
    return graph


def from_text(spark: SparkSession, text: str, base: str = "", scope: str = "", name: str | None = None) -> TripleTable:
    """A text in Turtle, TriG, N-Triples, N-Quads, RDF/XML or JSON-LD: told by the ending of ``name``, else by its first characters."""
    from .formats import parse_text

    rows = sorted(set(parse_text(text, name, base, scope)), key=lambda q: (*q[:3], q[3] or ""))
    return TripleTable(spark, spark.createDataFrame(rows, "s string, p string, o string, g string"))


#: One N-Triples or N-Quads statement: the bulk formats, which split, so any number of tasks read a file.
_LINE = r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:[^\s.]+(?:\.[^\s.]+)*|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*(<[^>]*>|_:\S+)?\s*\.\s*(?:#.*)?$'


_NUMBERED = r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})"


def _good_lines(frame: DataFrame, good: Column, empty: Column, bad_lines: str) -> DataFrame:
    """The good lines. Others than empty ones and comments are an error, or are left out if ``bad_lines`` is "skip"."""
    if bad_lines not in ("raise", "skip"):
        raise ValueError("bad_lines is raise or skip")
    wrong = F.lit(False) if bad_lines == "skip" else F.raise_error(F.concat(F.lit("this line can't be read: "), F.substring("value", 1, 200))).cast("boolean")
    return frame.where(F.when(good, True).when(empty, False).otherwise(wrong))


def unescaped(term: Column) -> Column:
    """A term with its escapes resolved, \\u and \\U too."""
    out = term
    # A doubled backslash is set aside first, so that what it stands before is no escape.
    for escape, char in (("\\\\", "\x00"), ('\\"', '"'), ("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ("\\b", "\b"), ("\\f", "\f"), ("\\'", "'")):
        out = F.replace(out, F.lit(escape), F.lit(char))
    whole = F.regexp_extract_all(out, F.lit(_NUMBERED), F.lit(0))
    between = F.split(out, _NUMBERED, -1)
    char = lambda x: F.decode(F.unhex(F.lpad(F.substring(x, F.lit(3), F.length(x)), 8, "0")), "UTF-32")
    joined = F.array_join(F.zip_with(between, F.concat(whole, F.array(F.lit(""))), lambda a, x: F.concat(a, F.when(x == "", "").otherwise(char(x)))), "")
    out = F.when(F.rlike(out, F.lit(_NUMBERED)), joined).otherwise(out)
    return F.when(F.contains(term, F.lit("\\")), F.replace(out, F.lit("\x00"), F.lit("\\"))).otherwise(term)


def read_ntriples(spark: SparkSession, path: str, bad_lines: str = "raise") -> TripleTable:
    """N-Triples and N-Quads of any size by a native projection of text lines. Escapes are resolved, so a term is the same
    whichever format it comes from. A line that is no statement, no comment and not empty raises an error when it is
    read, or is left out with ``bad_lines="skip"``."""
    part = lambda i: F.regexp_extract("value", _LINE, i)
    lines = _good_lines(spark.read.text(path), F.rlike("value", F.lit(_LINE)), F.rlike("value", F.lit(r"^\s*(#.*)?$")), bad_lines)
    rows = lines.select(part(1).alias("s"), part(2).alias("p"), part(3).alias("o"), F.nullif(part(4), F.lit("")).alias("g"))
    o = F.col("o")
    plain = F.when(F.startswith(o, F.lit('"')) & F.endswith(o, F.lit('"')), F.concat(o, F.lit(f"^^<{XSD}string>"))).otherwise(o)
    return TripleTable(spark, rows.select(unescaped(F.col("s")).alias("s"), unescaped(F.col("p")).alias("p"), unescaped(plain).alias("o"), "g").distinct())


def read_hextuples(spark: SparkSession, path: str, bad_lines: str = "raise") -> TripleTable:
    """HexTuples (a JSON array of six strings a line) of any size, by native JSON functions; other lines as for ``read_ntriples``."""
    x = F.col("x")
    node = lambda t: F.when(F.startswith(t, F.lit("_:")), t).otherwise(F.concat(F.lit("<"), t, F.lit(">")))
    value, kind, lang = x[2], x[3], F.get("x", F.lit(4))
    o = (
        F.when(kind.isin("globalId", "localId"), node(value))
        .when(F.coalesce(lang, F.lit("")) != "", F.concat(F.lit('"'), value, F.lit('"@'), lang))
        .otherwise(F.concat(F.lit('"'), value, F.lit('"^^<'), F.when(F.coalesce(kind, F.lit("")) == "", XSD + "string").otherwise(kind), F.lit(">")))
    )
    parsed = spark.read.text(path).withColumn("x", F.from_json("value", "array<string>"))
    rows = _good_lines(parsed, F.coalesce(F.size("x") >= 4, F.lit(False)), F.rlike("value", F.lit(r"^\s*$")), bad_lines).select("x")
    return TripleTable(spark, rows.select(node(x[0]).alias("s"), F.concat(F.lit("<"), x[1], F.lit(">")).alias("p"), o.alias("o"), F.nullif(F.get("x", F.lit(5)), F.lit("")).alias("g")).distinct())


def escaped(term: Column) -> Column:
    out = term
    for char, escape in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(char), F.lit(escape))
    inner = F.substring(out, F.lit(2), F.length(out) - F.length(F.substring_index(out, '"', -1)) - 2)
    text = F.concat(F.lit('"'), F.replace(inner, F.lit('"'), F.lit('\\"')), F.lit('"'), F.substring_index(out, '"', -1))
    return F.when(F.startswith(term, F.lit('"')), text).otherwise(term)


def ntriples(frame: DataFrame) -> DataFrame:
    """(value): a line of N-Triples for each row (s, p, o)."""
    return frame.select(F.concat(F.col("s"), F.lit(" "), F.col("p"), F.lit(" "), escaped(F.col("o")), F.lit(" .")).alias("value"))


def nquads(frame: DataFrame) -> DataFrame:
    """(value): a line of N-Quads for each row (s, p, o, g); without a graph where g is null."""
    return frame.select(F.concat_ws(" ", "s", "p", escaped(F.col("o")), "g", F.lit(".")).alias("value"))


def write_ntriples(frame: DataFrame, path: str) -> None:
    """(s, p, o) as N-Triples, a file a task."""
    ntriples(frame).write.text(path)


NIL, FIRST, REST = f"<{RDF}nil>", f"<{RDF}first>", f"<{RDF}rest>"
__all__ = ["EX", "FIRST", "Graph", "Layered", "MappedTables", "NIL", "REST", "SUBCLASS", "TripleTable", "from_text", "mapped", "nquads", "read_hextuples", "ntriples", "read_ntriples", "write_ntriples"]
