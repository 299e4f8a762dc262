"""A stored graph: terms have numbers, and quads of numbers lie in buckets by subject and, once more, by object. Patterns that meet at
a subject or an object are joined bucket by bucket, without a shuffle; terms are looked up for the solutions alone."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.settle import drop_settled, settle
from .graph import Graph

#: Rows of one subject or object from which it may be hot: it is then kept out of the buckets, in files of even size.
HOT_ROWS = 10_000
#: Terms of clashing numbers that are sent to every task at most; more are joined.
FEW_CLASHES = 1 << 16
#: Characters of a hot term that is sent to every task.
KNOWN_LENGTH = 1_000
#: Slots by which nodes are counted before single nodes are.
SLOTS = 1 << 16
#: A predicate of so many values at most has few, and so many such predicates at most are known.
FEW_VALUES, FEW_PREDICATES = 256, 64
Pattern = tuple[str, str, str]


def _hash(term: Column, turn: int) -> Column:
    return F.xxhash64(term, F.lit(turn))


def is_variable(x: str) -> bool:
    return x.startswith("?")


def number_terms(terms: DataFrame, hashed: Callable[[Column, int], Column] = _hash) -> DataFrame:
    """(id, term, clash) of different terms by their number, a 64-bit hash, so that a term is numbered where it stands. Of terms that share a
    hash the least is given; ``clash`` tells of others, which ``move_clashing`` numbers."""
    # Repeats go by hashing, in every task: the least of texts is found by sorting them.
    numbered = terms.select(hashed(F.col("term"), 0).alias("id"), "term").distinct()
    return numbered.groupBy("id").agg(F.min("term").alias("term"), F.max("term").alias("other")).select("id", "term", (F.col("term") != F.col("other")).alias("clash"))


def move_clashing(terms: DataFrame, dictionary: DataFrame, hashed: Callable[[Column, int], Column] = _hash, most: int = 64) -> DataFrame:
    """(term, id) of the terms that share their first hash with a lesser one: they are hashed anew until all numbers differ."""
    shared = dictionary.where("clash").select("id", F.col("term").alias("least"))
    spark = terms.sparkSession
    moved = spark.createDataFrame([], "term string, id long")
    if shared.isEmpty():
        return moved
    open_ = settle(terms.select("term", hashed(F.col("term"), 0).alias("id")).join(shared, "id").where("term != least").select("term").distinct())
    for turn in range(1, most):
        if open_.isEmpty():
            return moved
        tried = open_.select("term", hashed(F.col("term"), turn).alias("id"))
        free = tried.join(dictionary.select("id").unionByName(moved.select("id")), "id", "left_anti")
        won = settle(free.groupBy("id").agg(F.min("term").alias("term")).select("term", "id"))
        moved, open_ = moved.unionByName(won), settle(open_.join(won, "term", "left_anti"))
    raise RuntimeError("terms can't be told apart by their hashes")


@dataclass
class StoredGraph(Graph):
    """A graph written by ``write_store``. ``hot`` holds, for "s" and "o", the predicates with a node that is kept out of the buckets, ``few`` predicates
    of few values, whose terms every task can tell."""

    spark: SparkSession
    path: str
    buckets: int
    named_graphs: bool
    moved: DataFrame | None
    hot: dict[str, frozenset[int]]
    known_terms: bool
    tables: dict[str, str]
    few: frozenset[str] = frozenset()
    hashed: Callable[[Column, int], Column] = _hash

    # Terms

    def number(self, term: str) -> Column:
        """The number of a term, a constant of the plan."""
        if self.moved is not None and (found := self.moved.where(F.col("term") == term).first()) is not None:
            return F.lit(found["id"])
        return self.hashed(F.lit(term), 0)

    def terms(self) -> DataFrame:
        return self.spark.table(self.tables["terms"])

    def decoded(self, frame: DataFrame, columns: list[str], few: frozenset[str] = frozenset()) -> DataFrame:
        """Numbers in ``columns`` as terms; the dictionary lies in buckets by number, so that only the frame is shuffled. Hot terms are told by
        every task, and their rows are spread. The columns ``few`` have values of predicates of few values only: they need no shuffle."""
        shown = frame.columns
        spread = F.xxhash64(*[frame[c] for c in shown])
        for i, c in enumerate(columns):
            if c in few:
                names = self.spark.read.schema("id long, term string").parquet(f"{self.path}/few_terms").select(F.col("id").alias(f"_number{i}"), F.col("term").alias(f"_term{i}"))
                frame = frame.join(F.broadcast(names), frame[c] == names[f"_number{i}"], "left").drop(f"_number{i}")  # FEW_VALUES * FEW_PREDICATES terms at most
                continue
            if self.known_terms:
                hot = self.spark.read.schema("id long, term string").parquet(f"{self.path}/hot_terms").select(F.col("id").alias(f"_hot{i}"), F.col("term").alias(f"_hot_term{i}"))
                frame = frame.join(F.broadcast(hot), frame[c] == hot[f"_hot{i}"], "left")  # fewer than three terms a bucket, each of KNOWN_LENGTH at most
                frame = frame.withColumn(f"_key{i}", F.when(F.col(f"_hot{i}").isNull(), F.col(f"`{c}`")).otherwise(spread)).drop(f"_hot{i}")
            names = self.terms().select(F.col("id").alias(f"_number{i}"), F.col("term").alias(f"_term{i}"))
            frame = frame.join(names, frame[f"_key{i}" if self.known_terms else c] == names[f"_number{i}"], "left").drop(f"_number{i}")
        term = lambda i: F.coalesce(f"_hot_term{i}", f"_term{i}") if self.known_terms and columns[i] not in few else F.col(f"_term{i}")
        return frame.select(*[term(columns.index(c)).alias(c) if c in columns else F.col(f"`{c}`") for c in shown])

    # Patterns of numbers

    def scan(self, side: str, predicate: str | None = None) -> DataFrame:
        """(s, p, o) as numbers, in buckets by ``side``, unless a node of this predicate is hot."""
        p = self.number(predicate) if predicate is not None else None
        rows = self.spark.table(self.tables[f"by_{side}"])
        rows = rows.where(F.col("p") == p) if p is not None else rows
        hot = self.hot[side]
        # Whether a predicate is among the hot ones is told on the driver: there are fewer of them than buckets times predicates.
        if hot and (p is None or self.spark.range(1).select(p.isin(*hot).alias("x")).first()["x"]):
            even = self.spark.read.schema("s long, p long, o long, g long").parquet(f"{self.path}/hot_{side}")
            rows = rows.unionByName(even.where(F.col("p") == p) if p is not None else even)
        rows = rows.select("s", "p", "o")
        return rows.distinct() if self.named_graphs else rows  # a triple may be in several graphs

    def solution_numbers(self, patterns: list[Pattern]) -> DataFrame:
        """Solutions of connected patterns, a column of numbers for each variable, named without its question mark. The patterns around one
        node are joined in its buckets; then only what was found is moved to the buckets of the next node."""
        todo, now = list(patterns), None
        while todo:
            known = set(now.columns) if now is not None else set()
            places: dict[str, int] = {}
            for s, _, o in todo:
                for x in {s, o}:
                    if is_variable(x) and (now is None or x[1:] in known):
                        places[x] = places.get(x, 0) + 1
            hub = max(sorted(places), key=lambda x: places[x]) if places else None
            around = [p for p in todo if hub in (p[0], p[2])] if hub is not None else [next((p for p in todo if is_variable(p[1]) and p[1][1:] in known), todo[0])]
            for pattern in around:
                todo.remove(pattern)
                part = self._pattern(pattern, hub)
                shared = [c for c in part.columns if now is not None and c in now.columns]
                if now is not None and not shared:
                    raise ValueError("the patterns have to be connected by variables")
                now = part if now is None else now.join(part, shared)
        if now is None:
            raise ValueError("there is no pattern")
        return now

    def _pattern(self, pattern: Pattern, hub: str | None) -> DataFrame:
        s, p, o = pattern
        rows = self.scan("o" if hub == o and hub != s else "s", None if is_variable(p) else p)
        out: dict[str, str] = {}
        for column, x in zip("spo", pattern, strict=True):
            if not is_variable(x):
                rows = rows.where(F.col(column) == self.number(x)) if column != "p" else rows
            elif x[1:] in out:
                rows = rows.where(F.col(column) == F.col(out[x[1:]]))
            else:
                out[x[1:]] = column
        return rows.select(*[F.col(c).alias(n) for n, c in out.items()])

    def solutions(self, patterns: list[Pattern]) -> DataFrame:
        """Solutions of connected patterns ("?name" is a variable, all else a term), as terms. At least one variable has to be there."""
        found = self.solution_numbers(patterns)
        return self.decoded(found, found.columns, frozenset(o[1:] for _, p, o in patterns if is_variable(o) and p in self.few))

    # The graph as others are

    def pred(self, predicate: str) -> DataFrame:
        return self.solutions([("?s", predicate, "?o")])

    def triples(self) -> DataFrame:
        return self.solutions([("?s", "?p", "?o")])

    def quads(self) -> DataFrame:
        rows = self.spark.table(self.tables["by_s"])
        if self.hot["s"]:
            rows = rows.unionByName(self.spark.read.schema("s long, p long, o long, g long").parquet(f"{self.path}/hot_s"))
        return self.decoded(rows.where("g IS NOT NULL").select("s", "p", "o", "g"), ["s", "p", "o", "g"])


_COLUMNS = {"terms": "id BIGINT, term STRING, clash BOOLEAN", "by_s": "s BIGINT, p BIGINT, o BIGINT, g BIGINT", "by_o": "s BIGINT, p BIGINT, o BIGINT, g BIGINT"}
_KEYS = {"terms": ("id", "id"), "by_s": ("s", "p, s"), "by_o": ("o", "p, o")}


def write_store(graph: Graph, path: str, buckets: int | None = None, hot_rows: int = HOT_ROWS, hashed: Callable[[Column, int], Column] = _hash) -> StoredGraph:
    """A graph, with its named graphs, written to a new folder that the cluster shares.

    ``buckets`` is ``spark.sql.shuffle.partitions`` unless given: take as many as make a bucket fit a task. A node with more than ``hot_rows``
    rows, and more than a bucket has on average, is hot: there are fewer such nodes than buckets, whatever the data. Repeated quads are stored once.
    The graph is read twice, for its terms and for its quads; no text is written but in the dictionary."""
    spark = graph.spark
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = graph.triples().select("s", "p", "o")
    named = settle(graph.quads().select("s", "p", "o", "g"))
    with_names = not named.isEmpty()
    texts = plain.withColumn("g", F.lit(None).cast("string"))
    if with_names:  # what stands in a named graph isn't stored once more without its name
        texts = texts.join(named, ["s", "p", "o"], "left_anti").unionByName(named)
    tables = {kind: f"graphwright_{uuid.uuid4().hex}_{kind}" for kind in _COLUMNS}
    every = texts.select(F.explode(F.array(*[F.col(c) for c in ("s", "p", "o", "g")])).alias("term")).where("term IS NOT NULL") if with_names else graph.each_term()
    _bucketed(number_terms(every, hashed).repartition(n, "id"), "terms", tables, path, n)
    moved = settle(move_clashing(every, spark.table(tables["terms"]), hashed))
    moved.write.parquet(f"{path}/moved")
    few = moved.count()
    if few:
        _bucketed(moved.select("id", "term", F.lit(False).alias("clash")).repartition(n, "id"), "terms", tables, path, n)
    quads = texts
    for c in "spog":
        quads = quads.withColumn(f"_{c}", F.when(F.col(c).isNotNull(), hashed(F.col(c), 0)))
        if few:
            other = moved.select(F.col("term").alias(c), F.col("id").alias("_moved"))
            quads = quads.join(F.broadcast(other) if few <= FEW_CLASHES else other, c, "left").withColumn(f"_{c}", F.coalesce("_moved", f"_{c}")).drop("_moved")
    quads = settle(quads.select(*[F.col(f"_{c}").alias(c) for c in "spog"]).distinct())
    limit = max(hot_rows, quads.count() // n)
    hot_predicates, hot_terms = [], []
    for side in ("s", "o", "p"):
        hot = hot_nodes(quads, side, limit)
        hot_terms += hot
        if side == "p":
            continue
        cold = quads.where(~F.col(side).isin(*hot)) if hot else quads
        _bucketed(cold.repartition(n, side), f"by_{side}", tables, path, n)
        if hot:
            even = quads.where(F.col(side).isin(*hot)).repartition(n, "s", "o", "p").sortWithinPartitions("p", side)
            even.write.parquet(f"{path}/hot_{side}")
            hot_predicates += [(side, r["p"]) for r in spark.read.parquet(f"{path}/hot_{side}").select("p").distinct().collect()]
    few, few_terms = _few_valued(quads, spark.table(tables["terms"]).select("id", "term"), hot_rows)
    few_terms.coalesce(1).write.parquet(f"{path}/few_terms")
    spark.createDataFrame([(p,) for p in few], "p string").coalesce(1).write.parquet(f"{path}/few_predicates")
    known = spark.table(tables["terms"]).where(F.col("id").isin(*hot_terms) & (F.length("term") <= KNOWN_LENGTH)).select("id", "term")
    known.coalesce(1).write.parquet(f"{path}/hot_terms")
    spark.createDataFrame(hot_predicates, "side string, p long").coalesce(1).write.parquet(f"{path}/hot_predicates")
    spark.createDataFrame([(n, with_names)], "buckets int, named boolean").coalesce(1).write.parquet(f"{path}/about")
    for frame in (named, moved, quads):
        drop_settled(frame)
    return _opened(spark, path, tables, hashed)


def hot_nodes(quads: DataFrame, side: str, limit: int) -> list[int]:
    """The nodes of a side with more than ``limit`` rows. Rows are counted by slots, and single nodes in slots that have more than ``limit`` only."""
    slot = F.pmod(F.col(side), F.lit(SLOTS))
    full = [r["slot"] for r in quads.groupBy(slot.alias("slot")).count().where(F.col("count") > limit).select("slot").collect()]
    some = quads.where(slot.isin(*full)).groupBy(side).count().where(F.col("count") > limit).select(side) if full else None
    return [r[side] for r in some.collect()] if some is not None else []


def _few_valued(quads: DataFrame, terms: DataFrame, least_rows: int) -> tuple[list[str], DataFrame]:
    """Predicates of more than ``least_rows`` rows and of FEW_VALUES values at most, each of KNOWN_LENGTH characters at most; and (id, term) of their
    values. Of more than FEW_PREDICATES those of the most rows."""
    counted = quads.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("o").alias("values"))
    likely = [r["p"] for r in counted.where((F.col("n") > least_rows) & (F.col("values") <= 2 * FEW_VALUES)).orderBy(F.desc("n"), "p").limit(FEW_PREDICATES).collect()]
    if not likely:
        return [], terms.limit(0)
    pairs = [(r["p"], r["o"]) for r in quads.where(F.col("p").isin(*likely)).select("p", "o").distinct().collect()]  # some hundred values each
    wanted = terms.sparkSession.createDataFrame([(x,) for x in {x for pair in pairs for x in pair}], "id long")
    told = {r["id"]: r["term"] for r in terms.where(F.length("term") <= KNOWN_LENGTH).join(F.broadcast(wanted), "id").collect()}
    values: dict[int, set[int]] = {}
    for p, o in pairs:
        values.setdefault(p, set()).add(o)
    few = [p for p, found in values.items() if len(found) <= FEW_VALUES and p in told and found <= told.keys()]
    rows = [(x, told[x]) for x in {x for p in few for x in values[p]}]
    return [told[p] for p in few], terms.sparkSession.createDataFrame(rows, "id long, term string")


def _bucketed(frame: DataFrame, kind: str, tables: dict[str, str], path: str, n: int) -> None:
    key, order = _KEYS[kind]
    frame.write.mode("append").bucketBy(n, key).sortBy(*order.split(", ")).format("parquet").option("path", f"{path}/{kind}").saveAsTable(tables[kind])


def open_store(spark: SparkSession, path: str, hashed: Callable[[Column, int], Column] = _hash) -> StoredGraph:
    """A folder that ``write_store`` wrote, perhaps in another session."""
    n = spark.read.parquet(f"{path}/about").first()["buckets"]
    tables = {kind: f"graphwright_{uuid.uuid4().hex}_{kind}" for kind in _COLUMNS}
    for kind, name in tables.items():
        key, order = _KEYS[kind]
        spark.sql(f"CREATE TABLE {name} ({_COLUMNS[kind]}) USING parquet CLUSTERED BY ({key}) SORTED BY ({order}) INTO {n} BUCKETS LOCATION '{path}/{kind}'")
    return _opened(spark, path, tables, hashed)


def _opened(spark: SparkSession, path: str, tables: dict[str, str], hashed: Callable[[Column, int], Column]) -> StoredGraph:
    about = spark.read.parquet(f"{path}/about").first()
    moved = spark.read.schema("term string, id long").parquet(f"{path}/moved")
    known = spark.read.schema("id long, term string").parquet(f"{path}/hot_terms")
    few = frozenset(r["p"] for r in spark.read.schema("p string").parquet(f"{path}/few_predicates").collect())
    hot: dict[str, set[int]] = {"s": set(), "o": set()}
    for r in spark.read.schema("side string, p long").parquet(f"{path}/hot_predicates").collect():
        hot[r["side"]].add(r["p"])
    return StoredGraph(spark, path, about["buckets"], about["named"], None if moved.isEmpty() else moved, {k: frozenset(v) for k, v in hot.items()}, not known.isEmpty(), tables, few, hashed)
