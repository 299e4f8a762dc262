"""Equal nodes as components with one representative each: triples are rewritten to representatives, and expanded at the end."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import OWL, TYPE, iri
from ..plans.settle import drop_settled, settle
from ..sources.graph import Graph
from .paths import list_items

SAME = iri(OWL + "sameAs")
#: Nodes of a class that are written out by one task, for as many triples; and tasks that do so.
BLOCK, MOST_TASKS = 1024, 4096


def components(pairs: DataFrame) -> DataFrame:
    """(node, rep): the smallest node that is reached by pairs (a, b), for every node of a pair. In each round a node takes the smallest
    representative among its neighbours', and then that one's own, so that the rounds grow with the logarithm of the longest way."""
    both = pairs.select("a", "b").where("a != b")
    both = settle(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = settle(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("rep")))
    while True:
        near = both.join(now.toDF("b", "rep"), "b").groupBy("a").agg(F.min("rep").alias("m")).withColumnRenamed("a", "node")
        least = now.join(near, "node").select("node", F.least("rep", "m").alias("rep"))
        step = settle(least)
        after = settle(step.join(step.toDF("rep", "further"), "rep").select("node", F.col("further").alias("rep")))
        done = after.join(now.toDF("node", "before"), "node").where("rep != before").isEmpty()
        for frame in (now, step):
            drop_settled(frame)
        now = after
        if done:
            drop_settled(both)
            return now


def _predicates(triples: DataFrame, equal: DataFrame, column: str) -> DataFrame | None:
    """Of the equal nodes those whose ``column`` is a predicate of the triples, broadcast if they are as few as schemas have; None if there are none."""
    used = triples.select(F.col("p").alias(column)).distinct()
    found = settle(equal.join(used, column, "left_semi").select("node", "rep"))
    n = found.limit(MOST_PROPERTIES + 1).count()
    return (F.broadcast(found) if n <= MOST_PROPERTIES else found) if n else None


def rewritten(triples: DataFrame, equal: DataFrame) -> DataFrame:
    """Each term by its representative."""
    for c in ("s", "p", "o"):
        nodes = _predicates(triples, equal, "node") if c == "p" else equal
        if nodes is not None:
            triples = triples.join(nodes.select(F.col("node").alias(c), F.col("rep").alias("_rep")), c, "left").withColumn(c, F.coalesce("_rep", c)).drop("_rep")
    return triples.select("s", "p", "o").distinct()


def expanded(triples: DataFrame, equal: DataFrame, block: int | None = None) -> DataFrame:
    """Each triple of representatives for all of their nodes: the whole closure, which grows with the square of a class. Different triples give different ones.

    A class of more than ``block`` (BLOCK) nodes is dealt into blocks by the nodes' hashes, and the triples at it into as many shares: each block meets
    each share under a key of its own, so that no task has a whole class. Predicates come first, so that a filter on them is moved to the scan."""
    if (nodes := _predicates(triples, equal, "rep")) is not None:
        triples = triples.join(nodes.select(F.col("rep").alias("p"), F.col("node").alias("_node")), "p", "left").withColumn("p", F.coalesce("_node", "p")).drop("_node")
    size = block or BLOCK
    large = settle(equal.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > size).select("rep", F.ceil(F.col("n") / size).cast("int").alias("_n")))
    few, pairs = large.agg(F.count(F.lit(1)), F.sum(F.col("_n").cast("double") ** 2)).first()
    tasks = min(MOST_TASKS, int(pairs or 0))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = lambda *of: F.pmod(F.xxhash64(*of), F.col("_n")).cast("int")
    for c in ("s", "o"):
        nodes = equal.select(F.col("rep").alias(c), F.col("node").alias("_node"))
        if not few:
            triples = triples.join(nodes, c, "left").withColumn(c, F.coalesce("_node", c)).drop("_node")
            continue
        sizes = large.withColumnRenamed("rep", c)
        sizes = F.broadcast(sizes) if few <= MOST_PROPERTIES else sizes
        dealt = lambda x: x.join(sizes, c, "left").withColumn("_large", F.col("_n").isNotNull()).withColumn("_n", F.coalesce("_n", F.lit(1)))  # noqa: B023, E731
        keys = [c, "_block", "_share"]
        left = dealt(triples).withColumn("_share", own("s", "p", "o")).withColumn("_block", numbers(F.col("_n"))).drop("_n").repartition(tasks, *keys)
        right = dealt(nodes).withColumn("_block", own("_node")).withColumn("_share", numbers(F.col("_n"))).select(*keys, "_node").repartition(tasks, *keys)
        # A block may be empty: only terms that aren't of a large class stay as they are where they meet no node.
        triples = left.join(right, keys, "left").where(F.col("_node").isNotNull() | ~F.col("_large")).withColumn(c, F.coalesce("_node", c)).select("s", "p", "o")
    return triples.select("s", "p", "o")


def _typed(t: DataFrame, name: str) -> DataFrame:
    return t.where((F.col("p") == TYPE) & (F.col("o") == iri(OWL + name))).select(F.col("s").alias("p"))


def keys_of(graph: Graph) -> list[tuple[str, list[str]]]:
    """(class, key properties) of each owl:hasKey; a schema has few."""
    told = settle(graph.pred(iri(OWL + "hasKey")).select(F.col("s").alias("c"), F.col("o").alias("f")).distinct())
    if told.isEmpty():
        return []
    found: dict[tuple[str, str], list[tuple[int, str]]] = {}
    for r in told.join(list_items(graph, told.select("f")), "f").collect():
        found.setdefault((r["c"], r["f"]), []).append((r["n"], r["v"]))
    return [(c, [p for _, p in sorted(ps)]) for (c, _), ps in sorted(found.items())]


def may_equal(known: DataFrame) -> bool:
    """Whether anything but a key says that nodes are equal."""
    kinds = [iri(OWL + n) for n in ("FunctionalProperty", "InverseFunctionalProperty")]
    return not known.where(((F.col("p") == SAME) & (F.col("s") != F.col("o"))) | ((F.col("p") == TYPE) & F.col("o").isin(*kinds))).isEmpty()


def equal_none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "a string, b string")


def equal_pairs(known: DataFrame, keys: list[tuple[str, list[str]]]) -> DataFrame:
    """(a, b): pairs that sameAs, functional and inverse functional properties and keys make equal. Of a group of equal nodes each is paired with
    the least one, so there are no more pairs than nodes of groups."""
    found = [known.where(F.col("p") == SAME).select(F.col("s").alias("a"), F.col("o").alias("b"))]
    for name, by, of in (("FunctionalProperty", "s", "o"), ("InverseFunctionalProperty", "o", "s")):
        facts = known.join(F.broadcast(_typed(known, name).distinct().limit(MOST_PROPERTIES)), "p")
        least = facts.groupBy(by, "p").agg(F.min(of).alias("b"), F.max(of).alias("_most")).where("b != _most").drop("_most")
        found.append(facts.join(least, [by, "p"]).select(F.col(of).alias("a"), "b"))
    for c, properties in keys:
        nodes = known.where((F.col("p") == TYPE) & (F.col("o") == c)).select("s").distinct()
        values = [known.where(F.col("p") == p).select("s", F.col("o").alias(f"k{i}")).distinct() for i, p in enumerate(properties)]
        told = reduce(lambda x, y: x.join(y, "s"), values, nodes)
        names = [f"k{i}" for i in range(len(properties))]
        least = told.groupBy(*names).agg(F.min("s").alias("b"), F.max("s").alias("_most")).where("b != _most").drop("_most")
        found.append(told.join(least, names).select(F.col("s").alias("a"), "b"))
    pairs = reduce(DataFrame.unionByName, found).where("a != b").distinct()
    return pairs.where(~F.startswith("a", F.lit('"')) & ~F.startswith("b", F.lit('"')))


#: A schema of more properties of one kind than this is an error.
MOST_PROPERTIES = 1 << 16


def clashes(graph: Graph) -> DataFrame:
    """(rule, node, a, b): contradictions in a graph, which inference doesn't add by itself: run it over ``expand(graph, "owlrl")``.

    Nodes of disjoint or complementary classes (a, b) and of owl:Nothing, pairs of nodes related by disjoint properties, by an
    irreflexive property to themselves or by an asymmetric one both ways, nodes that are both equal and different, and members
    of owl:AllDisjointClasses. A clash stands once, with a before b.
    """
    t = graph.triples().distinct()
    pred = lambda n: t.where(F.col("p") == iri(OWL + n)).select(F.col("s").alias("a"), F.col("o").alias("b"))
    out = []

    def say(rule: str, frame: DataFrame, node: str = "s") -> None:
        out.append(frame.select(F.lit(rule).alias("rule"), F.col(node).alias("node"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))

    types = t.where(F.col("p") == TYPE).select("s", F.col("o").alias("c"))
    both = lambda pairs: types.withColumnRenamed("c", "a").join(pairs, "a").join(types.toDF("s", "b"), ["s", "b"])
    say("cax-dw", both(pred("disjointWith")))
    say("cls-com", both(pred("complementOf")))
    nothing = types.where(F.col("c") == iri(OWL + "Nothing"))
    say("cls-nothing", nothing.select("s", F.col("c").alias("a"), F.col("c").alias("b")))
    lists = t.where((F.col("p") == TYPE) & (F.col("o") == iri(OWL + "AllDisjointClasses"))).select("s").join(graph.pred(iri(OWL + "members")).distinct(), "s").select(F.col("o").alias("f"))
    lists = settle(lists.distinct())
    if not lists.isEmpty():
        members = list_items(graph, lists)
        say("cax-adc", both(members.select("f", F.col("v").alias("a")).join(members.select("f", F.col("v").alias("b")), "f").where("a < b").select("a", "b")))
    related = t.select("s", F.col("p").alias("a"), "o")
    say("prp-pdw", related.join(pred("propertyDisjointWith"), "a").join(t.select("s", F.col("p").alias("b"), "o"), ["s", "o", "b"]))
    same = lambda name: _typed(t, name).distinct()
    say("prp-irp", t.join(same("IrreflexiveProperty"), "p").where("s = o").select("s", F.col("p").alias("a"), F.col("p").alias("b")))
    ways = t.join(same("AsymmetricProperty"), "p")
    say("prp-asyp", ways.join(t.select(F.col("o").alias("s"), "p", F.col("s").alias("o")), ["s", "p", "o"]).select("s", F.col("p").alias("a"), F.col("p").alias("b")))
    say("eq-diff", pred("sameAs").join(pred("differentFrom"), ["a", "b"]).withColumn("s", F.least("a", "b")))
    return reduce(DataFrame.unionByName, out).distinct()
