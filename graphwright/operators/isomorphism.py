"""Isomorphism of graphs: blank nodes are told apart by their neighbourhoods, by rounds of joins, until their classes don't split any more.

Each blank node begins with one colour. In a round a node's new colour is a digest of its old one and of a sum over its edges; an edge gives a
hash of its direction, its predicate and the colour, or the term, at its other end. Sums don't depend on the order of edges, and are
added up before the shuffle, so a node of very many edges is no group of its own. Rounds end when no class splits: their number is that
of the longest shortest way between nodes that differ, at most.

Nodes that look alike then share a colour. Where all these are of classes that are told apart by nothing (as in a ring), one
node of a smallest class is marked, and the rounds go on; the marks are tried one after the other, and the least canonical form counts. Equal
forms mean isomorphic graphs. Marks are tried within each component of alike nodes by itself, so that two equal parts aren't multiplied.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.settle import drop_settled, settle

#: Of nodes that look alike, so many marks are tried at most for one canonical form; more of them is an error.
MOST_MARKS = 512


def _blank(c: str) -> Column:
    return F.startswith(c, F.lit("_:"))


def _edges(triples: DataFrame) -> DataFrame:
    """(node, how, other): each blank node's edges, the other end a term or a blank node. ``how`` holds direction, predicate and kind."""
    t = triples.select("s", "p", "o").distinct()
    out = t.where(_blank("s")).select(F.col("s").alias("node"), F.concat(F.lit(">"), "p").alias("how"), F.col("o").alias("other"))
    back = t.where(_blank("o")).select(F.col("o").alias("node"), F.concat(F.lit("<"), "p").alias("how"), F.col("s").alias("other"))
    return out.unionByName(back)


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *parts), 256)


def _sum(x: Column) -> Column:
    """An order-free sum of digests: four parts of 60 bits, each added up without loss."""
    part = lambda i: F.sum(F.conv(F.substring(x, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return F.concat_ws(",", *[part(i) for i in range(4)])


def refined(edges: DataFrame, colours: DataFrame) -> tuple[DataFrame, int, int]:
    """(node, colour) when no class splits any more, the number of nodes, and that of classes."""
    # The part of the sum that never changes: edges to terms.
    fixed = settle(edges.where(~_blank("other")).groupBy("node").agg(_sum(_digest(F.col("how"), F.col("other"))).alias("fixed")))
    between = settle(edges.where(_blank("other")))
    now = settle(colours)
    n, classes = now.agg(F.count(F.lit(1)), F.count_distinct("colour")).first()
    while True:
        met = between.join(now.select(F.col("node").alias("other"), "colour"), "other").groupBy("node").agg(_sum(_digest(F.col("how"), F.col("colour"))).alias("moving"))
        both = now.join(fixed, "node", "left").join(met, "node", "left")
        after = settle(both.select("node", _digest(F.col("colour"), F.coalesce("fixed", F.lit("")), F.coalesce("moving", F.lit(""))).alias("colour")))
        split = after.agg(F.count_distinct("colour")).first()[0]
        drop_settled(now)
        now = after
        if split == classes or split == n:
            return now, n, split
        classes = split


def _named(triples: DataFrame, colours: DataFrame) -> DataFrame:
    """The triples, blank nodes by their colours."""
    c = colours.select("node", F.concat(F.lit("_:c"), "colour").alias("name"))
    found = triples.select("s", "p", "o").distinct()
    for column in ("s", "o"):
        found = found.join(c.toDF(column, f"_{column}"), column, "left").withColumn(column, F.coalesce(f"_{column}", column)).drop(f"_{column}")
    return found.select("s", "p", "o")


def _form(triples: DataFrame, colours: DataFrame) -> str:
    """A digest of the triples under their colours."""
    return _named(triples, colours).agg(F.concat_ws(";", F.count(F.lit(1)).cast("string"), _sum(_digest(F.col("s"), F.col("p"), F.col("o"))))).first()[0]


def _first_colours(edges: DataFrame) -> DataFrame:
    return edges.select("node").distinct().select("node", F.lit("").alias("colour"))


def _alike(edges: DataFrame, colours: DataFrame) -> DataFrame:
    """(node, part): the parts of the graph that nodes of shared colours make up among each other; smallest node as the part's name."""
    shared = colours.join(colours.groupBy("colour").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("colour"), "colour", "left_semi").select("node", "colour")
    within = edges.where(_blank("other")).join(shared.select("node"), "node", "left_semi").join(shared.select(F.col("node").alias("other")), "other", "left_semi").select("node", "other").distinct()
    now = settle(shared.select("node", F.col("node").alias("part")))
    within = settle(within)
    while True:
        least = within.join(now.toDF("other", "part"), "other").groupBy("node").agg(F.min("part").alias("near"))
        after = settle(now.join(least, "node", "left").select("node", F.least("part", F.coalesce("near", "part")).alias("part")))
        changed = after.join(now.toDF("node", "before"), "node").where("part != before").isEmpty()
        now = after
        if changed:
            return now


def canonical_colours(triples: DataFrame) -> DataFrame:
    """(node, colour): a colour of its own for each blank node, the same for graphs that differ in the names of blank nodes alone."""
    edges = settle(_edges(triples))
    colours, n, classes = refined(edges, _first_colours(edges))
    marks = 0
    while classes < n:
        # One class of alike nodes at a time: the smallest, then the least colour.
        size = colours.groupBy("colour").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy("n", "colour").first()
        parts = _alike(edges, colours)
        members = colours.where(F.col("colour") == size["colour"]).join(parts, "node")
        # Within one part, marks of different nodes may lead to different forms; of different parts, any node will do in turn.
        part = members.agg(F.min("part")).first()[0]
        tried = [r["node"] for r in members.where(F.col("part") == part).select("node").orderBy("node").limit(MOST_MARKS + 1).collect()]
        marks += len(tried)
        if marks > MOST_MARKS:
            raise ValueError(f"more than {MOST_MARKS} blank nodes look alike")
        inside = parts.where(F.col("part") == part).select("node")
        own = edges.join(inside, "node", "left_semi")
        best = None
        for node in tried:
            marked = colours.withColumn("colour", F.when(F.col("node") == node, F.concat("colour", F.lit("!"))).otherwise(F.col("colour")))
            found = refined(edges, marked)
            form = _form(own.select(F.col("node").alias("s"), F.col("how").alias("p"), F.col("other").alias("o")), found[0])
            if best is None or form < best[0]:
                best = (form, found)
        colours, n, classes = best[1]
    return colours


def canonical(triples: DataFrame) -> DataFrame:
    """(s, p, o) with blank nodes named by what they are: equal for isomorphic graphs."""
    return _named(triples, canonical_colours(triples))


def isomorphic(a: DataFrame, b: DataFrame) -> bool:
    """Whether two graphs (s, p, o) are the same up to the names of their blank nodes. Repeated rows count once."""
    one, two = (settle(x.select("s", "p", "o").distinct()) for x in (a, b))
    counts = [x.agg(F.count(F.lit(1)), F.count_if(_blank("s") | _blank("o"))).first() for x in (one, two)]
    if tuple(counts[0]) != tuple(counts[1]):
        return False
    # What has no blank node decides most unequal graphs without a round.
    ground = lambda x: x.where(~_blank("s") & ~_blank("o"))
    if not ground(one).exceptAll(ground(two)).isEmpty():
        return False
    if counts[0][1] == 0:
        return True
    coloured = [refined(e, _first_colours(e)) for e in (settle(_edges(x)) for x in (one, two))]
    if coloured[0][1:] != coloured[1][1:] or _form(one, coloured[0][0]) != _form(two, coloured[1][0]):
        return False
    if coloured[0][2] == coloured[0][1]:
        return True
    forms = [_form(x, canonical_colours(x)) for x in (one, two)]
    return forms[0] == forms[1]


def same_up_to_blank_nodes(graphs: list[DataFrame]) -> bool:
    """Whether all of some graphs are isomorphic."""
    return reduce(lambda same, g: same and isomorphic(graphs[0], g), graphs[1:], True)
