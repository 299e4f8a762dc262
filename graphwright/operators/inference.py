"""RDFS and OWL RL entailment as joins on a triple table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import OWL, RDFS, SUBCLASS, TYPE, iri
from ..plans.settle import drop_settled, settle
from ..sources.graph import Graph, TripleTable
from .equality import SAME, components, equal_none, equal_pairs, expanded, keys_of, may_equal, rewritten
from .paths import closure, follow, list_items

RESOURCE, DOMAIN, RANGE, SUBPROPERTY = (iri(RDFS + n) for n in ("Resource", "domain", "range", "subPropertyOf"))


#: A schema's side of a join of so many rows is broadcast: it is counted first. Facts are many, and few predicates and classes have most of them.
SCHEMA_ROWS = 1 << 17
#: What schemas say, as local names of OWL.
SCHEMA_PREDICATES = ("inverseOf", "hasValue", "onProperty", "someValuesFrom", "allValuesFrom")
SCHEMA_CLASSES = ("SymmetricProperty", "TransitiveProperty")


def _schema(frame: DataFrame) -> DataFrame:
    """Rows of the schema, broadcast if they are as few as schemas have."""
    return F.broadcast(frame) if frame.limit(SCHEMA_ROWS + 1).count() <= SCHEMA_ROWS else frame


def _closed(graph: Graph, p: str) -> DataFrame:
    """Transitive closure of a predicate that links schema terms, as (s, o)."""
    start = graph.pred(p).select(F.col("s").alias("f")).distinct()
    return closure(graph, start, ("pred", p)).toDF("s", "o")


def rdfs(graph: Graph, resources: bool = True) -> DataFrame:
    """Triples that RDFS adds: rdfs5 and 11 by closure, then 7, 2, 3, 9 and 4, each once, in this order. Literal
    subjects aren't made."""
    spark = graph.spark
    base = graph.triples().distinct()
    sub_p, sub_c = _closed(graph, SUBPROPERTY), _closed(graph, SUBCLASS)
    schema = sub_p.select("s", F.lit(SUBPROPERTY).alias("p"), "o").unionByName(sub_c.select("s", F.lit(SUBCLASS).alias("p"), "o"))
    small_c = _schema(sub_c)
    moved = base.join(_schema(sub_p).toDF("p", "q"), "p").select("s", F.col("q").alias("p"), "o")
    facts = base.unionByName(moved)
    by_domain = facts.join(_schema(graph.pred(DOMAIN)).toDF("p", "c"), "p").select("s", F.col("c").alias("o"))
    by_range = facts.join(_schema(graph.pred(RANGE)).toDF("p", "c"), "p").select(F.col("o").alias("s"), F.col("c").alias("o"))
    types = reduce(DataFrame.unionByName, [facts.where(F.col("p") == TYPE).select("s", "o"), by_domain, by_range]).where(~F.startswith("s", F.lit('"'))).distinct()
    lifted = types.join(small_c.toDF("o", "c"), "o").select("s", F.col("c").alias("o"))
    typed = types.unionByName(lifted).select("s", F.lit(TYPE).alias("p"), "o")
    out = [schema, moved, typed]
    if resources:
        every = facts.select("s").unionByName(facts.where(~F.startswith("o", F.lit('"'))).select(F.col("o").alias("s")))
        out.append(every.distinct().select("s", F.lit(TYPE).alias("p"), F.lit(RESOURCE).alias("o")))
    return reduce(DataFrame.unionByName, out).distinct().join(base, ["s", "p", "o"], "left_anti")


def _owl_round(g: DataFrame, d: DataFrame) -> list[DataFrame]:
    """One round of OWL RL rules over the triples ``g``; at least one premise of each is in the new ones ``d``. Equality isn't among them."""
    out = []
    told = g.where(F.col("p").isin(*[iri(OWL + n) for n in SCHEMA_PREDICATES]) | ((F.col("p") == TYPE) & F.col("o").isin(*[iri(OWL + n) for n in SCHEMA_CLASSES])))
    small = told.limit(SCHEMA_ROWS + 1).count() <= SCHEMA_ROWS
    few = lambda x: F.broadcast(x) if small else x
    pred = lambda t, n: t.where(F.col("p") == (n if n.startswith("<") else iri(OWL + n))).select("s", "o")
    typed = lambda t, n: t.where((F.col("p") == TYPE) & (F.col("o") == iri(OWL + n))).select(F.col("s").alias("k"))
    for a, b in ((g, d), (d, g)):
        sym = b.join(few(typed(a, "SymmetricProperty")), F.col("p") == F.col("k")).select(F.col("o").alias("s"), "p", F.col("s").alias("o"))
        inv = few(pred(a, "inverseOf").toDF("x", "y"))
        one = b.join(inv, F.col("p") == F.col("x")).select(F.col("o").alias("s"), F.col("y").alias("p"), F.col("s").alias("o"))
        two = b.join(inv, F.col("p") == F.col("y")).select(F.col("o").alias("s"), F.col("x").alias("p"), F.col("s").alias("o"))
        out += [sym, one, two]
        # cls-hv2 and cls-hv1
        hv = few(pred(a, "hasValue").toDF("r", "w").join(pred(g, "onProperty").toDF("r", "q"), "r"))
        out.append(b.join(hv, (F.col("p") == F.col("q")) & (F.col("o") == F.col("w"))).select("s", F.lit(TYPE).alias("p"), F.col("r").alias("o")))
        out.append(b.where(F.col("p") == TYPE).join(hv, F.col("o") == F.col("r")).select("s", F.col("q").alias("p"), F.col("w").alias("o")))
        # cls-svf1 and cls-avf
        fill = lambda n: few(pred(g, n).toDF("r", "c").join(pred(g, "onProperty").toDF("r", "q"), "r"))
        types = a.where(F.col("p") == TYPE).select(F.col("s").alias("n"), F.col("o").alias("t"))
        some = b.join(fill("someValuesFrom"), F.col("p") == F.col("q")).join(types, (F.col("o") == F.col("n")) & (F.col("t") == F.col("c")))
        out.append(some.select("s", F.lit(TYPE).alias("p"), F.col("r").alias("o")))
        each = b.join(fill("allValuesFrom"), F.col("p") == F.col("q")).join(types, (F.col("s") == F.col("n")) & (F.col("t") == F.col("r")))
        out.append(each.select(F.col("o").alias("s"), F.lit(TYPE).alias("p"), F.col("c").alias("o")))
        # prp-trp
        left, right = a.toDF("s", "p", "m"), b.toDF("m", "p", "o")
        out.append(left.join(few(typed(g, "TransitiveProperty")), F.col("p") == F.col("k")).join(right, ["m", "p"]).select("s", "p", "o"))
    # scm-eqc, scm-eqp
    for name, to in (("equivalentClass", SUBCLASS), ("equivalentProperty", SUBPROPERTY)):
        pairs = pred(d, name)
        out += [pairs.select("s", F.lit(to).alias("p"), "o"), pairs.select(F.col("o").alias("s"), F.lit(to).alias("p"), F.col("s").alias("o"))]
    return out


def _owl_lists(graph: Graph) -> tuple[DataFrame, DataFrame | None, list[tuple[str, list[str]]]]:
    """What lists of the schema say: (triples of scm-int, scm-uni and cls-oo; the classes that are intersections as (c, o, size);
    property chains). Lists of a schema are few and are read once."""
    spark, kinds = graph.spark, ("intersectionOf", "unionOf", "oneOf", "propertyChainAxiom")
    told = reduce(DataFrame.unionByName, [graph.pred(iri(OWL + k)).select(F.col("s").alias("c"), F.col("o").alias("f"), F.lit(k).alias("kind")) for k in kinds]).distinct()
    told = settle(told)
    if told.isEmpty():
        return spark.createDataFrame([], "s string, p string, o string"), None, []
    members = settle(told.join(list_items(graph, told.select("f")), "f"))
    of = lambda k: members.where(F.col("kind") == k)
    up = of("intersectionOf").select(F.col("c").alias("s"), F.lit(SUBCLASS).alias("p"), F.col("v").alias("o"))
    down = of("unionOf").select(F.col("v").alias("s"), F.lit(SUBCLASS).alias("p"), F.col("c").alias("o"))
    listed = of("oneOf").select(F.col("v").alias("s"), F.lit(TYPE).alias("p"), F.col("c").alias("o"))
    whole = of("intersectionOf").groupBy("c", "f").agg(F.count_distinct("v").alias("size"))
    parts = settle(of("intersectionOf").select("c", "f", "v").distinct().join(whole, ["c", "f"]).select("c", "f", F.col("v").alias("o"), "size"))
    chains: dict[tuple[str, str], list[tuple[int, str]]] = {}
    for r in of("propertyChainAxiom").collect():
        chains.setdefault((r["c"], r["f"]), []).append((r["n"], r["v"]))
    return up.unionByName(down).unionByName(listed), parts if not parts.isEmpty() else None, [(c, [p for _, p in sorted(ps)]) for (c, _), ps in sorted(chains.items())]


def _of_lists(known: DataFrame, parts: DataFrame | None, chains: list[tuple[str, list[str]]]) -> list[DataFrame]:
    """cls-int1 and prp-spo2 over the triples known."""
    out = []
    if parts is not None:
        has = known.where(F.col("p") == TYPE).select("s", "o").join(parts, "o").groupBy("s", "c", "f", "size").agg(F.count_distinct("o").alias("n"))
        out.append(has.where("n = size").select("s", F.lit(TYPE).alias("p"), F.col("c").alias("o")))
    graph = TripleTable(known.sparkSession, known)
    for c, steps in chains:
        start = graph.pred(steps[0]).select(F.col("s").alias("f"), F.col("o").alias("v"))
        reached = reduce(lambda at, p: follow(graph, at, ("pred", p)), steps[1:], start)
        out.append(reached.select(F.col("f").alias("s"), F.lit(c).alias("p"), F.col("v").alias("o")))
    return out


def owl_rl(graph: Graph) -> DataFrame:
    """Triples that the main OWL 2 RL rules add (equality and keys, inverse, symmetric, transitive and functional properties, chains,
    value restrictions, intersections, unions, enumerations, equivalences, with RDFS subclass, subproperty, domain and
    range), by semi-naive rounds until no triple is new. No rule makes a new term, so the rounds end; their number
    grows with the longest chain.

    Equal nodes stand as one, their representative, in all rounds; the triples of all of them are made at the end, by one
    join. When a round makes nodes equal, what is known is rewritten, and the rounds go on from there.
    ``equality.clashes`` tells of contradictions.
    """
    spark = graph.spark
    base = settle(graph.triples().distinct())
    equal: DataFrame | None = None
    known = base
    while True:
        told, parts, chains = _owl_lists(TripleTable(spark, known))
        keys = keys_of(TripleTable(spark, known))
        known = settle(known.unionByName(told).distinct())
        fresh = known
        while True:
            pairs = settle(equal_pairs(known, keys)) if keys or may_equal(known) else equal_none(spark)
            if not pairs.isEmpty():
                break
            made = reduce(DataFrame.unionByName, [*_owl_round(known, fresh), *_of_lists(known, parts, chains), rdfs(TripleTable(spark, known), False)])
            fresh = settle(made.where(~F.startswith("s", F.lit('"')) & F.startswith("p", F.lit("<"))).distinct().join(known, ["s", "p", "o"], "left_anti"))
            if fresh.isEmpty():
                break
            after = settle(known.unionByName(fresh))
            drop_settled(known)
            known = after
        if pairs.isEmpty():
            break
        before = equal.select(F.col("node").alias("a"), F.col("rep").alias("b")) if equal is not None else pairs.limit(0)
        equal = components(pairs.unionByName(before))
        same = equal.select(F.col("rep").alias("s"), F.lit(SAME).alias("p"), F.col("rep").alias("o"))
        known = settle(rewritten(known, equal).unionByName(same).distinct())
    if equal is None:
        return known.join(base, ["s", "p", "o"], "left_anti")
    # Only triples whose representatives stand for some of the base's can be in it; the others aren't compared with it, however many they become.
    told = settle(rewritten(base, equal))
    keys = ["s", "p", "o"]
    old = expanded(known.join(told, keys, "left_semi"), equal).join(base, keys, "left_anti")
    return old.unionByName(expanded(known.join(told, keys, "left_anti"), equal))


def expand(graph: Graph, mode: str | None) -> Graph:
    """The graph with what the inference mode adds: none, rdfs, owlrl or both."""
    mode = (mode or "none").lower()
    if mode == "none":
        return graph
    if mode not in ("rdfs", "owlrl", "both", "all", "rdfsowlrl"):
        raise ValueError(f"there is no inference mode {mode}")
    out = TripleTable(graph.spark, graph.triples().distinct())
    if mode != "rdfs":
        out = out.plus(owl_rl(out))
    if mode != "owlrl":
        out = out.plus(rdfs(out))
    return out


