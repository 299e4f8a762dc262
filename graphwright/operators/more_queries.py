"""Further queries over the driver's tables: targets, recursion, policies, functions, node expressions, inference; and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import validate
from ..functions.terms import OWL, TYPE, XSD, lexical_of
from ..plans.compile import Run, digest_of_result
from ..plans.hooks import Hook
from ..plans.settle import shared_folder
from ..plans.shapes import ShapesGraph
from ..plans.sparql import Engine
from ..plans.sparql_parser import parse_query
from ..sources.files import read_turtle, write_turtle
from ..sources.graph import EX, TripleTable, from_text, mapped, read_ntriples, write_ntriples
from ..sources.store import write_store
from .isomorphism import canonical_colours
from .queries import HEAD, PREFIXES, _axioms, _key, _text
from .rules import apply_rules

Q: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}
DECLARE = f'ex: sh:declare [ sh:prefix "ex" ; sh:namespace "{EX}" ] . '


def _found(spark, sf_dir, shapes: str, tables: str, extra: str = "", **options) -> DataFrame:
    graph = mapped(spark, sf_dir, tuple(tables.split()))
    if extra:
        graph = TripleTable(spark, graph.triples().unionByName(from_text(spark, HEAD + extra).triples()).distinct())
    return Run(graph, ShapesGraph.from_text(HEAD + shapes), **options).all_results()


def _shape(name: str, tables: str, shapes: str, sql: str, extra: str = "", **options) -> None:
    """A validation query: the keys of the focus nodes, a row a result."""
    Q[name] = (lambda spark, sf_dir: _found(spark, sf_dir, shapes, tables, extra, **options).select(_key("focus").alias("id")), sql)


def _sparql(name: str, tables: str, text: str, columns: dict[str, str], sql: str) -> None:
    def run(spark, sf_dir):
        found = Engine(mapped(spark, sf_dir, tuple(tables.split()))).solve(parse_query(text, PREFIXES))
        make = {"key": _key, "text": _text, "number": lambda c: _text(c).cast("double"), "long": lambda c: _text(c).cast("long"), "decimal": lambda c: _text(c).cast("decimal(38,2)").cast("double"), "term": F.col}
        return found.select(*[make[kind](c).alias(c) for c, kind in columns.items()])

    Q[name] = (run, sql)


# Targets and policies
_NODES = " , ".join(f"<urn:customer:{i}>" for i in range(0, 60))
_shape("t_target_node", "customer", f"ex:S a sh:NodeShape ; sh:targetNode {_NODES} ; sh:property [ sh:path ex:c_acctbal ; sh:minInclusive 0 ] .", "SELECT c_custkey AS id FROM customer WHERE c_custkey < 60 AND c_acctbal < 0")
_shape("t_implicit_class", "supplier", "ex:Supplier a rdfs:Class , sh:NodeShape ; sh:property [ sh:path ex:s_acctbal ; sh:minInclusive 0 ] .", "SELECT s_suppkey AS id FROM supplier WHERE s_acctbal < 0")
_shape("t_subclass", "supplier customer", "ex:S a sh:NodeShape ; sh:targetClass ex:Party ; sh:property [ sh:path [ sh:alternativePath (ex:s_acctbal ex:c_acctbal) ] ; sh:minInclusive 0 ] .", "SELECT s_suppkey AS id FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT c_custkey FROM customer WHERE c_acctbal < 0", "ex:Supplier rdfs:subClassOf ex:Party . ex:Customer rdfs:subClassOf ex:Buyer . ex:Buyer rdfs:subClassOf ex:Party .")
_shape("t_class_of_values", "customer orders", "ex:S a sh:NodeShape ; sh:targetClass ex:Order ; sh:property [ sh:path [ sh:alternativePath (ex:o_custkey ex:o_orderstatus) ] ; sh:class ex:Party ] .", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus IS NOT NULL", "ex:Customer rdfs:subClassOf ex:Party .")
_shape("t_sparql_target", "customer", DECLARE + 'ex:S a sh:NodeShape ; sh:target [ a sh:SPARQLTarget ; sh:prefixes ex: ; sh:select "SELECT ?this WHERE {{ ?this ex:c_mktsegment ?m FILTER(STRSTARTS(?m, \'B\')) }}" ] ; sh:property [ sh:path ex:c_acctbal ; sh:minInclusive 5000 ] .'.replace("{{", "{").replace("}}", "}"), "SELECT c_custkey AS id FROM customer WHERE c_mktsegment LIKE 'B%' AND NOT c_acctbal >= 5000")
_shape("t_sparql_target_type", "customer", DECLARE + 'ex:InSegment a sh:SPARQLTargetType ; rdfs:subClassOf sh:Target ; sh:parameter [ sh:path ex:segment ] ; sh:prefixes ex: ; sh:select "SELECT ?this WHERE { ?this ex:c_mktsegment $segment }" . ex:S a sh:NodeShape ; sh:target [ a ex:InSegment ; ex:segment "MACHINERY" ] ; sh:property [ sh:path ex:c_acctbal ; sh:minInclusive 5000 ] .', "SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'MACHINERY' AND NOT c_acctbal >= 5000")
_shape("t_deactivated", "customer", "ex:S a sh:NodeShape ; sh:targetClass ex:Customer ; sh:property [ sh:path ex:c_acctbal ; sh:minInclusive 0 ] , [ sh:path ex:c_acctbal ; sh:maxInclusive 0 ; sh:deactivated true ] .", "SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0")
_BALANCE = "ex:S a sh:NodeShape ; sh:targetClass ex:Customer ; sh:property [ sh:path ex:c_acctbal ; sh:minInclusive 0 ] . ex:T a sh:NodeShape ; sh:targetClass ex:Customer ; sh:property [ sh:path ex:c_acctbal ; sh:maxInclusive 9000 ] ."
_shape("t_focus_nodes", "customer", _BALANCE, "SELECT c_custkey AS id FROM customer WHERE c_custkey IN (1, 5, 7, 8, 20, 40, 99) AND (c_acctbal < 0 OR c_acctbal > 9000)", focus=[f"<urn:customer:{i}>" for i in (1, 5, 7, 8, 20, 40, 99)])
_shape("t_use_shapes", "customer", _BALANCE, "SELECT c_custkey AS id FROM customer WHERE c_acctbal > 9000", use_shapes=[f"<{EX}T>"])
_shape("t_focus_and_shapes", "customer", _BALANCE, "SELECT c_custkey AS id FROM customer WHERE c_custkey < 40 AND c_acctbal < 0", focus=[f"<urn:customer:{i}>" for i in range(40)], use_shapes=[f"<{EX}S>"])


def _flag(spark, sf_dir):
    shapes = "ex:S a sh:NodeShape ; sh:targetClass ex:Customer ; sh:property [ sh:path ex:c_acctbal ; sh:minInclusive 0 ; sh:severity sh:Warning ] ."
    rows = []
    for name, options in (("strict", {}), ("warnings", {"allow_warnings": True}), ("infos", {"allow_infos": True}), ("abort", {"abort_on_first": True}), ("abort_warnings", {"abort_on_first": True, "allow_warnings": True})):
        found = validate(spark, mapped(spark, sf_dir, ("customer",)), HEAD + shapes, **options)
        rows.append((name, found.conforms, found.results.count()))
    return spark.createDataFrame(rows, "mode string, conforms boolean, n long")


Q["t_severity_policy"] = (_flag, "WITH n AS (SELECT count(*) AS n FROM customer WHERE c_acctbal < 0) SELECT * FROM (SELECT 'strict' AS mode, n = 0 AS conforms, n FROM n UNION ALL SELECT 'warnings', true, n FROM n UNION ALL SELECT 'infos', n = 0, n FROM n UNION ALL SELECT 'abort', n = 0, least(n, 1) FROM n UNION ALL SELECT 'abort_warnings', true, least(n, 1) FROM n)")

# Shapes within shapes
_shape("l_recursion", "conversations", "ex:S a sh:NodeShape ; sh:targetClass ex:Turn ; sh:property [ sh:path ex:role ; sh:minCount 1 ] , [ sh:path ex:next ; sh:node ex:S ] .", "SELECT 0::BIGINT AS id WHERE false")


def _deep(spark, sf_dir):
    shapes = 'ex:S a sh:NodeShape ; sh:targetClass ex:Turn ; sh:property [ sh:path ex:role ; sh:in ("user" "assistant") ] , [ sh:path ex:next ; sh:node ex:S ] .'
    part = lambda i: F.regexp_extract("focus", "turn:([0-9]+):([0-9]+)>", i).cast("long")
    return _found(spark, sf_dir, shapes, "conversations").select(part(1).alias("conv"), part(2).alias("turn"), F.col("component").contains("#Node").alias("deeper"))


Q["l_recursion_deep"] = (_deep, """WITH RECURSIVE t AS (SELECT DISTINCT conv_id, turn FROM conversations), b AS (SELECT DISTINCT conv_id, turn, role FROM conversations WHERE role NOT IN ('user', 'assistant')),
f(conv_id, turn) AS (SELECT conv_id, turn FROM b UNION SELECT f.conv_id, f.turn - 1 FROM f JOIN t ON t.conv_id = f.conv_id AND t.turn = f.turn WHERE f.turn > 0)
SELECT conv_id AS conv, turn, false AS deeper FROM b UNION ALL SELECT t.conv_id, t.turn, true FROM t JOIN t AS n ON n.conv_id = t.conv_id AND n.turn = t.turn + 1 JOIN f ON f.conv_id = n.conv_id AND f.turn = n.turn""")
_shape("l_xone_repeats", "part", "ex:Big sh:property [ sh:path ex:p_size ; sh:minInclusive 25 ] . ex:S a sh:NodeShape ; sh:targetClass ex:Part ; sh:xone ( ex:Big ex:Big [ sh:property [ sh:path ex:p_size ; sh:maxInclusive 10 ] ] ) .", "SELECT p_partkey AS id FROM part WHERE p_size > 10")
_shape("l_nested_not", "customer", "ex:S a sh:NodeShape ; sh:targetClass ex:Customer ; sh:not [ sh:or ( [ sh:property [ sh:path ex:c_acctbal ; sh:minInclusive 0 ] ] [ sh:not [ sh:property [ sh:path ex:c_mktsegment ; sh:hasValue \"BUILDING\" ] ] ] ) ] .", "SELECT c_custkey AS id FROM customer WHERE c_acctbal >= 0 OR c_mktsegment != 'BUILDING'")
_LINES = "ex:S a sh:NodeShape ; sh:targetClass ex:Order ; sh:property [ sh:path ex:l_quantity ; sh:qualifiedValueShape ex:Many ; sh:qualifiedValueShapesDisjoint true ; sh:qualifiedMinCount 1 ] , [ sh:path ex:l_quantity ; sh:qualifiedValueShape ex:Odd ; sh:qualifiedValueShapesDisjoint true ; sh:qualifiedMaxCount 1 ] . ex:Many sh:minInclusive 30 . ex:Odd sh:minInclusive 20 ; sh:maxInclusive 35 ."
_D = "(SELECT DISTINCT o_orderkey AS o, l_quantity AS q FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey)"
_shape("q_disjoint_siblings", "orders lineitem", _LINES, f"SELECT o AS id FROM {_D} GROUP BY o HAVING count(*) FILTER (q >= 30 AND NOT (q >= 20 AND q <= 35)) < 1 UNION ALL SELECT o FROM {_D} GROUP BY o HAVING count(*) FILTER (q >= 20 AND q <= 35 AND NOT q >= 30) > 1")
_shape("q_two_shapes", "orders lineitem", "ex:S a sh:NodeShape ; sh:targetClass ex:Order ; sh:property [ sh:path ex:l_quantity ; sh:qualifiedValueShape [ sh:minInclusive 30 ] , [ sh:maxInclusive 5 ] ; sh:qualifiedMinCount 1 ] .", f"SELECT o AS id FROM {_D} GROUP BY o HAVING count(*) FILTER (q >= 30) < 1 UNION ALL SELECT o FROM {_D} GROUP BY o HAVING count(*) FILTER (q <= 5) < 1")

# SPARQL components, messages and functions
_SELECT = DECLARE + 'ex:Below a sh:ConstraintComponent ; sh:parameter [ sh:path ex:below ] ; sh:nodeValidator [ a sh:SPARQLSelectValidator ; sh:prefixes ex: ; sh:select "SELECT $this WHERE { $this ex:c_acctbal ?b FILTER(?b >= $below) }" ] ; sh:propertyValidator [ a sh:SPARQLSelectValidator ; sh:prefixes ex: ; sh:select "SELECT $this ?value WHERE { $this $PATH ?value FILTER(?value >= $below) }" ] . ex:S a sh:NodeShape ; sh:targetClass ex:Customer ; ex:below 9000 ; sh:property [ sh:path ex:c_acctbal ; ex:below 9500 ] .'
_shape("q_select_validators", "customer", _SELECT, "SELECT c_custkey AS id FROM customer WHERE c_acctbal >= 9000 UNION ALL SELECT c_custkey FROM customer WHERE c_acctbal >= 9500")


def _messages(spark, sf_dir):
    shapes = DECLARE + 'ex:S a sh:NodeShape ; sh:targetClass ex:Customer ; sh:sparql [ sh:prefixes ex: ; sh:message "{$this} owes {?value}" ; sh:select "SELECT $this ?value WHERE { $this ex:c_acctbal ?value FILTER(?value < 0) }" ] .'
    found = _found(spark, sf_dir, shapes, "customer")
    return found.select(_key("focus").alias("id"), F.regexp_extract(F.col("messages")[0], " owes \"(.*)\"", 1).cast("double").alias("owed"))


Q["q_messages"] = (_messages, "SELECT c_custkey AS id, c_acctbal AS owed FROM customer WHERE c_acctbal < 0")
_ASKED = DECLARE + 'ex:large a sh:SPARQLFunction ; sh:parameter [ sh:path ex:size ] ; sh:returnType xsd:boolean ; sh:prefixes ex: ; sh:ask "ASK { FILTER($size > 30) }" . ex:S a sh:NodeShape ; sh:targetClass ex:Part ; sh:expression [ ex:large ( [ sh:path ex:p_size ] ) ] .'
_shape("f_ask_function", "part", _ASKED, "SELECT p_partkey AS id FROM part WHERE NOT p_size > 30")
_CALLED = DECLARE + 'ex:large a sh:SPARQLFunction ; sh:parameter [ sh:path ex:size ] ; sh:returnType xsd:boolean ; sh:prefixes ex: ; sh:ask "ASK { FILTER($size > 30) }" . ex:S a sh:NodeShape ; sh:targetClass ex:Part ; sh:sparql [ sh:prefixes ex: ; sh:select "SELECT $this WHERE { $this ex:p_size ?s FILTER(!ex:large(?s)) }" ] .'
_shape("f_called_in_text", "part", _CALLED, "SELECT p_partkey AS id FROM part WHERE NOT p_size > 30")

_sparql("s_offset", "part", "SELECT ?p ?s WHERE { ?p ex:p_retailprice ?s } ORDER BY DESC(?s) CONCAT('<', STR(?p), '>') LIMIT 25 OFFSET 40", {"p": "key", "s": "number"}, "SELECT p_partkey AS p, p_retailprice AS s FROM part ORDER BY p_retailprice DESC, '<urn:part:' || p_partkey || '>' LIMIT 25 OFFSET 40")
_sparql("s_minus_some", "customer orders", 'SELECT ?c WHERE { ?c a ex:Customer MINUS { ?o ex:o_custkey ?c ; ex:o_orderstatus "P" } }', {"c": "key"}, "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
_sparql("s_minus_unbound", "customer orders", 'SELECT ?c WHERE { ?c a ex:Customer OPTIONAL { ?c ex:c_acctbal ?b FILTER(?b < 0) } MINUS { ?d ex:c_acctbal ?b ; ex:c_mktsegment "BUILDING" } }', {"c": "key"}, "SELECT c_custkey AS c FROM customer WHERE c_acctbal >= 0 OR c_acctbal IS NULL OR c_acctbal NOT IN (SELECT c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal IS NOT NULL)")
_sparql("s_sum_avg", "part", "SELECT ?b (SUM(?s) AS ?total) (AVG(?s) AS ?mean) (COUNT(DISTINCT ?s) AS ?sizes) (MAX(?s) AS ?most) WHERE { ?p ex:p_brand ?b ; ex:p_size ?s } GROUP BY ?b", {"b": "text", "total": "long", "mean": "decimal", "sizes": "long", "most": "long"}, "SELECT p_brand AS b, sum(p_size)::BIGINT AS total, (floor(sum(p_size) * 100.0 / count(*) + 0.5) / 100)::DOUBLE AS mean, count(DISTINCT p_size) AS sizes, max(p_size)::BIGINT AS most FROM part GROUP BY 1")
_sparql("s_group_concat", "nation region", 'SELECT ?g (GROUP_CONCAT(?x; separator="|") AS ?names) WHERE { ?n ex:n_regionkey ?g ; ex:n_name ?x } GROUP BY ?g', {"g": "key", "names": "text"}, "SELECT n_regionkey::BIGINT AS g, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY 1")
_sparql("s_big_integers", "part", "SELECT ?p ?x WHERE { ?p ex:p_size ?s BIND(?s + 9007199254740993 AS ?x) }", {"p": "key", "x": "long"}, "SELECT p_partkey AS p, p_size + 9007199254740993 AS x FROM part")
_sparql("s_term_functions", "customer", 'SELECT ?c ?k ?d ?l WHERE { ?c ex:c_acctbal ?b ; ex:c_nationkey ?n BIND(IF(ISIRI(?n), IF(ISLITERAL(?b), "both", "iri"), "none") AS ?k) BIND(STR(DATATYPE(?b)) AS ?d) BIND(IF(ISBLANK(?n) || ISNUMERIC(?n), "x", IF(ISNUMERIC(?b), "number", "y")) AS ?l) }', {"c": "key", "k": "text", "d": "text", "l": "text"}, "SELECT c_custkey AS c, 'both' AS k, 'http://www.w3.org/2001/XMLSchema#double' AS d, 'number' AS l FROM customer WHERE c_acctbal IS NOT NULL AND c_nationkey IS NOT NULL")
_sparql("s_math_functions", "part", "SELECT ?p ?u ?d ?r ?a WHERE { ?p ex:p_retailprice ?x BIND(CEIL(?x) AS ?u) BIND(FLOOR(?x) AS ?d) BIND(ROUND(?x) AS ?r) BIND(ABS(0 - ?x) AS ?a) }", {"p": "key", "u": "number", "d": "number", "r": "number", "a": "number"}, "SELECT p_partkey AS p, ceil(p_retailprice) AS u, floor(p_retailprice) AS d, floor(p_retailprice + 0.5) AS r, p_retailprice AS a FROM part")
_sparql("s_date_functions", "orders", "SELECT ?o ?y ?m ?d ?h WHERE { ?o ex:o_orderdate ?t BIND(YEAR(?t) AS ?y) BIND(MONTH(?t) AS ?m) BIND(DAY(?t) AS ?d) BIND(HOURS(?t) AS ?h) }", {"o": "key", "y": "long", "m": "long", "d": "long", "h": "long"}, "SELECT o_orderkey AS o, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, hour(o_orderdate) AS h FROM orders")
_sparql("s_hash_functions", "nation", "SELECT ?n ?a ?b ?c WHERE { ?n ex:n_name ?x BIND(MD5(?x) AS ?a) BIND(SHA1(?x) AS ?b) BIND(SHA256(?x) AS ?c) }", {"n": "key", "a": "text", "b": "text", "c": "text"}, "SELECT n_nationkey::BIGINT AS n, md5(n_name) AS a, sha1(n_name) AS b, sha256(n_name) AS c FROM nation")
_sparql("s_more_strings", "nation", 'SELECT ?n ?r ?b ?a ?e WHERE { ?n ex:n_name ?x BIND(REPLACE(?x, "n", "_", "i") AS ?r) BIND(STRBEFORE(?x, "A") AS ?b) BIND(STRAFTER(?x, "A") AS ?a) BIND(ENCODE_FOR_URI(CONCAT(?x, " &")) AS ?e) }', {"n": "key", "r": "text", "b": "text", "a": "text", "e": "text"}, "SELECT n_nationkey::BIGINT AS n, regexp_replace(n_name, 'n', '_', 'gi') AS r, CASE WHEN contains(n_name, 'A') THEN split_part(n_name, 'A', 1) ELSE '' END AS b, CASE WHEN contains(n_name, 'A') THEN substr(n_name, strpos(n_name, 'A') + 1) ELSE '' END AS a, replace(n_name, ' ', '%20') || '%20%26' AS e FROM nation")
_sparql("s_coalesce_in", "customer orders", 'SELECT ?c ?s WHERE { ?c a ex:Customer ; ex:c_mktsegment ?m OPTIONAL { ?o ex:o_custkey ?c ; ex:o_orderstatus "P" } BIND(COALESCE(?o, "none") AS ?x) FILTER(?m IN ("BUILDING", "MACHINERY") && ?m NOT IN ("MACHINERY")) BIND(IF(SAMETERM(?x, "none"), "no", "yes") AS ?s) }', {"c": "key", "s": "text"}, "SELECT c_custkey AS c, CASE WHEN o_orderkey IS NULL THEN 'no' ELSE 'yes' END AS s FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' WHERE c_mktsegment = 'BUILDING'")

# Unbound variables, errors, order under DISTINCT
_sparql("s_optional_twice", "customer", 'SELECT ?c ?k WHERE { ?c a ex:Customer OPTIONAL { ?c ex:c_acctbal ?y FILTER(?y < 0) } OPTIONAL { ?c ex:c_nationkey ?y } BIND(IF(ISIRI(?y), "nation", "debt") AS ?k) }', {"c": "key", "k": "text"}, "SELECT c_custkey AS c, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_nationkey IS NOT NULL THEN 'nation' END AS k FROM customer")
_sparql("s_exists_unbound", "customer supplier", "SELECT ?c WHERE { ?c ex:c_nationkey ?n OPTIONAL { ?c ex:c_acctbal ?b FILTER(?b < 0) } FILTER EXISTS { ?s ex:s_nationkey ?n ; ex:s_acctbal ?b } }", {"c": "key"}, "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND (c_acctbal IS NULL OR c_acctbal >= 0 OR s_acctbal = c_acctbal))")
_sparql("s_distinct_limit", "part", "SELECT DISTINCT ?z WHERE { ?p ex:p_size ?z } ORDER BY DESC(?z) LIMIT 10 OFFSET 2", {"z": "long"}, "SELECT DISTINCT p_size::BIGINT AS z FROM part WHERE p_size IS NOT NULL ORDER BY z DESC LIMIT 10 OFFSET 2")
_sparql("s_if_error", "customer", 'SELECT ?c ?k WHERE { ?c a ex:Customer OPTIONAL { ?c ex:c_acctbal ?b FILTER(?b < 5000) } BIND(IF(?b < 0, "debt", "small") AS ?k) }', {"c": "key", "k": "text"}, "SELECT c_custkey AS c, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'small' END AS k FROM customer")
_sparql("s_concat_language", "documents", 'SELECT ?d ?l ?m WHERE { ?d ex:text ?t BIND(LANG(CONCAT(?t, ?t)) AS ?l) BIND(LANG(CONCAT(?t, " ")) AS ?m) }', {"d": "key", "l": "text", "m": "text"}, "SELECT doc_id AS d, lang AS l, '' AS m FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL")
_sparql("s_negated_path", "nation", "SELECT ?n ?r WHERE { ?n !(ex:n_name|a) ?r }", {"n": "key", "r": "key"}, "SELECT n_nationkey::BIGINT AS n, n_regionkey::BIGINT AS r FROM nation WHERE n_regionkey IS NOT NULL")
_shape("s_shapes_graph", "customer", DECLARE + 'ex:S a sh:NodeShape ; sh:targetClass ex:Customer ; ex:least 0 ; sh:sparql [ sh:prefixes ex: ; sh:select "SELECT $this ?value WHERE { $this ex:c_acctbal ?value GRAPH $shapesGraph { $currentShape ex:least ?m } FILTER(?value < ?m) }" ] .', "SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0")
_shape("l_property_repeats", "orders customer", "ex:S a sh:NodeShape ; sh:targetClass ex:Order ; sh:property [ sh:path ex:o_custkey ; sh:property [ sh:path ex:c_acctbal ; sh:minInclusive 0 ] ] .", "SELECT o_custkey AS id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0")

# Node expressions
_filtered = lambda expression: f'ex:S a sh:NodeShape ; sh:targetClass ex:Customer ; sh:rule [ a sh:TripleRule ; sh:subject sh:this ; sh:predicate ex:made ; sh:object {expression} ] .'


def _made(name: str, tables: str, shapes: str, sql: str, iterate: bool = False) -> None:
    def run(spark, sf_dir):
        added = apply_rules(mapped(spark, sf_dir, tuple(tables.split())), ShapesGraph.from_text(HEAD + shapes), iterate)[1]
        return added.select(_key("s").alias("s"), F.when(F.startswith("o", F.lit("<")), F.regexp_extract("o", r":([0-9]+)>$", 1)).otherwise(_text("o")).try_cast("long").alias("o"))

    Q[name] = (run, sql)


_made("n_union", "customer", _filtered("[ sh:union ( [ sh:path ex:c_nationkey ] [ sh:path ( ex:c_nationkey ) ] 7 ) ]".replace("[ sh:path ( ex:c_nationkey ) ]", "[ sh:path [ sh:alternativePath ( ex:c_nationkey ex:none ) ] ]")), "SELECT c_custkey AS s, c_nationkey::BIGINT AS o FROM customer WHERE c_nationkey IS NOT NULL UNION ALL SELECT c_custkey, 7 FROM customer")
_made("n_intersection", "customer supplier nation", _filtered("[ sh:intersection ( [ sh:path ex:c_nationkey ] [ sh:path ( ex:c_nationkey [ sh:inversePath ex:s_nationkey ] ex:s_nationkey ) ] ) ]"), "SELECT c_custkey AS s, c_nationkey::BIGINT AS o FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)")
_made("n_filter_shape", "customer orders", _filtered('[ sh:filterShape [ sh:property [ sh:path ex:o_orderstatus ; sh:hasValue "P" ] ] ; sh:nodes [ sh:path [ sh:inversePath ex:o_custkey ] ] ]'), "SELECT o_custkey AS s, o_orderkey AS o FROM orders WHERE o_orderstatus = 'P'")
_made("r_deactivated_and_order", "customer", "ex:S a sh:NodeShape ; sh:targetClass ex:Customer ; sh:rule [ a sh:TripleRule ; sh:order 1 ; sh:subject sh:this ; sh:predicate ex:made ; sh:object [ sh:path ex:first ] ] , [ a sh:TripleRule ; sh:order 0 ; sh:subject sh:this ; sh:predicate ex:first ; sh:object [ sh:path ex:c_nationkey ] ] , [ a sh:TripleRule ; sh:deactivated true ; sh:subject sh:this ; sh:predicate ex:made ; sh:object 1 ] .", "SELECT c_custkey AS s, c_nationkey::BIGINT AS o FROM customer WHERE c_nationkey IS NOT NULL UNION ALL SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IS NOT NULL")


# Results beneath others
def _details(spark, sf_dir):
    shapes = "ex:Rich sh:property [ sh:path ex:c_acctbal ; sh:minInclusive 5000 ] . ex:S a sh:NodeShape ; sh:targetClass ex:Order ; sh:property [ sh:path ex:o_custkey ; sh:node ex:Rich ] ."
    run = Run(mapped(spark, sf_dir, ("orders", "customer")), ShapesGraph.from_text(HEAD + shapes))
    above = run.all_results().select(F.col("focus").alias("order"), digest_of_result().alias("parent"))
    return above.join(run.all_nested(), "parent").select(_key("order").alias("outer_id"), _key("focus").alias("inner_id"), _text("value").cast("double").alias("v"))


Q["l_details"] = (_details, "SELECT o_orderkey AS outer_id, c_custkey AS inner_id, c_acctbal AS v FROM orders JOIN customer ON o_custkey = c_custkey WHERE NOT c_acctbal >= 5000")


# Files: what is written as a format and read back
def _round_trip(write, read):
    def run(spark, sf_dir):
        path = f"{shared_folder(spark)}/files/{uuid.uuid4().hex}"
        triples = mapped(spark, sf_dir, ("customer", "nation")).triples()
        write(triples, path)
        back = read(spark, path)
        return back.pred(f"<{EX}c_acctbal>").join(back.pred(f"<{EX}c_name>").toDF("s", "n"), "s").select(_key("s").alias("id"), _text("o").cast("double").alias("b"), _text("n").alias("n"))

    return run


_ROUND = "SELECT c_custkey AS id, c_acctbal AS b, c_name AS n FROM customer WHERE c_acctbal IS NOT NULL AND c_name IS NOT NULL"
Q["src_turtle_files"] = (_round_trip(lambda t, path: write_turtle(t, path, {"ex": EX, "xsd": XSD}), read_turtle), _ROUND)
Q["src_ntriples_files"] = (_round_trip(write_ntriples, read_ntriples), _ROUND)


def _isomorphic(spark, sf_dir):
    """Two graphs whose blank nodes stand for the same customers under other names: nodes of one colour are paired."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    coloured = []
    for stem, number in (("a", F.col("c_custkey")), ("z", F.lit(10**9) - F.col("c_custkey"))):
        node, land = F.concat(F.lit(f"_:{stem}"), number.cast("string")), F.concat(F.lit(f"_:{stem}n"), F.col("c_nationkey").cast("string"))
        pairs = [(node, "name", F.concat(F.lit('"'), F.col("c_name"), F.lit('"'))), (node, "of", land), (land, "has", F.concat(F.lit('"'), F.col("c_mktsegment"), F.lit('"')))]
        graph = reduce(DataFrame.unionByName, [rows.select(s.alias("s"), F.lit(f"<{EX}{p}>").alias("p"), o.alias("o")).where("s IS NOT NULL AND o IS NOT NULL") for s, p, o in pairs])
        coloured.append(canonical_colours(graph).where(F.rlike("node", F.lit("^_:[az][0-9]"))).select("colour", F.regexp_extract("node", "([0-9]+)$", 1).cast("long").alias(stem)))
    return coloured[0].join(coloured[1], "colour").select(F.col("a"), (F.lit(10**9) - F.col("z")).alias("z"))


Q["u_isomorphic"] = (_isomorphic, "SELECT c_custkey AS a, c_custkey AS z FROM customer WHERE c_custkey IS NOT NULL AND c_name IS NOT NULL AND c_nationkey IS NOT NULL")


# Inference
def _owl(extra: str, test, *tables: str):
    def run(spark, sf_dir):
        from .inference import owl_rl

        found = owl_rl(_axioms(spark, sf_dir, f"@prefix owl: <{OWL}> . " + extra, *tables))
        return test(found)

    return run


Q["i_owl_inverse"] = (_owl("ex:n_regionkey owl:inverseOf ex:holds .", lambda t: t.where(F.col("p") == f"<{EX}holds>").select(_key("s").alias("r"), _key("o").alias("n")), "nation", "region"), "SELECT n_regionkey::BIGINT AS r, n_nationkey::BIGINT AS n FROM nation")
Q["i_owl_value"] = (_owl('ex:Home owl:onProperty ex:n_regionkey ; owl:hasValue <urn:region:1> .', lambda t: t.where((F.col("p") == TYPE) & (F.col("o") == f"<{EX}Home>")).select(_key("s").alias("id")), "nation"), "SELECT n_nationkey::BIGINT AS id FROM nation WHERE n_regionkey = 1")
Q["i_owl_some_values"] = (_owl("ex:Placed owl:onProperty ex:n_regionkey ; owl:someValuesFrom ex:Region . ex:Placed rdfs:subClassOf ex:Known .", lambda t: t.where((F.col("p") == TYPE) & (F.col("o") == f"<{EX}Known>")).select(_key("s").alias("id")), "nation", "region"), "SELECT n_nationkey::BIGINT AS id FROM nation JOIN region ON n_regionkey = r_regionkey")


_EQUAL = lambda kind: lambda t: t.where((F.col("p") == f"<{OWL}sameAs>") & F.startswith("s", F.lit(f"<urn:{kind}:")) & (F.col("s") != F.col("o"))).select(_key("s").alias("a"), _key("o").alias("b"))
Q["i_owl_inverse_functional"] = (_owl("ex:s_nationkey a owl:InverseFunctionalProperty .", _EQUAL("supplier"), "supplier"), "SELECT x.s_suppkey AS a, y.s_suppkey AS b FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey != y.s_suppkey")
Q["i_owl_key"] = (_owl("ex:Supplier owl:hasKey ( ex:s_nationkey ex:s_group ) . ex:s_name rdfs:subPropertyOf ex:label . ex:s_nationkey rdfs:subPropertyOf ex:s_group .", _EQUAL("supplier"), "supplier"), "SELECT x.s_suppkey AS a, y.s_suppkey AS b FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey != y.s_suppkey")


def _clashes(spark, sf_dir):
    from .equality import clashes
    from .inference import owl_rl

    graph = _axioms(spark, sf_dir, f"@prefix owl: <{OWL}> . ex:Home owl:onProperty ex:n_regionkey ; owl:hasValue <urn:region:1> ; owl:disjointWith ex:Nation . ex:n_regionkey owl:propertyDisjointWith ex:of . ex:n_regionkey rdfs:subPropertyOf ex:of .", "nation", "region")
    found = clashes(graph.plus(owl_rl(graph)))
    return found.select("rule", _key("node").alias("id"))


Q["i_owl_clashes"] = (_clashes, "SELECT 'cax-dw' AS rule, n_nationkey::BIGINT AS id FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'prp-pdw', n_nationkey FROM nation WHERE n_regionkey IS NOT NULL")


def _rdfs_resources(spark, sf_dir):
    from .inference import rdfs

    found = rdfs(_axioms(spark, sf_dir, "", "nation", "region"))
    return found.where(F.col("o") == "<http://www.w3.org/2000/01/rdf-schema#Resource>").groupBy(F.regexp_extract("s", "^<(urn:[a-z]+):", 1).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


Q["i_rdfs_resources"] = (_rdfs_resources, "SELECT 'urn:nation' AS kind, count(*) AS n FROM nation UNION ALL SELECT 'urn:region', count(*) FROM region UNION ALL SELECT 'urn:ex', 2")



def _stored(text: str, *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query over tables that are written to a store as a graph."""
    return lambda spark, sf_dir: Engine(write_store(mapped(spark, sf_dir, tables), f"{shared_folder(spark)}/stores/{uuid.uuid4().hex}")).solve(parse_query(text, PREFIXES))


_ORDERED = "SELECT ?o ?n ?m ?v WHERE { ?o ex:o_custkey ?c . ?o ex:o_totalprice ?v . ?c ex:c_nationkey ?n . ?c ex:c_mktsegment ?m }"
Q["src_store_patterns"] = (
    lambda spark, sf_dir: _stored(_ORDERED, "customer", "orders")(spark, sf_dir).select(_key("o").alias("o"), _key("n").alias("n"), _text("m").alias("m"), _text("v").cast("double").alias("v")),
    "SELECT o_orderkey::BIGINT AS o, c_nationkey::BIGINT AS n, c_mktsegment AS m, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey",
)
_TEXTS = "SELECT ?d ?s ?t WHERE { ?d a ex:Document . ?d ex:source ?s . ?d ex:text ?t }"
Q["src_store_documents"] = (
    lambda spark, sf_dir: _stored(_TEXTS, "documents")(spark, sf_dir).select(_key("d").alias("id"), F.regexp_extract("s", "^<urn:source:(.*)>$", 1).alias("source"), F.length(_text("t")).cast("long").alias("n")),
    "SELECT doc_id::BIGINT AS id, source, length(text)::BIGINT AS n FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL",
)
# Every supplier of a region is reached through one node, which is kept out of the buckets.
_SUPPLIERS = "SELECT ?r (COUNT(?s) AS ?n) WHERE { ?s ex:s_nationkey ?x . ?x ex:n_regionkey ?r . ?r ex:r_name ?name } GROUP BY ?r"
Q["src_store_hot"] = (
    lambda spark, sf_dir: Engine(write_store(mapped(spark, sf_dir, ("supplier", "nation", "region")), f"{shared_folder(spark)}/stores/{uuid.uuid4().hex}", hot_rows=1)).solve(parse_query(_SUPPLIERS, PREFIXES)).select(_key("r").alias("r"), _text("n").cast("long").alias("n")),
    "SELECT n_regionkey::BIGINT AS r, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_regionkey",
)



def _described(spark, sf_dir):
    """Customers that point to places without IRIs: each has its own copy of the nation's and the region's description."""
    from .clones import clones

    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    blank = lambda kind, c: F.concat(F.lit(f"_:{kind}"), F.col(c).cast("string"))
    triple = lambda frame, s, p, o: frame.select(s.alias("s"), F.lit(f"<{EX}{p}>").alias("p"), o.alias("o"))
    name = lambda c: F.concat(F.lit('"'), F.col(c), F.lit(f'"^^<{XSD}string>'))
    parts = [
        triple(read("customer"), blank("c", "c_custkey"), "in", blank("n", "c_nationkey")),
        triple(read("nation"), blank("n", "n_nationkey"), "name", name("n_name")), triple(read("nation"), blank("n", "n_nationkey"), "in", blank("r", "n_regionkey")),
        triple(read("region"), blank("r", "r_regionkey"), "name", name("r_name")),
    ]
    graph = TripleTable(spark, reduce(DataFrame.unionByName, parts))
    found = clones(graph, read("customer").select(blank("c", "c_custkey").alias("f")))
    return found.where(F.col("p") == f"<{EX}name>").select(F.regexp_extract("root", "[0-9]+$", 0).cast("long").alias("id"), _text("o").alias("name"))


Q["u_clones"] = (_described, "SELECT c_custkey::BIGINT AS id, name FROM customer JOIN (SELECT n_nationkey AS n, n_name AS name FROM nation UNION ALL SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) ON c_nationkey = n")


def _destination(spark, sf_dir):
    from ..api import expand_quads

    found = expand_quads(spark, _axioms(spark, sf_dir, "ex:n_regionkey rdfs:subPropertyOf ex:within .", "nation"), ShapesGraph.from_text(""), "urn:ex:told", inference="rdfs")
    return found.where(F.col("p").isin(f"<{EX}within>", f"<{EX}n_regionkey>") & F.startswith("s", F.lit("<urn:nation:"))).select(_key("s").alias("id"), F.coalesce("g", F.lit("")).alias("g"))


Q["i_destination"] = (_destination, "SELECT n_nationkey::BIGINT AS id, g FROM nation CROSS JOIN (VALUES (''), ('<urn:ex:told>')) t(g) WHERE n_regionkey IS NOT NULL")

# Python functions in shapes
def _enough_words(this, value, seen):
    """A text needs 40 different words or more, unless its document is one of src0."""
    found = len(set(lexical_of(value).split(" ")))
    return found >= 40 or "<urn:source:src0>" in seen[this].get(f"<{EX}source>", ()) or f"{found} different words"


_shape(
    "h_constraint", "documents", 'ex:S a sh:NodeShape ; sh:targetClass ex:Document ; sh:property [ sh:path ex:text ; sh:js [ a sh:JSConstraint ; sh:jsFunctionName "enoughWords" ] ] .',
    "SELECT doc_id::BIGINT AS id FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS DISTINCT FROM 'src0' AND len(list_distinct(string_split(text, ' '))) < 40",
    hooks={"enoughWords": Hook(_enough_words, (f"<{EX}source>",))},
)
_STEP = 'ex:StepComponent a sh:ConstraintComponent ; sh:parameter [ sh:path ex:step ] ; sh:validator [ a sh:JSValidator ; sh:jsFunctionName "inSteps" ; sh:message "{$value} is no multiple of {$step}" ] . '
_shape(
    "h_component", "customer", _STEP + "ex:S a sh:NodeShape ; sh:targetClass ex:Customer ; sh:property [ sh:path ex:c_acctbal ; ex:step 7 ] .", "SELECT c_custkey::BIGINT AS id FROM customer WHERE abs(round(c_acctbal * 100)::BIGINT) % 7 != 0",
    hooks={"inSteps": Hook(lambda this, value, seen, step: round(float(lexical_of(value)) * 100) % int(lexical_of(step)) == 0)},
)
_MOST = 'ex:MostComponent a sh:ConstraintComponent ; sh:parameter [ sh:path ex:most ] ; sh:propertyValidator [ a sh:JSValidator ; sh:jsFunctionName "sumAtMost" ] . '


def _sum_at_most(this, value, seen, most, path):
    """The sum of a focus node's values of the path."""
    found = round(100 * sum(float(lexical_of(x)) for x in seen[this].get(path, ())))
    return found <= 100 * int(lexical_of(most)) or {"value": found, "message": "the sum is too large"}


_shape(
    "h_path_validator", "lineitem", _MOST + "ex:S a sh:NodeShape ; sh:targetSubjectsOf ex:l_discount ; sh:property [ sh:path ex:l_quantity ; ex:most 60 ] .",
    "SELECT l_orderkey::BIGINT AS id FROM (SELECT DISTINCT l_orderkey, l_quantity FROM lineitem) GROUP BY l_orderkey HAVING sum(l_quantity) > 60",
    hooks={"sumAtMost": Hook(_sum_at_most, (f"<{EX}l_quantity>",))},
)
_shape(
    "h_target", "supplier", 'ex:S a sh:NodeShape ; sh:target [ a ex:Shaped ; ex:ends "7" ] ; sh:property [ sh:path ex:s_acctbal ; sh:minInclusive 5000 ] . ex:Shaped a sh:JSTargetType ; rdfs:subClassOf sh:Target ; sh:parameter [ sh:path ex:ends ] ; sh:jsFunctionName "namesEnding" .',
    "SELECT s_suppkey AS id FROM supplier WHERE s_name LIKE '%7' AND s_acctbal < 5000",
    hooks={"namesEnding": Hook(lambda this, seen, ends: any(lexical_of(x).endswith(lexical_of(ends)) for x in seen[this][f"<{EX}s_name>"]), (f"<{EX}s_name>",))},
)
_BACKWARDS = DECLARE + 'ex:backwards a sh:JSFunction ; sh:parameter [ sh:path ex:text ] ; sh:jsFunctionName "backwards" . ex:S a sh:NodeShape ; sh:targetClass ex:Part ; sh:sparql [ sh:prefixes ex: ; sh:message "{?back}" ; sh:select "SELECT $this ?back WHERE { $this ex:p_brand ?b BIND(ex:backwards(?b) AS ?back) FILTER(?back < \'3\') }" ] .'
_REVERSE = {"backwards": Hook(lambda text: lexical_of(text)[::-1])}
Q["h_function"] = (
    lambda spark, sf_dir: _found(spark, sf_dir, _BACKWARDS, "part", hooks=_REVERSE).select(_key("focus").alias("id"), F.regexp_extract(F.col("messages")[0], '^"?([^"]*)', 1).alias("brand")),
    "SELECT p_partkey::BIGINT AS id, reverse(p_brand) AS brand FROM part WHERE reverse(p_brand) < '3'",
)
_shape(
    "h_expression", "part", 'ex:backwards a sh:JSFunction ; sh:parameter [ sh:path ex:text ] ; sh:jsFunctionName "odd" . ex:S a sh:NodeShape ; sh:targetClass ex:Part ; sh:expression [ ex:backwards ( [ sh:path ex:p_size ] ) ] .',
    "SELECT p_partkey::BIGINT AS id FROM part WHERE p_size IS NULL OR p_size % 2 = 0", hooks={"odd": Hook(lambda size: int(lexical_of(size)) % 2 == 1)},
)


def _classed(this, seen):
    """An order's class by its price."""
    price = [float(lexical_of(x)) for x in seen[this].get(f"<{EX}o_totalprice>", ())]
    yield from [(this, f"<{EX}inClass>", "large" if x >= 250000 else "small") for x in price]


def _by_rule(spark, sf_dir):
    shapes = 'ex:S a sh:NodeShape ; sh:targetClass ex:Order ; sh:rule [ a sh:JSRule ; sh:jsFunctionName "classed" ] .'
    _, added = apply_rules(mapped(spark, sf_dir, ("orders",)), ShapesGraph.from_text(HEAD + shapes), hooks={"classed": Hook(_classed, (f"<{EX}o_totalprice>",))})
    return added.select(_key("s").alias("id"), _text("o").alias("class"))


Q["h_rule"] = (_by_rule, "SELECT o_orderkey::BIGINT AS id, CASE WHEN o_totalprice >= 250000 THEN 'large' ELSE 'small' END AS class FROM orders WHERE o_totalprice IS NOT NULL")


# A query test case over a whole table: of the rows that are expected, one in 50 has another segment, and the first two are in each other's place.
_RICHEST = "SELECT ?c ?m WHERE { ?c ex:c_acctbal ?b . ?c ex:c_mktsegment ?m } ORDER BY DESC(?b)"


def _query_test(spark, sf_dir):
    from .query_tests import check_query, numbered

    rows = numbered(spark.read.parquet(f"{sf_dir}/customer.parquet").orderBy(F.desc("c_acctbal"), "c_custkey"))
    segment = F.when(F.col("c_custkey") % 50 == 0, "none").otherwise(F.col("c_mktsegment"))
    place = F.when(F.col("_at") < 2, 1 - F.col("_at")).otherwise(F.col("_at"))
    expected = rows.select(F.concat(F.lit("<urn:customer:"), F.col("c_custkey").cast("string"), F.lit(">")).alias("c"), F.concat(F.lit('"'), segment, F.lit(f'"^^<{XSD}string>')).alias("m"), place.alias("_at"))
    wrong = check_query(Engine(mapped(spark, sf_dir, ("customer",))), _RICHEST, PREFIXES, expected).wrong
    return wrong.select(_key("c").alias("id"), _text("m").alias("segment"), F.col("surplus"))


Q["q_test_case"] = (
    _query_test,
    """WITH placed AS (SELECT *, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS place FROM customer WHERE c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL),
    expected AS (SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN 'none' ELSE c_mktsegment END AS segment, CASE WHEN place < 2 THEN 1 - place ELSE place END AS place FROM placed),
    keyed AS (SELECT e.c_custkey, e.segment, p.c_acctbal, -1 AS n FROM expected e JOIN placed p USING (place) UNION ALL SELECT c_custkey, c_mktsegment, c_acctbal, 1 FROM placed)
    SELECT c_custkey::BIGINT AS id, segment, sum(n)::BIGINT AS surplus FROM keyed GROUP BY c_custkey, segment, c_acctbal HAVING sum(n) != 0""",
)

QUERIES = {name: run for name, (run, _) in Q.items()}
SQL = {name: sql for name, (_, sql) in Q.items()}
