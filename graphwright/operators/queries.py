"""Queries over the driver's tables, one for each operator family, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import XSD
from ..plans.compile import Run
from ..plans.shapes import ShapesGraph
from ..sources.graph import EX, TripleTable, mapped

HEAD = f"@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix ex: <{EX}> . @prefix xsd: <{XSD}> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n"
PREFIXES = {"ex": EX, "xsd": XSD}


def key(column: str) -> str:
    """SQL expression: the number at the end of an IRI."""
    return f"CAST(regexp_extract({column}, ':([0-9]+)>$', 1) AS BIGINT)"


def _key(column: str):
    return F.regexp_extract(column, r":([0-9]+)>$", 1).cast("long")


def _text(column: str):
    from ..functions.terms import c_text

    return c_text(F.col(column))


def check(spark: SparkSession, sf_dir: str, shapes: str, *tables: str) -> DataFrame:
    return Run(mapped(spark, sf_dir, tables), ShapesGraph.from_text(HEAD + shapes)).all_results()


Q: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def _shape(name: str, tables: str, shapes: str, sql: str, value: str | None = None) -> None:
    """A validation query: the focus node's key, and the value as a number, a text or a key."""

    def run(spark, sf_dir):
        found = check(spark, sf_dir, shapes, *tables.split())
        own = [_key("focus").alias("id")]
        if value == "number":
            own.append(_text("value").cast("double").alias("v"))
        elif value == "text":
            own.append(_text("value").alias("v"))
        elif value == "key":
            own.append(_key("value").alias("v"))
        return found.select(*own)

    Q[name] = (run, sql)


def _on(target: str, path: str, constraint: str) -> str:
    return f"ex:S a sh:NodeShape ; sh:targetClass ex:{target} ; sh:property [ sh:path {path} ; {constraint} ] ."


_shape("v_min_inclusive", "customer", _on("Customer", "ex:c_acctbal", "sh:minInclusive 0"), "SELECT c_custkey AS id, c_acctbal AS v FROM customer WHERE NOT c_acctbal >= 0", "number")
_shape("v_min_exclusive", "part", _on("Part", "ex:p_size", "sh:minExclusive 25"), "SELECT p_partkey AS id, p_size::DOUBLE AS v FROM part WHERE NOT p_size > 25", "number")
_shape("v_max_inclusive", "part", _on("Part", "ex:p_size", "sh:maxInclusive 25"), "SELECT p_partkey AS id, p_size::DOUBLE AS v FROM part WHERE NOT p_size <= 25", "number")
_shape("v_max_exclusive", "orders lineitem", _on("Order", "ex:l_discount", "sh:maxExclusive 0.05"), "SELECT DISTINCT l_orderkey AS id, l_discount AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE NOT l_discount < 0.05", "number")
_shape("v_in", "orders", _on("Order", "ex:o_orderpriority", 'sh:in ("1-URGENT" "2-HIGH" "3-MEDIUM")'), "SELECT o_orderkey AS id, o_orderpriority AS v FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')", "text")
_shape("v_pattern", "customer", _on("Customer", "ex:c_name", 'sh:pattern "[02468]$"'), "SELECT c_custkey AS id, c_name AS v FROM customer WHERE NOT regexp_matches(c_name, '[02468]$')", "text")
_shape("v_min_length", "documents", _on("Document", "ex:text", "sh:minLength 20"), "SELECT doc_id AS id FROM documents WHERE length(text) < 20")
_shape("v_max_length", "documents", _on("Document", "ex:text", "sh:maxLength 5000"), "SELECT doc_id AS id FROM documents WHERE length(text) > 5000")
_shape("v_language_in", "documents", _on("Document", "ex:text", 'sh:languageIn ("en" "fr")'), "SELECT doc_id AS id FROM documents WHERE lang NOT IN ('en', 'fr')")
_shape("v_datatype", "part events", "ex:S a sh:NodeShape ; sh:targetClass ex:Part, ex:Event ; sh:property [ sh:path ex:props ; sh:datatype xsd:integer ] , [ sh:path ex:p_size ; sh:datatype xsd:integer ] .", "SELECT event_id AS id FROM events WHERE props IS NOT NULL")
_shape("v_node_kind", "customer", _on("Customer", "ex:c_mktsegment", "sh:nodeKind sh:IRI"), "SELECT c_custkey AS id, c_mktsegment AS v FROM customer WHERE c_mktsegment IS NOT NULL", "text")
_shape("v_min_count", "orders lineitem", _on("Order", "ex:l_partkey", "sh:minCount 1"), "SELECT o_orderkey AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
_shape("v_max_count", "customer orders", _on("Customer", "[ sh:inversePath ex:o_custkey ]", "sh:maxCount 15"), "SELECT c_custkey AS id FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING count(DISTINCT o_orderkey) > 15")
_shape("v_has_value", "customer orders", _on("Customer", "([ sh:inversePath ex:o_custkey ] ex:o_orderstatus)", 'sh:hasValue "F"'), "SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
_shape("v_class", "customer orders", 'ex:S a sh:NodeShape ; sh:targetClass ex:Order ; sh:property [ sh:path ex:o_custkey ; sh:class ex:Supplier ] .', "SELECT o_orderkey AS id, o_custkey AS v FROM orders", "key")
_shape("v_equals", "orders lineitem", _on("Order", "ex:l_partkey", "sh:equals ex:l_suppkey"), "SELECT l_orderkey AS id, l_partkey AS v FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey) UNION ALL SELECT l_orderkey, l_suppkey FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)", "key")
_shape("v_disjoint", "nation customer supplier", "ex:S a sh:NodeShape ; sh:targetObjectsOf ex:c_nationkey ; sh:property [ sh:path ([ sh:inversePath ex:c_nationkey ] ex:c_nationkey) ; sh:disjoint ex:none ] , [ sh:path [ sh:alternativePath (ex:n_name ex:n_regionkey) ] ; sh:disjoint ex:n_name ] .", "SELECT DISTINCT n_nationkey::BIGINT AS id, n_name AS v FROM nation JOIN customer ON c_nationkey = n_nationkey", "text")
_shape("v_less_than", "orders lineitem", _on("Order", "ex:o_orderdate", "sh:lessThan ex:l_shipdate"), "SELECT o_orderkey AS id FROM orders JOIN (SELECT DISTINCT l_orderkey, date_trunc('second', l_shipdate) AS d FROM lineitem) ON l_orderkey = o_orderkey WHERE NOT date_trunc('second', o_orderdate) < d")
_shape("v_less_than_or_equals", "orders lineitem", _on("Order", "ex:o_orderdate", "sh:lessThanOrEquals ex:l_shipdate"), "SELECT o_orderkey AS id FROM orders JOIN (SELECT DISTINCT l_orderkey, date_trunc('second', l_shipdate) AS d FROM lineitem) ON l_orderkey = o_orderkey WHERE NOT date_trunc('second', o_orderdate) <= d")
_RICH = "ex:Rich a sh:PropertyShape ; sh:path ex:c_acctbal ; sh:minInclusive 5000 . ex:Built a sh:PropertyShape ; sh:path ex:c_mktsegment ; sh:hasValue \"BUILDING\" . "
_shape("v_and", "customer", _RICH + "ex:S a sh:NodeShape ; sh:targetClass ex:Customer ; sh:and (ex:Rich ex:Built) .", "SELECT c_custkey AS id FROM customer WHERE NOT (c_acctbal >= 5000 AND c_mktsegment = 'BUILDING')")
_shape("v_or", "customer", _RICH + "ex:S a sh:NodeShape ; sh:targetClass ex:Customer ; sh:or (ex:Rich ex:Built) .", "SELECT c_custkey AS id FROM customer WHERE NOT (c_acctbal >= 5000 OR c_mktsegment = 'BUILDING')")
_shape("v_not", "customer", _RICH + "ex:S a sh:NodeShape ; sh:targetClass ex:Customer ; sh:not ex:Rich .", "SELECT c_custkey AS id FROM customer WHERE c_acctbal >= 5000")
_shape("v_xone", "customer", _RICH + "ex:S a sh:NodeShape ; sh:targetClass ex:Customer ; sh:xone (ex:Rich ex:Built) .", "SELECT c_custkey AS id FROM customer WHERE (c_acctbal >= 5000) = (c_mktsegment = 'BUILDING')")
_shape("v_node", "customer orders", _RICH + "ex:C a sh:NodeShape ; sh:property ex:Rich . ex:S a sh:NodeShape ; sh:targetClass ex:Order ; sh:property [ sh:path ex:o_custkey ; sh:node ex:C ] .", "SELECT o_orderkey AS id, o_custkey AS v FROM orders JOIN customer ON o_custkey = c_custkey WHERE NOT c_acctbal >= 5000", "key")
_shape("v_property", "customer orders", _RICH + "ex:S a sh:NodeShape ; sh:targetClass ex:Order ; sh:property [ sh:path ex:o_custkey ; sh:property ex:Rich ] .", "SELECT DISTINCT c_custkey AS id, c_acctbal AS v FROM orders JOIN customer ON o_custkey = c_custkey WHERE NOT c_acctbal >= 5000", "number")
_bag = Q["v_property"]
Q["v_property"] = (lambda spark, sf_dir: _bag[0](spark, sf_dir).distinct(), _bag[1])  # the bag itself: l_property_repeats
_QUAL = "sh:qualifiedValueShape [ sh:minInclusive 25 ] ; "
_shape("v_qualified_min", "orders lineitem", _on("Order", "ex:l_quantity", _QUAL + "sh:qualifiedMinCount 2"), "SELECT o_orderkey AS id FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(DISTINCT CASE WHEN l_quantity >= 25 THEN l_quantity END) < 2")
_shape("v_qualified_max", "orders lineitem", _on("Order", "ex:l_quantity", _QUAL + "sh:qualifiedMaxCount 2"), "SELECT o_orderkey AS id FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(DISTINCT CASE WHEN l_quantity >= 25 THEN l_quantity END) > 2")
_shape("v_closed", "supplier", "ex:S a sh:NodeShape ; sh:targetClass ex:Supplier ; sh:closed true ; sh:ignoredProperties (<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>) ; sh:property [ sh:path ex:s_name ] , [ sh:path ex:s_nationkey ] .", "SELECT s_suppkey AS id, s_acctbal AS v FROM supplier WHERE s_acctbal IS NOT NULL", "number")
_shape("v_target_subjects_of", "nation", 'ex:S a sh:NodeShape ; sh:targetSubjectsOf ex:n_regionkey ; sh:nodeKind sh:Literal .', "SELECT DISTINCT n_nationkey::BIGINT AS id FROM nation")
_shape("v_target_objects_of", "nation", 'ex:S a sh:NodeShape ; sh:targetObjectsOf ex:n_regionkey ; sh:nodeKind sh:Literal .', "SELECT DISTINCT n_regionkey::BIGINT AS id FROM nation")


def _unique_lang(spark, sf_dir):
    found = check(spark, sf_dir, "ex:S a sh:NodeShape ; sh:targetSubjectsOf ex:of ; sh:property [ sh:path ex:of ; sh:uniqueLang true ] .", "documents")
    return found.groupBy(F.regexp_extract("focus", "([^:]*)>$", 1).alias("source")).agg(F.count(F.lit(1)).alias("n"))


Q["v_unique_lang"] = (_unique_lang, "SELECT source, count(*) AS n FROM (SELECT source, lang FROM documents GROUP BY 1, 2 HAVING count(DISTINCT text) > 1) GROUP BY 1")


def _sparql(name: str, tables: str, text: str, columns: dict[str, str], sql: str) -> None:
    def run(spark, sf_dir):
        from ..plans.sparql import Engine
        from ..plans.sparql_parser import parse_query

        found = Engine(mapped(spark, sf_dir, tuple(tables.split()))).solve(parse_query(text, PREFIXES))
        make = {"key": _key, "text": _text, "number": lambda c: _text(c).cast("double"), "long": lambda c: _text(c).cast("long")}
        return found.select(*[make[kind](c).alias(c) for c, kind in columns.items()])

    Q[name] = (run, sql)


_sparql("s_bgp", "customer nation region", "SELECT ?c ?r WHERE { ?c ex:c_nationkey ?n . ?n ex:n_regionkey ?g . ?g ex:r_name ?r }", {"c": "key", "r": "text"}, "SELECT c_custkey AS c, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
_sparql("s_filter", "part", 'SELECT ?p ?s WHERE { ?p ex:p_size ?s ; ex:p_type ?t FILTER(?s > 40 && CONTAINS(?t, "A")) }', {"p": "key", "s": "number"}, "SELECT p_partkey AS p, p_size::DOUBLE AS s FROM part WHERE p_size > 40 AND contains(p_type, 'A')")
_sparql("s_optional", "customer orders", 'SELECT ?c ?o WHERE { ?c a ex:Customer OPTIONAL { ?o ex:o_custkey ?c ; ex:o_orderstatus "P" } }', {"c": "key", "o": "key"}, "SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'")
_sparql("s_union", "customer supplier", "SELECT ?x ?b WHERE { { ?x ex:c_acctbal ?b } UNION { ?x ex:s_acctbal ?b } FILTER(?b < 0) }", {"x": "key", "b": "number"}, "SELECT c_custkey AS x, c_acctbal AS b FROM customer WHERE c_acctbal < 0 UNION ALL SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal < 0")
_sparql("s_not_exists", "orders lineitem", "SELECT ?o WHERE { ?o a ex:Order FILTER NOT EXISTS { ?o ex:l_partkey ?p } }", {"o": "key"}, "SELECT o_orderkey AS o FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
_sparql("s_minus", "customer orders", "SELECT ?c WHERE { ?c a ex:Customer MINUS { ?o ex:o_custkey ?c } }", {"c": "key"}, "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_sparql("s_group_having", "customer orders", "SELECT ?c (COUNT(?o) AS ?n) (MIN(?d) AS ?least) WHERE { ?o ex:o_custkey ?c ; ex:o_totalprice ?d } GROUP BY ?c HAVING (COUNT(?o) > 12)", {"c": "key", "n": "long", "least": "number"}, "SELECT o_custkey AS c, count(*) AS n, min(o_totalprice) AS least FROM orders GROUP BY 1 HAVING count(*) > 12")
_sparql("s_order", "part", "SELECT ?p ?s WHERE { ?p ex:p_retailprice ?s } ORDER BY DESC(?s) CONCAT('<', STR(?p), '>') LIMIT 25", {"p": "key", "s": "number"}, "SELECT p_partkey AS p, p_retailprice AS s FROM part ORDER BY p_retailprice DESC, '<urn:part:' || p_partkey || '>' LIMIT 25")
_sparql("s_bind", "part", "SELECT ?p ?d WHERE { ?p ex:p_size ?s BIND(?s * 2 + 1 AS ?d) }", {"p": "key", "d": "long"}, "SELECT p_partkey AS p, (p_size * 2 + 1)::BIGINT AS d FROM part")
_sparql("s_values", "customer", 'SELECT ?c ?m WHERE { VALUES ?m { "BUILDING" "MACHINERY" } ?c ex:c_mktsegment ?m }', {"c": "key", "m": "text"}, "SELECT c_custkey AS c, c_mktsegment AS m FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
_sparql("s_subselect", "customer orders", "SELECT ?c ?n ?b WHERE { ?c ex:c_acctbal ?b { SELECT ?c (COUNT(*) AS ?n) WHERE { ?o ex:o_custkey ?c } GROUP BY ?c } FILTER(?n > 10) }", {"c": "key", "n": "long", "b": "number"}, "SELECT o_custkey AS c, count(*) AS n, any_value(c_acctbal) AS b FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) > 10")
_sparql("s_string_functions", "nation", 'SELECT ?n ?u ?k WHERE { ?n ex:n_name ?x BIND(CONCAT(LCASE(?x), "-", STR(STRLEN(?x))) AS ?u) BIND(IF(STRSTARTS(?x, "N"), SUBSTR(?x, 2, 3), UCASE(?x)) AS ?k) }', {"n": "key", "u": "text", "k": "text"}, "SELECT n_nationkey::BIGINT AS n, lower(n_name) || '-' || length(n_name) AS u, CASE WHEN starts_with(n_name, 'N') THEN substr(n_name, 2, 3) ELSE upper(n_name) END AS k FROM nation")
_sparql("p_sequence", "customer orders nation region", "SELECT ?o ?r WHERE { ?o ex:o_custkey/ex:c_nationkey/ex:n_regionkey ?r }", {"o": "key", "r": "key"}, "SELECT o_orderkey AS o, n_regionkey::BIGINT AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
_sparql("p_inverse", "nation region customer", "SELECT ?r ?c WHERE { ?r a ex:Region ; ^ex:n_regionkey/^ex:c_nationkey ?c }", {"r": "key", "c": "key"}, "SELECT n_regionkey::BIGINT AS r, c_custkey AS c FROM nation JOIN customer ON c_nationkey = n_nationkey")
_sparql("p_alternative", "customer supplier", "SELECT ?x ?n WHERE { ?x ex:c_nationkey|ex:s_nationkey ?n }", {"x": "key", "n": "key"}, "SELECT c_custkey AS x, c_nationkey::BIGINT AS n FROM customer UNION ALL SELECT s_suppkey, s_nationkey FROM supplier")


def _turns(path: str):
    def run(spark, sf_dir):
        from ..plans.sparql import Engine
        from ..plans.sparql_parser import parse_query

        found = Engine(mapped(spark, sf_dir, ("conversations",))).solve(parse_query(f"SELECT DISTINCT ?a ?b WHERE {{ ?a a ex:Turn . ?a {path} ?b }}", PREFIXES))
        part = lambda c, i: F.regexp_extract(c, r":(\d+):(-?\d+)>$", i).cast("long")
        return found.select(part("a", 1).alias("conv"), part("a", 2).alias("a"), part("b", 2).alias("b"))

    return run


_E = "WITH RECURSIVE t AS (SELECT DISTINCT conv_id AS c, turn AS n FROM conversations), e AS (SELECT DISTINCT conv_id AS c, turn - 1 AS a, turn AS b FROM conversations WHERE turn > 0), r(c, a, b) AS (SELECT c, n, n FROM t UNION SELECT r.c, r.a, e.b FROM r JOIN e ON r.c = e.c AND r.b = e.a) "
Q["p_zero_or_more"] = (_turns("ex:next*"), _E + "SELECT c AS conv, a, b FROM r")
Q["p_one_or_more"] = (_turns("ex:next+"), _E + "SELECT c AS conv, a, b FROM r WHERE a != b")
Q["p_zero_or_one"] = (_turns("ex:next?"), _E + "SELECT c AS conv, n AS a, n AS b FROM t UNION ALL SELECT e.c, e.a, e.b FROM e JOIN t ON e.c = t.c AND e.a = t.n")

_RULES = {
    "r_triple_rule": ("customer orders nation region", 'ex:S a sh:NodeShape ; sh:targetClass ex:Order ; sh:rule [ a sh:TripleRule ; sh:subject sh:this ; sh:predicate ex:region ; sh:object [ sh:path (ex:o_custkey ex:c_nationkey ex:n_regionkey) ] ] .', "SELECT o_orderkey AS s, n_regionkey::BIGINT AS o FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"),
    "r_sparql_rule": ("customer", f'ex: sh:declare [ sh:prefix "ex" ; sh:namespace "{EX}" ] . ex:S a sh:NodeShape ; sh:targetClass ex:Customer ; sh:rule [ a sh:SPARQLRule ; sh:prefixes ex: ; sh:condition [ sh:property [ sh:path ex:c_mktsegment ; sh:hasValue "BUILDING" ] ] ; sh:construct "CONSTRUCT {{ $this ex:lives ?n }} WHERE {{ $this ex:c_nationkey ?n ; ex:c_acctbal ?b FILTER(?b < 0) }}" ] .', "SELECT c_custkey AS s, c_nationkey::BIGINT AS o FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 0"),
}


def _rule(name: str):
    tables, shapes, _ = _RULES[name]

    def run(spark, sf_dir):
        from .rules import apply_rules

        return apply_rules(mapped(spark, sf_dir, tuple(tables.split())), ShapesGraph.from_text(HEAD + shapes))[1].select(_key("s").alias("s"), _key("o").alias("o"))

    return run


for _n, (_t, _s, _q) in _RULES.items():
    Q[_n] = (_rule(_n), _q)


def _axioms(spark, sf_dir, extra: str, *tables: str) -> TripleTable:
    from ..sources.graph import from_text

    data = mapped(spark, sf_dir, tables).triples()
    return TripleTable(spark, data.unionByName(from_text(spark, HEAD + extra).triples()).distinct())


def _rdfs(extra: str, wanted: str, *tables: str):
    def run(spark, sf_dir):
        from ..functions.terms import TYPE
        from .inference import rdfs

        found = rdfs(_axioms(spark, sf_dir, extra, *tables), resources=False)
        return found.where((F.col("p") == TYPE) & (F.col("o") == f"<{EX}{wanted}>")).select(_key("s").alias("id"))

    return run


Q["i_rdfs_subclass"] = (_rdfs("ex:Supplier rdfs:subClassOf ex:Party . ex:Customer rdfs:subClassOf ex:Buyer . ex:Buyer rdfs:subClassOf ex:Party .", "Party", "supplier", "nation"), "SELECT s_suppkey AS id FROM supplier")
Q["i_rdfs_domain"] = (_rdfs("ex:n_regionkey rdfs:domain ex:Land ; rdfs:range ex:Area . ex:Land rdfs:subClassOf ex:Place .", "Place", "nation"), "SELECT n_nationkey::BIGINT AS id FROM nation")


def _expression(spark, sf_dir):
    shapes = f'ex: sh:declare [ sh:prefix "ex" ; sh:namespace "{EX}" ] . ex:dear a sh:SPARQLFunction ; sh:parameter [ sh:path ex:price ; sh:order 0 ] , [ sh:path ex:size ; sh:order 1 ] ; sh:returnType xsd:boolean ; sh:prefixes ex: ; sh:select "SELECT (?price > ?size * 40 AS ?r) WHERE {{}}" . ex:S a sh:NodeShape ; sh:targetClass ex:Part ; sh:expression [ ex:dear ( [ sh:path ex:p_retailprice ] [ sh:path ex:p_size ] ) ] .'
    return check(spark, sf_dir, shapes, "part").select(_key("focus").alias("id"))


Q["e_expression"] = (_expression, "SELECT p_partkey AS id FROM part WHERE NOT p_retailprice > p_size * 40")
_COMPONENT = f'ex: sh:declare [ sh:prefix "ex" ; sh:namespace "{EX}" ] . ex:S a sh:NodeShape ; sh:targetClass ex:Customer ; sh:sparql [ sh:prefixes ex: ; sh:message "{{?value}} is owed" ; sh:select "SELECT $this ?value WHERE {{ $this ex:c_acctbal ?value FILTER(?value < 0) }}" ] .'
_shape("v_sparql", "customer", _COMPONENT, "SELECT c_custkey AS id, c_acctbal AS v FROM customer WHERE c_acctbal < 0", "number")
_ASK = f'ex: sh:declare [ sh:prefix "ex" ; sh:namespace "{EX}" ] . ex:AtLeast a sh:ConstraintComponent ; sh:parameter [ sh:path ex:atLeast ] ; sh:validator [ a sh:SPARQLAskValidator ; sh:prefixes ex: ; sh:ask "ASK {{ FILTER($value >= $atLeast) }}" ] . ex:S a sh:NodeShape ; sh:targetClass ex:Part ; sh:property [ sh:path ex:p_size ; ex:atLeast 30 ] .'
_shape("v_sparql_component", "part", _ASK, "SELECT p_partkey AS id, p_size::DOUBLE AS v FROM part WHERE NOT p_size >= 30", "number")


def _summary(spark, sf_dir):
    shapes = _on("Customer", "ex:c_acctbal", "sh:minInclusive 0 ; sh:severity sh:Warning") + 'ex:T a sh:NodeShape ; sh:targetClass ex:Customer ; sh:property [ sh:path ex:c_mktsegment ; sh:in ("BUILDING" "MACHINERY") ] .'
    found = check(spark, sf_dir, shapes, "customer")
    name = lambda c: F.regexp_extract(c, "#([^#>]*)>$", 1)
    return found.groupBy(name("component").alias("component"), name("severity").alias("severity")).agg(F.count(F.lit(1)).alias("n"))


Q["report_summary"] = (_summary, "SELECT 'MinInclusiveConstraintComponent' AS component, 'Warning' AS severity, count(*) AS n FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'InConstraintComponent', 'Violation', count(*) FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")

QUERIES = {name: run for name, (run, _) in Q.items()}
SQL = {name: sql for name, (_, sql) in Q.items()}
