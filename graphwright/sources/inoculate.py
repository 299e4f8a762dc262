"""What a data graph takes from an ontology: its classes, properties and named individuals, and no other data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import OWL, RDF, RDFS, TYPE, iri
from ..plans.settle import settle
from .graph import Graph

#: Types of ontology terms, and predicates whose subjects are ontology terms.
TYPES = [iri(RDFS + n) for n in "Class Datatype ContainerMembershipProperty".split()] + [iri(RDF + "Property")] + [
    iri(OWL + n) for n in "Class Restriction DataRange DeprecatedClass DeprecatedProperty ObjectProperty DatatypeProperty AnnotationProperty OntologyProperty FunctionalProperty InverseFunctionalProperty "
    "SymmetricProperty AsymmetricProperty TransitiveProperty ReflexiveProperty IrreflexiveProperty NamedIndividual AllDifferent AllDisjointClasses AllDisjointProperties".split()
]
PREDICATES = [iri(RDFS + n) for n in "subClassOf subPropertyOf domain range".split()] + [
    iri(OWL + n) for n in "equivalentClass equivalentProperty inverseOf disjointWith complementOf unionOf intersectionOf oneOf propertyDisjointWith propertyChainAxiom hasKey sameAs differentFrom".split()
]


def ontology_triples(graph: Graph) -> DataFrame:
    """(s, p, o): all triples of the ontology's terms, and of the blank nodes that are reached from them. Blank nodes are
    followed in rounds, each of which reads the graph once; an ontology without terms gives no rows."""
    triples = graph.triples()
    terms = triples.where(((F.col("p") == TYPE) & F.col("o").isin(*TYPES)) | F.col("p").isin(*PREDICATES)).select("s").distinct()
    seen = fresh = settle(terms)
    found = triples.limit(0)
    while not fresh.isEmpty():
        part = settle(triples.join(fresh, "s", "left_semi").distinct())
        found = found.unionByName(part)
        fresh = settle(part.where(F.startswith("o", F.lit("_:"))).select(F.col("o").alias("s")).distinct().join(seen, "s", "left_anti"))
        seen = seen.unionByName(fresh)
    return found.distinct()
