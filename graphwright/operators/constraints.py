"""Core constraint components. Each takes a run, a shape, the focus nodes F (f) and the value nodes FV (f, v),
and gives the violations: (f, v) with a null v where no value is to blame, a row for each violation."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as t
from ..functions.terms import RDFS, SH, TRUE, TYPE, is_literal, lexical_of
from ..plans.settle import settle
from ..plans.shapes import ConstraintLoadError, Shape, integer, sh
from .targets import instances

def _v() -> Column:
    return F.col("v")


def _none() -> Column:
    return F.lit(None).cast("string")


def _one(shape: Shape, name: str) -> str:
    if len(shape.get(name)) != 1:
        raise ConstraintLoadError(f"{shape.node} needs exactly one sh:{name}")
    return shape.get(name)[0]


def _property_only(shape: Shape, name: str) -> None:
    if shape.path is None:
        raise ConstraintLoadError(f"sh:{name} is for property shapes only; {shape.node} has no path")


def _fails(ok: Column) -> Column:
    return ~F.coalesce(ok, F.lit(False))


def _no_value(frame: DataFrame) -> DataFrame:
    return frame.select("f", _none().alias("v"))


def class_(run, shape, F_, FV):
    out = []
    for c in shape.get("class"):
        good = instances(run.graph, [c]).select(F.col("f").alias("v"))
        out.append(FV.join(good, "v", "left_anti").select("f", "v"))
    return reduce(DataFrame.unionByName, out)


def _of_value(conditions):
    """A component that judges each value by itself: a violation for each of ``conditions(run, shape, value)`` that holds.
    The value is bound to a variable, so that a term made of a table's column is made once a row, however often it is asked."""
    def component(run, shape, F_, FV):
        nth = lambda i: lambda v: conditions(run, shape, v)[i]
        number = len(conditions(run, shape, _v()))
        return reduce(DataFrame.unionByName, [FV.where(t.once(_v(), nth(i))) for i in range(number)])

    component.conditions = conditions
    return component


def _datatype(run, shape, v):
    want = lexical_of(_one(shape, "datatype"))
    if want == RDFS + "Literal":
        ok = t.c_is_literal(v)
    elif want == RDFS + "Datatype":
        ok = t.c_is_literal(v) & t.c_lang(v).isNull()
    else:
        ok = (t.c_datatype(v) == want) & ~t.c_ill_typed(v, want.removeprefix(t.XSD))
    return [_fails(ok)]


def _node_kind(run, shape, v):
    kind = lexical_of(_one(shape, "nodeKind")).removeprefix(SH)
    tests = {"IRI": t.c_is_iri, "BlankNode": t.c_is_blank, "Literal": t.c_is_literal}
    named = [test for name, test in tests.items() if name in kind]
    if not named:
        raise ConstraintLoadError(f"{kind} is no node kind")
    return [~reduce(lambda a, b: a | b, [test(v) for test in named])]


def _range(name: str, test):
    def conditions(run, shape, v):
        if any(not is_literal(x) for x in shape.get(name)):
            raise ConstraintLoadError(f"sh:{name} needs a literal")
        return [_fails(test(t.c_compare_with(v, limit))) for limit in shape.get(name)]

    return _of_value(conditions)


def _length(name: str, test):
    def conditions(run, shape, v):
        n = integer(_one(shape, name), f"sh:{name}")
        if n < 0:
            raise ConstraintLoadError(f"sh:{name} can't be negative")
        if name == "minLength" and n == 0:
            return [F.lit(False)]
        return [t.c_is_blank(v) | ~test(F.length(t.c_text(v)), n)]

    return _of_value(conditions)


def java_pattern(pattern: str) -> str:
    """Python-only notations of patterns in Java's form."""
    return re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern.replace("(?P<", "(?<")).replace("\\Z", "\\z")


def _pattern(run, shape, v):
    flags = "".join(c for x in shape.get("flags")[:1] for c in lexical_of(x) if c in "imsx")
    return [t.c_is_blank(v) | ~F.rlike(t.c_text(v), F.lit((f"(?{flags})" if flags else "") + java_pattern(lexical_of(p)))) for p in shape.get("pattern")]


def _language_in(run, shape, v):
    tags = [lexical_of(x).lower() for x in run.shapes.items(_one(shape, "languageIn"))]
    lang = F.lower(t.c_lang(v))
    ok = lang.isNotNull() if "*" in tags else lang.isin(*tags) | F.substring_index(lang, "-", 1).isin(*tags) if tags else F.lit(False)
    return [_fails(ok)]


def _in(run, shape, v):
    return [~v.isin(*run.shapes.items(_one(shape, "in")))]


datatype, node_kind, pattern, language_in, in_ = map(_of_value, (_datatype, _node_kind, _pattern, _language_in, _in))


def closed(run, shape, F_, FV):
    if _one(shape, "closed") != TRUE:
        return None
    ignored = [p for head in shape.get("ignoredProperties") for p in run.shapes.items(head)]
    allowed = [run.shapes.value(p, "path") for p in shape.get("property")]
    allowed = [p for p in allowed if p and p.startswith("<")]
    triples = run.graph.triples()
    bad = triples.where(~F.col("p").isin(*allowed, *ignored)) if allowed or ignored else triples
    bad = bad.where(~((F.col("p") == TYPE) & (F.col("o") == f"<{RDFS}Resource>"))).distinct()
    return FV.join(bad, F.col("v") == F.col("s")).select("f", F.col("o").alias("v"), F.col("p").alias("path"))


def _counts(F_, FV):
    counts = FV.groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    return F_.join(counts, "f", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def min_count(run, shape, F_, FV):
    _property_only(shape, "minCount")
    n = integer(_one(shape, "minCount"), "sh:minCount")
    if n < 0:
        raise ConstraintLoadError("sh:minCount can't be negative")
    if n == 1:  # no counting: which focus nodes have no value at all
        return _no_value(F_.join(FV, "f", "left_anti"))
    return _no_value(_counts(F_, FV).where(F.col("n") < n)) if n else None


def max_count(run, shape, F_, FV):
    _property_only(shape, "maxCount")
    n = integer(_one(shape, "maxCount"), "sh:maxCount")
    if n < 0:
        raise ConstraintLoadError("sh:maxCount can't be negative")
    return _no_value(FV.groupBy("f").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > n))


def unique_lang(run, shape, F_, FV):
    _property_only(shape, "uniqueLang")
    if _one(shape, "uniqueLang") != TRUE:
        return None
    lang = F.lower(t.c_lang(_v()))
    return _no_value(FV.where(lang.isNotNull()).groupBy("f", lang.alias("l")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"))


def has_value(run, shape, F_, FV):
    return reduce(DataFrame.unionByName, [_no_value(F_.join(FV.where(_v() == x), "f", "left_anti")) for x in shape.get("hasValue")])


def _other(run, F_, p: str) -> DataFrame:
    """(f, w): the objects of predicate p at the focus nodes."""
    pred = run.graph.pred(p)
    return F_.join(pred, F.col("f") == F.col("s")).select("f", F.col("o").alias("v")).distinct()


def equals(run, shape, F_, FV):
    out = []
    for p in shape.get("equals"):
        other = _other(run, F_, p)
        out += [FV.join(other, ["f", "v"], "left_anti").select("f", "v"), other.join(FV, ["f", "v"], "left_anti").select("f", "v")]
    return reduce(DataFrame.unionByName, out)


def disjoint(run, shape, F_, FV):
    return reduce(DataFrame.unionByName, [FV.join(_other(run, F_, p), ["f", "v"], "left_semi") for p in shape.get("disjoint")])


def _less(name: str, test):
    def component(run, shape, F_, FV):
        _property_only(shape, name)
        out = []
        for p in shape.get(name):
            if not p.startswith("<"):
                raise ConstraintLoadError(f"sh:{name} needs an IRI")
            # Each value is typed once; the join compares the typed values.
            known = lambda c: F.struct(t.c_typed_value(F.col(c)).alias("x"), F.when(t.c_is_iri(F.col(c)), F.col(c)).alias("iri"))
            other = _other(run, F_, p).select("f", known("v").alias("w"))
            own, w = F.col("k"), F.col("w")
            iris = F.when(own["iri"] < w["iri"], -1).when(own["iri"] > w["iri"], 1).when(own["iri"] == w["iri"], 0)
            sign = F.coalesce(iris, t.compare_values(own["x"], w["x"]))
            out.append(FV.withColumn("k", known("v")).join(other, "f").where(_fails(test(sign))).select("f", "v"))
        return reduce(DataFrame.unionByName, out)

    return component


def _simple(run, node: str) -> Column | None:
    """The condition on which a value fails a shape that only judges the value itself; None for other shapes."""
    shape = run.shapes.shapes.get(node)
    if shape is None or shape.path is not None or shape.deactivated or shape.severity in run.allow or run.focus is not None or len(run.stack) >= run.max_depth:
        return None
    own = [x for x in shape.params if x.startswith(f"<{SH}")]
    functions = {sh(name): COMPONENTS[name][1] for name in COMPONENTS if hasattr(COMPONENTS[name][1], "conditions")}
    if len(own) != sum(x != TYPE for x in shape.params) or any(x not in functions and x not in PLAIN for x in own):
        return None
    return t.once(_v(), lambda v: reduce(lambda a, b: a | b, [c for x in own if x in functions for c in functions[x].conditions(run, shape, v)], F.lit(False)))


def _failing(run, node: str, FV: DataFrame) -> DataFrame:
    """(f): the values of FV that don't conform to the shape. Beneath the second shape they are written, so that no task holds the sorts and
    aggregates of all shapes within one another, of which each has memory of its own."""
    asked = FV.select(F.col("v").alias("f")).distinct()
    return run.failing(node, asked) if len(run.stack) < 2 else settle(run.failing(node, settle(asked)))


def _passes(run, node: str, FV: DataFrame, conform: bool) -> DataFrame:
    """The rows of FV whose value conforms, or doesn't, to the shape."""
    if (bad := _simple(run, node)) is not None:
        # A filter, instead of a join by values, a few of which may be those of most rows.
        return FV.where(~bad if conform else bad).select("f", "v")
    bad = _failing(run, node, FV)
    return FV.join(bad.withColumnRenamed("f", "v"), "v", "left_anti" if conform else "left_semi").select("f", "v")


def not_(run, shape, F_, FV):
    return reduce(DataFrame.unionByName, [_passes(run, s, FV, True) for s in shape.get("not") if not run.recursive(s)] or [FV.where(F.lit(False))])


def and_(run, shape, F_, FV):
    out = []
    for head in shape.get("and"):
        parts = [_passes(run, s, FV, False) for s in dict.fromkeys(run.shapes.items(head))]
        out.append(reduce(DataFrame.unionByName, parts).distinct())
    return reduce(DataFrame.unionByName, out)


def or_(run, shape, F_, FV):
    # Only the values that failed one member go on to the next.
    return reduce(DataFrame.unionByName, [reduce(lambda left, s: _passes(run, s, left, False), dict.fromkeys(run.shapes.items(head)), FV) for head in shape.get("or")])


def xone(run, shape, F_, FV):
    out = []
    for head in shape.get("xone"):
        members = run.shapes.items(head)
        counted, n = FV.withColumn("n", F.lit(0)), F.col("n")
        for s in dict.fromkeys(members):
            if (simple := _simple(run, s)) is not None:
                counted = counted.select("f", "v", (n + F.when(simple, 0).otherwise(members.count(s))).alias("n"))
                continue
            bad = _failing(run, s, FV).select(F.col("f").alias("v"), F.lit(True).alias("bad"))
            counted = counted.join(bad, "v", "left").select("f", "v", (n + F.when(F.col("bad"), 0).otherwise(members.count(s))).alias("n"))
        out.append(counted.where(n != 1).select("f", "v"))
    return reduce(DataFrame.unionByName, out)


def nodes_failing(run, inner: str, FV: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The rows of FV whose value has any result of the shape, these results, and what stands beneath them."""
    found, nested = run.results_and_nested(inner, FV.select(F.col("v").alias("f")).distinct())
    bad = found.select(F.col("root").alias("v")).distinct()
    return FV.join(bad, "v", "left_semi").select("f", "v"), found, nested


def node(run, shape, F_, FV):
    out = [nodes_failing(run, s, FV)[0] for s in shape.get("node") if not run.recursive(s)]
    return reduce(DataFrame.unionByName, out) if out else None


def _siblings(run, shape: Shape) -> list[str]:
    parents = run.shapes.subjects.get((sh("property"), shape.node), [])
    own = set(shape.get("qualifiedValueShape"))
    found = [q for parent in parents for p in run.shapes.values(parent, "property") for q in run.shapes.values(p, "qualifiedValueShape")]
    return [q for q in dict.fromkeys(found) if q not in own]


def qualified(run, shape, F_, FV, which: str):
    if shape.path is None:
        return None
    if not shape.get("qualifiedValueShape"):
        raise ConstraintLoadError(f"{shape.node} needs sh:qualifiedValueShape")
    n, out = integer(_one(shape, which), f"sh:{which}"), []
    for q in shape.get("qualifiedValueShape"):
        if run.recursive(q):
            continue
        good = _passes(run, q, FV, True)
        if TRUE in shape.get("qualifiedValueShapesDisjoint"):
            for s in _siblings(run, shape):
                good = _passes(run, s, good, False)
        if which == "qualifiedMaxCount":  # only nodes that have a value can have too many
            many = good.groupBy("f").agg(F.count(F.lit(1)).alias("n"))
            out.append(_no_value(many.where(F.col("n") > n)) if n >= 0 else _no_value(F_))
        else:
            out.append(_no_value(_counts(F_, good).where(F.col("n") < n)))
    return reduce(DataFrame.unionByName, out) if out else None


def qualified_min(run, shape, F_, FV):
    return qualified(run, shape, F_, FV, "qualifiedMinCount")


def qualified_max(run, shape, F_, FV):
    return qualified(run, shape, F_, FV, "qualifiedMaxCount")


#: Parameters that constrain nothing.
PLAIN = frozenset(sh(n) for n in ("flags", "message", "severity", "name", "description", "order", "group", "defaultValue"))

#: Parameter -> (name of the component, its function, message).
COMPONENTS = {
    "class": ("Class", class_, "{v} isn't an instance of {p}"),
    "datatype": ("Datatype", datatype, "{v} isn't a literal of datatype {p}"),
    "nodeKind": ("NodeKind", node_kind, "{v} isn't of the kind {p}"),
    "minExclusive": ("MinExclusive", _range("minExclusive", lambda c: c > 0), "{v} has to be greater than {p}"),
    "minInclusive": ("MinInclusive", _range("minInclusive", lambda c: c >= 0), "{v} has to be {p} or greater"),
    "maxExclusive": ("MaxExclusive", _range("maxExclusive", lambda c: c < 0), "{v} has to be less than {p}"),
    "maxInclusive": ("MaxInclusive", _range("maxInclusive", lambda c: c <= 0), "{v} has to be {p} or less"),
    "minLength": ("MinLength", _length("minLength", lambda x, n: x >= n), "The text of {v} has to have {p} characters or more"),
    "maxLength": ("MaxLength", _length("maxLength", lambda x, n: x <= n), "The text of {v} has to have {p} characters or fewer"),
    "pattern": ("Pattern", pattern, "{v} doesn't match {p}"),
    "languageIn": ("LanguageIn", language_in, "The language of {v} isn't one of {p}"),
    "in": ("In", in_, "{v} isn't one of {p}"),
    "closed": ("Closed", closed, "{f} may not have the value {v}: its shape is closed"),
    "minCount": ("MinCount", min_count, "{f} needs at least {p} values of {path}"),
    "maxCount": ("MaxCount", max_count, "{f} may have {p} values of {path} at most"),
    "uniqueLang": ("UniqueLang", unique_lang, "{f} has several texts of one language at {path}"),
    "hasValue": ("HasValue", has_value, "{f} lacks the value {p} of {path}"),
    "equals": ("Equals", equals, "{v} has to be a value of both {path} and {p} of {f}"),
    "disjoint": ("Disjoint", disjoint, "{v} may not be a value of both {path} and {p} of {f}"),
    "lessThan": ("LessThan", _less("lessThan", lambda c: c < 0), "{v} has to be less than every value of {p} of {f}"),
    "lessThanOrEquals": ("LessThanOrEquals", _less("lessThanOrEquals", lambda c: c <= 0), "{v} may not be greater than a value of {p} of {f}"),
    "not": ("Not", not_, "{v} may not conform to {p}"),
    "and": ("And", and_, "{v} has to conform to each of {p}"),
    "or": ("Or", or_, "{v} has to conform to at least one of {p}"),
    "xone": ("Xone", xone, "{v} has to conform to just one of {p}"),
    "node": ("Node", node, "{v} doesn't conform to {p}"),
    "qualifiedMinCount": ("QualifiedMinCount", qualified_min, "{f} has too few values of {path} that conform: {p} are needed"),
    "qualifiedMaxCount": ("QualifiedMaxCount", qualified_max, "{f} has too many values of {path} that conform: {p} are allowed"),
}
LIST_PARAMETERS = ("in", "languageIn", "and", "or", "xone")
