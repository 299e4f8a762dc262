"""RDF terms as strings, and native expressions over them.

A term is one string in N-Triples style with its contents unescaped: ``<iri>``, ``_:label``,
``"lexical"^^<datatype>`` or ``"lexical"@lang``. Equal strings are equal terms, so terms join, group and
compare as plain strings; a plain literal always carries xsd:string. Nothing normalises lexical forms.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
SH = "http://www.w3.org/ns/shacl#"
TYPE, SUBCLASS = f"<{RDF}type>", f"<{RDFS}subClassOf>"
TRUE, FALSE = f'"true"^^<{XSD}boolean>', f'"false"^^<{XSD}boolean>'

#: Numeric datatypes, exact ones first.
INTEGERS = tuple(
    "integer int long short byte nonNegativeInteger positiveInteger nonPositiveInteger negativeInteger unsignedInt unsignedLong unsignedShort unsignedByte".split()
)
EXACT = (*INTEGERS, "decimal")
NUMERIC = (*EXACT, "float", "double")
#: Least and greatest value of the derived integer types.
BOUNDS = {
    "long": (-(2**63), 2**63 - 1), "int": (-(2**31), 2**31 - 1), "short": (-(2**15), 2**15 - 1), "byte": (-128, 127), "nonNegativeInteger": (0, None), "positiveInteger": (1, None),
    "nonPositiveInteger": (None, 0), "negativeInteger": (None, -1), "unsignedLong": (0, 2**64 - 1), "unsignedInt": (0, 2**32 - 1), "unsignedShort": (0, 2**16 - 1), "unsignedByte": (0, 255),
}


def iri(text: str) -> str:
    return f"<{text}>"


def literal(lexical: str, datatype: str = XSD + "string", lang: str | None = None) -> str:
    return f'"{lexical}"@{lang}' if lang else f'"{lexical}"^^<{datatype}>'


def is_literal(term: str) -> bool:
    return term[:1] == '"'


def lexical_of(term: str) -> str:
    """The text of a literal, the IRI of an IRI, the label of a blank node."""
    return term[1 : term.rindex('"')] if is_literal(term) else term[1:-1] if term[:1] == "<" else term[2:]


def datatype_of(term: str) -> str:
    end = term[term.rindex('"') + 1 :]
    return end[3:-1] if end.startswith("^^") else RDF + "langString"


def lang_of(term: str) -> str:
    end = term[term.rindex('"') + 1 :] if is_literal(term) else ""
    return end[1:] if end.startswith("@") else ""


# Native expressions


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row. Filters are moved to where a term is put together from a
    table's column, and it would else be put together anew wherever it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def suffix(t: Column) -> Column:
    """What follows the last quote: ``^^<datatype>`` or ``@lang``."""
    return F.substring_index(t, '"', -1)


def c_is_literal(t: Column) -> Column:
    return F.startswith(t, F.lit('"'))


def c_is_iri(t: Column) -> Column:
    return F.startswith(t, F.lit("<"))


def c_is_blank(t: Column) -> Column:
    return F.startswith(t, F.lit("_:"))


def c_text(t: Column) -> Column:
    return (
        F.when(c_is_literal(t), F.substring(t, F.lit(2), F.length(t) - F.length(suffix(t)) - 2))
        .when(c_is_iri(t), F.substring(t, F.lit(2), F.length(t) - 2))
        .otherwise(F.substring(t, F.lit(3), F.length(t)))
    )


def c_datatype(t: Column) -> Column:
    s = suffix(t)
    return F.when(c_is_literal(t), F.when(F.startswith(s, F.lit("^^")), F.substring(s, F.lit(4), F.length(s) - 4)).otherwise(RDF + "langString"))


def c_lang(t: Column) -> Column:
    s = suffix(t)
    return F.when(c_is_literal(t) & F.startswith(s, F.lit("@")), F.substring(s, F.lit(2), F.length(s)))


def c_local_type(t: Column) -> Column:
    """The name of an XSD datatype, null for other types and terms."""
    d = c_datatype(t)
    return F.when(F.startswith(d, F.lit(XSD)), F.substring(d, F.lit(len(XSD) + 1), F.length(d)))


#: Lexical forms of XSD datatypes.
_ZONE = r"(Z|[+-](0\d|1[0-3]):[0-5]\d|[+-]14:00)?"
_DATE = r"-?([1-9]\d{3,}|0\d{3})-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])"
_TIME = r"(([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?|24:00:00(\.0+)?)"
LEXICAL = {
    **dict.fromkeys(INTEGERS, r"[+-]?\d+"), "decimal": r"[+-]?(\d+(\.\d*)?|\.\d+)", "float": r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[+-]?INF|NaN",
    "double": r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[+-]?INF|NaN", "boolean": "true|false|0|1", "date": _DATE + _ZONE, "time": _TIME + _ZONE, "dateTime": f"{_DATE}T{_TIME}{_ZONE}",
    "gYear": r"-?\d{4,}" + _ZONE, "hexBinary": "([0-9a-fA-F]{2})*", "duration": r"-?P(?=.)(\d+Y)?(\d+M)?(\d+D)?(T(?=.)(\d+H)?(\d+M)?(\d+(\.\d+)?S)?)?",
}


def c_ill_typed(t: Column, known: str | None = None) -> Column:
    """True for a literal whose text isn't a form of its datatype; unknown datatypes are never ill-typed. With
    ``known``, the name of an XSD datatype that the caller tests besides, only that one's rules are planned."""
    name, text = c_local_type(t), c_text(t)
    bad = F.lit(False)
    lexical = {n: p for n, p in LEXICAL.items() if known in (None, n)}
    for pattern in sorted(set(lexical.values())):
        names = [n for n, p in lexical.items() if p == pattern]
        bad = bad | (name.isin(*names) & ~F.rlike(text, F.lit(f"^(?:{pattern})$")))
    number = text.try_cast("decimal(38,0)")
    for n, (low, high) in {n: b for n, b in BOUNDS.items() if known in (None, n)}.items():
        if low is not None:
            bad = bad | ((name == n) & (number < F.lit(low).cast("decimal(38,0)")))
        if high is not None:
            bad = bad | ((name == n) & (number > F.lit(str(high)).cast("decimal(38,0)")))
    if known in (None, "date", "dateTime"):
        bad = bad | (name.isin("date", "dateTime") & F.substring(text, 1, 10).try_cast("date").isNull())
    return c_is_literal(t) & F.coalesce(bad, F.lit(False))


def c_number(t: Column) -> Column:
    return F.when(c_local_type(t).isin(*NUMERIC), F.regexp_replace(c_text(t), "INF$", "Infinity").try_cast("double"))


def c_integer(t: Column) -> Column:
    """The number of an integer literal, of up to 38 digits."""
    return F.when(c_local_type(t).isin(*INTEGERS), c_text(t).try_cast("decimal(38,0)"))


def c_exact(t: Column) -> Column:
    """The number of an integer or decimal literal, 12 digits after the point."""
    return F.when(c_local_type(t).isin(*EXACT), c_text(t).try_cast("decimal(38,12)"))


def c_compare_with(a: Column, constant: str) -> Column:
    """``c_compare`` with a constant literal: only the rules of its type are planned."""
    if lang_of(constant):
        return c_compare(a, F.lit(constant))
    name, text = datatype_of(constant).removeprefix(XSD), lexical_of(constant)
    sign = lambda x, y: F.when(x < y, -1).when(x > y, 1).when(x == y, 0)

    def numbers(p: Column) -> Column:
        number = F.regexp_replace(p["text"], "INF$", "Infinity").try_cast("double")
        exact = F.when(p["name"].isin(*EXACT), sign(p["text"].try_cast("decimal(38,12)"), F.lit(text).try_cast("decimal(38,12)"))) if name in EXACT else F.lit(None).cast("int")
        return F.when(p["name"].isin(*NUMERIC), once(number, lambda x: F.when(~F.isnan(x), F.coalesce(exact, sign(x, c_number(F.lit(constant)))))))

    if name in NUMERIC:
        return once(a, lambda x: once(F.struct(c_local_type(x).alias("name"), c_text(x).alias("text")), numbers))
    if name == "string":
        return once(a, lambda x: F.when(c_local_type(x) == "string", sign(c_text(x), F.lit(text))))
    return c_compare(a, F.lit(constant))


#: Kinds of values that can be compared with their like only.
_NUMBER, _STRING, _BOOLEAN, _MOMENT, _DAY, _TIME_OF_DAY, _TAGGED = range(1, 8)


def c_typed_value(t: Column) -> Column:
    """(kind, zone, number, exact, text) of a literal, to be computed once and compared often; a null kind compares with nothing."""
    kinds = {"string": _STRING, "boolean": _BOOLEAN, "dateTime": _MOMENT, "date": _DAY, "time": _TIME_OF_DAY}

    def typed(p: Column) -> Column:
        name, text, lang = p["name"], p["text"], p["lang"]
        zoned = F.rlike(text, F.lit(r"(Z|[+-]\d\d:\d\d)$"))
        moment = lambda x: F.when(zoned, x.try_cast("timestamp").cast("double")).otherwise(F.concat(x, F.lit("Z")).try_cast("timestamp").cast("double"))
        number = (
            F.when(name.isin(*NUMERIC), F.regexp_replace(text, "INF$", "Infinity").try_cast("double"))
            .when(name == "boolean", F.when(text.isin("true", "1"), 1.0).when(text.isin("false", "0"), 0.0))
            .when(name == "dateTime", moment(text)).when(name == "date", F.unix_date(F.substring(text, 1, 10).try_cast("date")).cast("double"))
            .when(name == "time", moment(F.concat(F.lit("1970-01-01T"), text)))
        )
        kind = F.when(name.isin(*NUMERIC), _NUMBER)
        for n, k in kinds.items():
            kind = kind.when(name == n, k)
        zone = F.when(name.isin("dateTime", "date", "time"), zoned.cast("string")).otherwise(lang)
        exact = F.when(name.isin(*EXACT), text.try_cast("decimal(38,12)"))
        own_text = F.when((name == "string") | lang.isNotNull(), text)
        return F.struct(
            kind.when(lang.isNotNull(), _TAGGED).alias("kind"), zone.alias("zone"), once(number, lambda x: F.when(~F.isnan(x), x)).alias("number"), exact.alias("exact"), own_text.alias("text")
        )

    return once(t, lambda x: once(F.struct(c_local_type(x).alias("name"), c_text(x).alias("text"), c_lang(x).alias("lang")), typed))


def compare_values(a: Column, b: Column) -> Column:
    """-1, 0 or 1 for what ``c_typed_value`` gives of two literals that can be compared, else null."""
    sign = lambda x: F.when(a[x] < b[x], -1).when(a[x] > b[x], 1).when(a[x] == b[x], 0)
    return F.when((a["kind"] == b["kind"]) & a["zone"].eqNullSafe(b["zone"]), F.when(a["kind"].isin(_STRING, _TAGGED), sign("text")).otherwise(F.coalesce(sign("exact"), sign("number"))))


def c_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 for literals whose values can be compared, else null: numbers with numbers, strings with
    strings, booleans with booleans, dates and times with their like, zoned with zoned only. NaN compares with nothing."""
    one = lambda x: F.transform(F.array(c_typed_value(x)), lambda v: v)
    return F.element_at(F.zip_with(one(a), one(b), compare_values), 1)


def c_truth(t: Column) -> Column:
    """The effective boolean value; null where SPARQL has an error."""
    name, text = c_local_type(t), c_text(t)
    number = c_number(t)
    return (
        F.when(name == "boolean", F.when(text.isin("true", "1"), True).otherwise(False))
        .when(name.isin(*NUMERIC), F.when(number.isNull() | F.isnan(number), False).otherwise(number != 0))
        .when(c_is_literal(t) & ((name == "string") | c_lang(t).isNotNull()), F.length(text) > 0)
    )


def c_bool(x: Column) -> Column:
    return F.when(x, TRUE).when(~x, FALSE)


def c_string(x: Column) -> Column:
    return F.concat(F.lit('"'), x, F.lit(f'"^^<{XSD}string>'))


def c_typed(x: Column, name: str) -> Column:
    return F.concat(F.lit('"'), x.cast("string"), F.lit(f'"^^<{XSD}{name}>'))
