"""SPARQL algebra as DataFrame plans. A solution set is a frame with a column of terms for each variable.

Pre-bound variables ($this, $value ..) are columns of a seed frame: every group starts from the seed, so they
are visible in nested groups, unions and subqueries, and a query runs once for all focus nodes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms as t
from ..functions.terms import XSD, lexical_of
from ..operators.paths import values
from ..sources.graph import Graph
from ..sources.store import StoredGraph
from .hooks import Hook, answered
from .sparql_parser import Query, SparqlError, variables

def _null() -> Column:
    return F.lit(None).cast("string")


def _eq(a: Column, b: Column) -> Column:
    both = t.c_is_literal(a) & t.c_is_literal(b)
    return F.when(a == b, True).when(both, t.c_compare(a, b) == 0).otherwise(False)


def _number(value: Column, a: Column, b: Column, divide: bool = False) -> Column:
    """A numeric literal of the type that SPARQL's promotion gives."""
    ta, tb = t.c_local_type(a), t.c_local_type(b)
    whole = ta.isin(*t.INTEGERS) & tb.isin(*t.INTEGERS)
    exact = ta.isin(*t.EXACT) & tb.isin(*t.EXACT)
    plain = F.regexp_replace(F.regexp_replace(value.try_cast("decimal(38,12)").cast("string"), "(\\.\\d*?)0+$", "$1"), "\\.$", "")
    integer = t.c_typed(value.try_cast("decimal(38,0)"), "integer")
    decimal = t.c_typed(plain, "decimal")
    return F.when(value.isNull(), _null()).when(whole, decimal if divide else integer).when(exact, decimal).otherwise(t.c_typed(value, "double"))


def _plain(value: Column) -> Column:
    """A decimal's text without zeros at its end."""
    return F.regexp_replace(F.regexp_replace(value.cast("string"), "(\\.\\d*?)0+$", "$1"), "\\.$", "")


def _exactly(op: str, a: Column, b: Column, otherwise: Column) -> Column:
    """The sum, difference or product of two integers, or decimals, without rounding; ``otherwise`` where the numbers are
    others, or the result has more than 38 digits."""
    do = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op]
    ta, tb = t.c_local_type(a), t.c_local_type(b)
    whole = F.when(ta.isin(*t.INTEGERS) & tb.isin(*t.INTEGERS), do(t.c_integer(a), t.c_integer(b)))
    # 18 digits, 9 of them after the point, give products without loss.
    size = "decimal(18,9)" if op == "*" else "decimal(38,12)"
    part = lambda x: t.c_text(x).try_cast(size)
    kept = lambda x: part(x) == t.c_text(x).try_cast("decimal(38,18)")
    exact = F.when(ta.isin(*t.EXACT) & tb.isin(*t.EXACT) & kept(a) & kept(b), do(part(a), part(b)))
    return F.coalesce(t.c_typed(whole, "integer"), t.c_typed(_plain(exact), "decimal"), otherwise)


@dataclass
class Engine:
    """``functions``: IRI -> (parameter names, Query or Hook) of custom functions."""

    graph: Graph
    functions: dict[str, tuple[list[str], Query | Hook]] = field(default_factory=dict)
    quad: str | None = None
    count: int = 0
    #: Gives the triples of the shapes, for GRAPH $shapesGraph.
    shapes: Callable[[], Graph] | None = None
    #: Variables of the query at hand that may be unbound.
    maybe: set[str] = field(default_factory=set)
    scope: set[str] = field(default_factory=set)
    #: A query whose solutions keep what they are sorted by, as _order0, _order1 and so on.
    keep_order: Query | None = None

    def fresh(self, stem: str) -> str:
        self.count += 1
        return f"_{stem}{self.count}"

    # Expressions

    def bool_of(self, e: tuple) -> Column:
        op = e[0]
        if op in ("&&", "||"):
            a, b = self.bool_of(e[1]), self.bool_of(e[2])
            return a & b if op == "&&" else a | b
        if op == "!":
            return ~self.bool_of(e[1])
        if op in ("=", "!=", "<", ">", "<=", ">="):
            if e[1][0] == "term" and e[2][0] != "term":  # the constant to the right
                return self.bool_of(({"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(op, op), e[2], e[1]))
            constant = e[2][1] if e[2][0] == "term" else None
            a, b = self.term_of(e[1]), self.term_of(e[2])
            if op in ("=", "!="):
                if constant is None:
                    same = _eq(a, b)
                elif t.is_literal(constant):
                    same = F.when(a == b, True).when(t.c_is_literal(a), t.c_compare_with(a, constant) == 0).otherwise(False)
                else:
                    same = a == b
                return same if op == "=" else ~same
            c = t.c_compare(a, b) if constant is None or not t.is_literal(constant) else t.c_compare_with(a, constant)
            return {"<": c < 0, ">": c > 0, "<=": c <= 0, ">=": c >= 0}[op]
        if op in ("in", "not in"):
            a = self.term_of(e[1])
            hit = reduce(lambda x, y: x | y, [_eq(a, self.term_of(x)) for x in e[2]], F.lit(False))
            return hit if op == "in" else ~hit
        if op == "flag":
            return F.coalesce(F.col(e[1]), F.lit(False))
        if op == "fn" and (test := self._test(e[1], e[2])) is not None:
            return test
        return t.c_truth(self.term_of(e))

    def _test(self, name: str, args: list[tuple]) -> Column | None:
        a = [self.term_of(x) for x in args]
        text = [t.c_text(x) for x in a]
        one = {
            "BOUND": lambda: a[0].isNotNull(), "ISIRI": lambda: t.c_is_iri(a[0]), "ISURI": lambda: t.c_is_iri(a[0]), "ISBLANK": lambda: t.c_is_blank(a[0]),
            "ISLITERAL": lambda: t.c_is_literal(a[0]), "ISNUMERIC": lambda: t.c_number(a[0]).isNotNull() & ~t.c_ill_typed(a[0]), "SAMETERM": lambda: a[0] == a[1],
            "STRSTARTS": lambda: F.startswith(text[0], text[1]), "STRENDS": lambda: F.endswith(text[0], text[1]), "CONTAINS": lambda: F.contains(text[0], text[1]),
            "LANGMATCHES": lambda: F.when(text[1] == "*", text[0] != "").otherwise((F.lower(text[0]) == F.lower(text[1])) | F.startswith(F.lower(text[0]), F.concat(F.lower(text[1]), F.lit("-")))),
            "REGEX": lambda: F.rlike(text[0], F.concat(F.concat(F.lit("(?"), text[2], F.lit(")")) if len(a) > 2 else F.lit(""), text[1])),
        }.get(name)
        return one() if one else None

    def term_of(self, e: tuple) -> Column:
        op = e[0]
        if op == "var":
            return F.col(f"`{e[1]}`") if e[1] in self.scope else _null()
        if op == "term":
            return F.lit(e[1])
        if op in ("&&", "||", "!", "=", "!=", "<", ">", "<=", ">=", "in", "not in", "flag"):
            return t.c_bool(self.bool_of(e))
        if op in ("+", "-", "*", "/"):
            a, b = self.term_of(e[1]), self.term_of(e[2])
            x, y = t.c_number(a), t.c_number(b)
            if op == "/":
                return _number(F.try_divide(x, y), a, b, True)
            return _exactly(op, a, b, _number({"+": x + y, "-": x - y, "*": x * y}[op], a, b))
        if op in ("-1", "+1"):
            a = self.term_of(e[1])
            return _number(t.c_number(a), a, a) if op == "+1" else _exactly("-", F.lit(f'"0"^^<{XSD}integer>'), a, _number(-t.c_number(a), a, a))
        if op == "column":
            return F.col(f"`{e[1]}`")
        if op == "call":
            name = lexical_of(e[1])
            if name.startswith(XSD):
                return self._cast(name[len(XSD) :], self.term_of(e[2][0]))
            raise SparqlError(f"the function {e[1]} isn't known")
        if op == "fn":
            return self._function(e[1], e[2])
        raise SparqlError(f"an expression {op} isn't read here")

    def _cast(self, name: str, a: Column) -> Column:
        out = t.c_typed(t.c_text(a), name)
        return out if name == "string" else F.when(~t.c_ill_typed(out), out)

    def _function(self, name: str, args: list[tuple]) -> Column:
        if (test := self._test(name, args)) is not None:
            return t.c_bool(test)
        if name == "IF":
            test = self.bool_of(args[0])  # null: an error, and so is the answer
            return F.when(test, self.term_of(args[1])).when(~test, self.term_of(args[2]))
        a = [self.term_of(x) for x in args]
        text = [t.c_text(x) for x in a]
        keep = lambda value: F.concat(F.lit('"'), value, F.lit('"'), t.suffix(a[0]))  # noqa: E731  of the first argument's type or language
        # Whole numbers of any size are their own floor, ceiling and rounding.
        number = lambda value: _number(value, a[0], a[0])
        whole = lambda other: F.when(t.c_local_type(a[0]).isin(*t.INTEGERS), t.c_typed(t.c_integer(a[0]), "integer")).otherwise(other)
        part = lambda field_: t.c_typed(F.regexp_extract(text[0], r"^-?(\d+)-(\d\d)-(\d\d)(?:T(\d\d):(\d\d):([0-9.]+))?", field_).try_cast("decimal(20,6)").cast("int"), "integer")
        digest = lambda bits: t.c_string(F.sha2(text[0], bits))
        zone = F.regexp_extract(text[0], r"(Z|[+-]\d\d:\d\d)$", 1)
        made = {
            "STR": lambda: t.c_string(text[0]), "STRLEN": lambda: t.c_typed(F.length(text[0]), "integer"), "CONCAT": lambda: self._concat(a, text),
            "UCASE": lambda: keep(F.upper(text[0])), "LCASE": lambda: keep(F.lower(text[0])), "COALESCE": lambda: F.coalesce(*a),
            "SUBSTR": lambda: keep(F.substring(text[0], t.c_number(a[1]).cast("int"), t.c_number(a[2]).cast("int") if len(a) > 2 else F.length(text[0]))),
            "REPLACE": lambda: keep(F.regexp_replace(text[0], F.concat(F.lit("(?"), text[3], F.lit(")"), text[1]) if len(a) > 3 else text[1], text[2])),
            "STRBEFORE": lambda: F.when(F.contains(text[0], text[1]), keep(F.substring(text[0], F.lit(1), F.position(text[1], text[0]) - 1))).otherwise(t.c_string(F.lit(""))),
            "STRAFTER": lambda: F.when(F.contains(text[0], text[1]), keep(F.substring(text[0], F.position(text[1], text[0]) + F.length(text[1]), F.length(text[0])))).otherwise(t.c_string(F.lit(""))),
            "ENCODE_FOR_URI": lambda: t.c_string(F.regexp_replace(F.url_encode(text[0]), r"\+", "%20")),
            "LANG": lambda: F.when(t.c_is_literal(a[0]), t.c_string(F.coalesce(t.c_lang(a[0]), F.lit("")))), "DATATYPE": lambda: F.concat(F.lit("<"), t.c_datatype(a[0]), F.lit(">")),
            "IRI": lambda: F.concat(F.lit("<"), text[0], F.lit(">")), "URI": lambda: F.concat(F.lit("<"), text[0], F.lit(">")),
            "STRDT": lambda: F.concat(F.lit('"'), text[0], F.lit('"^^'), a[1]), "STRLANG": lambda: F.concat(F.lit('"'), text[0], F.lit('"@'), text[1]),
            "BNODE": lambda: F.concat(F.lit("_:b"), F.md5(text[0])) if text else F.concat(F.lit("_:u"), F.replace(F.expr("uuid()"), F.lit("-"), F.lit(""))),
            "ABS": lambda: F.when(t.c_local_type(a[0]).isin(*t.INTEGERS), t.c_typed(F.abs(t.c_integer(a[0])), "integer")).otherwise(number(F.abs(t.c_number(a[0])))),
            "CEIL": lambda: whole(number(F.ceil(t.c_number(a[0])).cast("double"))), "FLOOR": lambda: whole(number(F.floor(t.c_number(a[0])).cast("double"))), "ROUND": lambda: whole(number(F.floor(t.c_number(a[0]) + 0.5).cast("double"))), "RAND": lambda: t.c_typed(F.rand(), "double"),
            "NOW": lambda: t.c_typed(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"), "dateTime"),
            "YEAR": lambda: part(1), "MONTH": lambda: part(2), "DAY": lambda: part(3), "HOURS": lambda: part(4), "MINUTES": lambda: part(5),
            "SECONDS": lambda: t.c_typed(F.regexp_replace(F.regexp_extract(text[0], r"T\d\d:\d\d:([0-9.]+)", 1), "^0(?=[0-9])", ""), "decimal"), "TZ": lambda: t.c_string(zone),
            "TIMEZONE": lambda: F.when(zone == "Z", t.c_typed(F.lit("PT0S"), "dayTimeDuration")).when(zone != "", t.c_typed(self._offset(zone), "dayTimeDuration")),
            "MD5": lambda: t.c_string(F.md5(text[0])), "SHA1": lambda: t.c_string(F.sha1(text[0])), "SHA256": lambda: digest(256), "SHA384": lambda: digest(384), "SHA512": lambda: digest(512),
            "UUID": lambda: F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">")), "STRUUID": lambda: t.c_string(F.expr("uuid()")),
        }.get(name)
        if made is None:
            raise SparqlError(f"the function {name} isn't known")
        return made()

    @staticmethod
    def _concat(a: list[Column], text: list[Column]) -> Column:
        """The texts in a row; of the language that all of them have, if they have one in common."""
        if not a:
            return t.c_string(F.lit(""))
        joined, lang = F.concat(*text), t.c_lang(a[0])
        common = reduce(lambda x, y: x & y, [F.coalesce(t.c_lang(x) == lang, F.lit(False)) for x in a])
        return F.when(common, F.concat(F.lit('"'), joined, F.lit('"'), t.suffix(a[0]))).otherwise(t.c_string(joined))

    @staticmethod
    def _offset(zone: Column) -> Column:
        """The text of a duration for an offset such as -05:30; parts that are 0 are left out."""
        hours, minutes = F.substring(zone, 2, 2).try_cast("int"), F.substring(zone, 5, 2).try_cast("int")
        sign = F.when(F.startswith(zone, F.lit("-")) & (hours + minutes > 0), "-").otherwise("")
        shown = F.concat(F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(""))
        return F.concat(sign, F.lit("PT"), F.when(shown == "", "0S").otherwise(shown))

    # A group that is solved for rows of an outer solution: each row has a key, in which an unbound variable has a mark of its own. The
    # group may bind what the row leaves unbound; the key says which row it did so for.

    def _start(self, now: DataFrame, shared: list[str]) -> tuple[DataFrame, dict[str, str]]:
        """The distinct rows of ``shared``, and the column that is the key of each variable."""
        keys = {c: self.fresh("key") if c in self.maybe else c for c in shared}
        marks = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(k) for c, k in keys.items() if k != c]
        return now.select(*[F.col(f"`{c}`") for c in shared], *marks).distinct(), keys

    @staticmethod
    def _same_start(now: DataFrame, right: DataFrame, keys: dict[str, str], named: dict[str, str]) -> Column:
        # No term is empty, so that the mark of an unbound variable is like no term.
        match = [F.coalesce(now[f"`{c}`"], F.lit("")) == right[named[c]] if k != c else now[f"`{c}`"].eqNullSafe(right[named[c]]) for c, k in keys.items()]
        return reduce(lambda a, b: a & b, match)

    # Parts of expressions that need joins: EXISTS and custom functions become columns first.

    def prepare(self, now: DataFrame, e, seed: DataFrame | None):
        if isinstance(e, list):
            out = []
            for x in e:
                now, y = self.prepare(now, x, seed)
                out.append(y)
            return now, out
        if not isinstance(e, tuple) or not e or e[0] in ("var", "term", "agg"):
            return now, e
        if e[0] in ("exists", "not exists"):
            shared = sorted(variables(e[1]) & set(now.columns) | (set(seed.columns) if seed is not None else set()) & set(now.columns))
            flag = self.fresh("flag")
            start, keys = self._start(now, shared) if shared else (None, {})
            inner, _ = self.within(e[1], start, self.maybe)
            if shared:
                named = {c: f"_k{i}" for i, c in enumerate(shared)}
                found = inner.select(*[F.col(f"`{k}`").alias(named[c]) for c, k in keys.items()]).distinct().withColumn(flag, F.lit(True))
                now = now.join(found, self._same_start(now, found, keys, named), "left").drop(*named.values())
            else:
                now = now.crossJoin(F.broadcast(inner.limit(1).agg((F.count(F.lit(1)) > 0).alias(flag))))  # one row
            return now, ("flag", flag) if e[0] == "exists" else ("!", ("flag", flag))
        out = []
        for x in e[1:] if isinstance(e[0], str) else e:
            now, y = self.prepare(now, x, seed)
            out.append(y)
        e = (e[0], *out) if isinstance(e[0], str) else tuple(out)
        # Operands are used many times over: each is a column of its own, so that plans stay small.
        def named(x: tuple) -> tuple:
            nonlocal now
            if x[0] in ("var", "term", "column"):
                return x
            name = self.fresh("op")
            self.scope = set(now.columns)
            now = now.withColumn(name, self.term_of(x))
            return ("column", name)

        if e[0] in ("=", "!=", "<", ">", "<=", ">=", "+", "-", "*", "/"):
            e = (e[0], named(e[1]), named(e[2]))
        elif e[0] in ("-1", "+1"):
            e = (e[0], named(e[1]))
        elif e[0] == "fn" and e[1] in ("ABS", "CEIL", "FLOOR", "ROUND", "SUBSTR", "REPLACE", "STRBEFORE", "STRAFTER", "CONCAT", "LANG", "TIMEZONE"):
            e = (e[0], e[1], [named(x) for x in e[2]])
        if e[0] == "call" and e[1] in self.functions:
            names, q = self.functions[e[1]]
            if len(names) != len(e[2]):
                raise SparqlError(f"{e[1]} takes {len(names)} arguments")
            result, temp = self.fresh("call"), [self.fresh("arg") for _ in names]
            self.scope = set(now.columns)
            now = now.withColumns({c: self.term_of(x) for c, x in zip(temp, e[2], strict=True)})
            answers = self.call(e[1], now.select(*[F.col(c).alias(n) for c, n in zip(temp, names, strict=True)]).distinct())
            answers = answers.select(*[F.col(n).alias(f"_k{i}") for i, n in enumerate(names)], F.col("_result").alias(result))
            match = reduce(lambda a, b: a & b, [now[c].eqNullSafe(answers[f"_k{i}"]) for i, c in enumerate(temp)], F.lit(True))
            now = now.join(answers, match, "left").drop(*temp, *[f"_k{i}" for i in range(len(names))])
            return now, ("column", result)
        return now, e

    def call(self, name: str, arguments: DataFrame) -> DataFrame:
        """Arguments with ``_result``: the answer of a custom function; of several rows the least term, null if none."""
        names, q = self.functions[name]
        if isinstance(q, Hook):
            return answered(q, arguments, names)
        found = self.solve(q, arguments)
        if q.form == "ASK":
            keys = found.select(*names).distinct().withColumn("_yes", F.lit(True))
            out = arguments.join(keys.toDF(*[f"_q{i}" for i in range(len(names))], "_yes"), reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_q{i}")) for i, n in enumerate(names)], F.lit(True)), "left")
            return out.select(*names, t.c_bool(F.coalesce("_yes", F.lit(False))).alias("_result"))
        result = next(n for n, _ in q.project or [(c, None) for c in found.columns if c not in names])
        return found.groupBy(*names).agg(F.min(result).alias("_result"))

    def with_terms(self, now: DataFrame, named: dict[str, tuple], seed: DataFrame | None) -> DataFrame:
        ready = {}
        for name, e in named.items():
            now, ready[name] = self.prepare(now, e, seed)
        self.scope = set(now.columns)
        return now.withColumns({name: self.term_of(e) for name, e in ready.items()})

    def where(self, now: DataFrame, e: tuple, seed: DataFrame | None) -> DataFrame:
        before = now.columns
        now, e = self.prepare(now, e, seed)
        self.scope = set(now.columns)
        return now.where(F.coalesce(self.bool_of(e), F.lit(False))).select(*before)

    # Groups

    def unit(self) -> DataFrame:
        """The solution without variables: what is joined with it stays as it is."""
        if not hasattr(self, "_unit"):
            self._unit = self.graph.spark.range(1).select()
        return self._unit

    def join(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """Compatible solutions of both, by equal terms; a variable that may be unbound is compatible with any term then."""
        if a is self.unit():
            return b
        if b is self.unit():
            return a
        shared = [c for c in a.columns if c in b.columns]
        if not shared:
            return a.crossJoin(b)
        loose = [c for c in shared if c in self.maybe]
        if not loose:
            return a.join(b, shared)
        if len(loose) < len(shared):
            right = b.select(*[F.col(c).alias(f"_r_{c}") if c in shared else F.col(c) for c in b.columns])
            out = a.join(right, self._compatible(a, right, shared, loose))
            return out.select(*[F.coalesce(F.col(c), F.col(f"_r_{c}")).alias(c) if c in loose else F.col(c) for c in a.columns], *[c for c in b.columns if c not in shared])
        # No variable is bound for sure: rows are split by whether the first is, so that each part has a key where there is one.
        c, before = loose[0], set(self.maybe)
        bound, unbound = F.col(c).isNotNull(), F.col(c).isNull()
        self.maybe = before - {c}
        both = self.join(a.where(bound), b.where(bound))
        self.maybe = before
        parts = [both, self.join(a.where(unbound).drop(c), b), self.join(a.where(bound), b.where(unbound).drop(c))]
        return reduce(DataFrame.unionByName, [p.select(*both.columns) for p in parts])

    @staticmethod
    def _compatible(a: DataFrame, right: DataFrame, shared: list[str], loose: list[str]) -> Column:
        match = [a[c].isNull() | right[f"_r_{c}"].isNull() | (a[c] == right[f"_r_{c}"]) if c in loose else a[c] == right[f"_r_{c}"] for c in shared]
        return reduce(lambda x, y: x & y, match)

    def minus(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """The rows of ``a`` that aren't compatible with a row of ``b`` which binds a variable that they bind."""
        shared = [c for c in b.columns if c in a.columns]
        loose = [c for c in shared if c in self.maybe]
        right = b.select(*[F.col(c).alias(f"_r_{c}") for c in shared]).distinct()
        for c in shared[:1] if len(loose) < len(shared) else loose:
            # One anti join, by the variables that are bound for sure; else one for each variable that both may bind.
            sure = [x for x in loose if x != c] if len(loose) == len(shared) else loose
            a = a.join(right, self._compatible(a, right, shared, sure), "left_anti")
        return a

    def within(self, parts: list, seed: DataFrame | None, loose: set[str]) -> tuple[DataFrame, set[str]]:
        """A group's solutions from a seed whose variables ``loose`` may be unbound, and the variables that may be unbound in them."""
        before, self.maybe = self.maybe, set(loose) & set(seed.columns) if seed is not None else set()
        try:
            return self.group(parts, seed), self.maybe
        finally:
            self.maybe = before

    def meet(self, now: DataFrame, more: DataFrame, loose: set[str]) -> DataFrame:
        """``join`` with solutions in which the variables ``loose`` may be unbound. What one side binds for sure is bound from here on."""
        before, shared = self.maybe, set(now.columns) & set(more.columns)
        self.maybe = before | loose
        out = self.join(now, more)
        self.maybe = {c for c in before | loose if c not in shared or c in before & loose}
        return out

    def group(self, parts: list, seed: DataFrame | None) -> DataFrame:
        now = seed if seed is not None else self.unit()
        given = set(self.maybe)
        filters = []
        for part in parts:
            kind = part[0]
            if kind == "bgp":
                now = self.patterns(now, part[1])
            elif kind == "filter":
                filters.append(part[1])
            elif kind == "bind":
                if part[2] in now.columns:
                    raise SparqlError(f"?{part[2]} is bound already")
                now = self.with_terms(now, {part[2]: part[1]}, seed)
                now = now.select(*[c for c in now.columns if not c.startswith(("_flag", "_call", "_op"))])
                self.maybe.add(part[2])
            elif kind == "optional":
                shared = sorted(variables(part[1]) & set(now.columns) | (set(seed.columns) if seed is not None else set()))
                start, keys = self._start(now, shared) if shared else (None, {})
                inner, _ = self.within(part[1], start, self.maybe)
                new = [c for c in inner.columns if c not in now.columns and c not in keys.values()]
                if shared:
                    named = {c: f"_o_{c}" for c in shared}
                    loose = [c for c, k in keys.items() if k != c]
                    given = [F.col(f"`{c}`").alias(f"_v_{c}") for c in loose]
                    right = inner.select(*[F.col(f"`{k}`").alias(named[c]) for c, k in keys.items()], *given, *[F.col(f"`{c}`") for c in new])
                    joined = now.join(right, self._same_start(now, right, keys, named), "left")
                    now = joined.select(*[F.coalesce(F.col(f"`{c}`"), F.col(f"`_v_{c}`")).alias(c) if c in loose else F.col(f"`{c}`") for c in now.columns], *[F.col(f"`{c}`") for c in new])
                else:
                    now = now.join(inner, F.lit(True), "left")
                self.maybe |= set(new)
            elif kind == "union":
                done = [self.within(g, seed, given) for g in part[1]]
                every = {c for d, _ in done for c in d.columns}
                loose = {c for c in every if any(c not in d.columns or c in x for d, x in done)}
                now = self.meet(now, reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d for d, _ in done]), loose)
            elif kind == "minus":
                inner, loose = self.within(part[1], None, set())
                before, self.maybe = self.maybe, self.maybe | loose
                now = self.minus(now, inner)
                self.maybe = before
            elif kind == "values":
                rows = self.graph.spark.createDataFrame(part[2], ", ".join(f"`{n}` string" for n in part[1]))
                loose = {n for i, n in enumerate(part[1]) if any(r[i] is None for r in part[2])}
                now = self.meet(now, F.broadcast(rows), loose)  # as many rows as the query's text has
            elif kind == "sub":
                inner, loose = self._solve(part[1], seed, given)
                now = self.meet(now, inner, loose & set(inner.columns))
            elif kind == "graph":
                own, before = self.graph, self.quad
                if part[1] == ("var", "shapesGraph") and self.shapes is not None:
                    self.graph, self.quad = self.shapes(), None
                elif part[1][0] == "term":
                    self.graph, self.quad = own.named(part[1][1]), None
                else:  # each pattern gives the graph's name, by which the patterns are joined
                    self.quad = part[1][1]
                shapes = self.graph is not own and part[1] == ("var", "shapesGraph")
                # What the shapes say is as small as their text, and may share no more than a constant with the rest.
                inner, loose = self.within(part[2], None if shapes else seed, set() if shapes else given)
                self.graph, self.quad = own, before
                now = self.meet(now, F.broadcast(inner) if shapes else inner, loose)
        for e in filters:
            now = self.where(now, e, seed)
        return now

    def patterns(self, now: DataFrame, patterns: list[tuple]) -> DataFrame:
        todo = list(patterns)
        if self.quad is None and isinstance(self.graph, StoredGraph):
            now, todo = self.stored(now, todo)
        while todo:
            known = set(now.columns)
            # A pattern that shares a variable goes first; among those, one with more constants.
            best = max(todo, key=lambda p: (bool(variables(p) & known) or not (variables(p) or known), p[0][0] == "term", p[2][0] == "term", p[1][0] == "path"))
            todo.remove(best)
            now = self.meet(now, self.pattern(now, *best), set())  # a pattern binds all of its variables
        return now

    def stored(self, now: DataFrame, todo: list[tuple]) -> tuple[DataFrame, list[tuple]]:
        """Patterns of a stored graph that variables connect are joined by its numbers, and their solutions alone become terms. Gives the
        solutions and the patterns that are left."""
        plain = [x for x in todo if variables(x) and (x[1][0] == "var" or x[1][0] == "path" and x[1][1][0] == "pred")]
        groups: list[list[tuple]] = []
        for x in plain:
            met = [g for g in groups if variables(g) & variables(x)]
            groups = [g for g in groups if g not in met] + [[*[y for g in met for y in g], x]]
        said = lambda x: f"?{x[1]}" if x[0] == "var" else x[1][1] if x[0] == "path" else x[1]
        for g in groups:
            if len(g) > 1 and (not now.columns or variables(g) & set(now.columns)):
                now = self.meet(now, self.graph.solutions([tuple(map(said, x)) for x in g]), set())
                todo = [x for x in todo if x not in g]
        return now, todo

    def pattern(self, now: DataFrame, s: tuple, p: tuple, o: tuple) -> DataFrame:
        if self.quad is not None:
            if p[0] == "path" and p[1][0] != "pred":
                raise SparqlError("a path within GRAPH needs the graph's name")
            frame = self.graph.quads() if p[0] == "var" else self.graph.quads().where(F.col("p") == p[1][1])
        elif p[0] == "path" and p[1][0] == "pred":
            frame = self.graph.pred(p[1][1])
        elif p[0] == "path":
            if s[0] == "term":
                start = self.graph.spark.createDataFrame([(s[1],)], "f string")
            elif s[1] in now.columns:
                start = now.select(F.col(s[1]).alias("f")).distinct()
            elif o[0] == "term" or o[1] in now.columns:
                return self.pattern(now, o, ("path", ("inv", p[1])), s)
            else:
                nodes = self.graph.triples()
                start = nodes.select(F.col("s").alias("f")).unionByName(nodes.select(F.col("o").alias("f"))).distinct()
            frame = values(self.graph, start, p[1]).toDF("s", "o")
        else:
            frame = self.graph.triples()
        places = [("s", s), ("o", o)] + ([("p", p)] if p[0] == "var" else []) + ([("g", ("var", self.quad))] if self.quad is not None else [])
        out: dict[str, Column] = {}
        for column, x in places:
            if x[0] == "term":
                frame = frame.where(F.col(column) == x[1])
            elif x[1] in out:
                frame = frame.where(F.col(column) == out[x[1]])
            else:
                out[x[1]] = F.col(column)
        return frame.select(*[c.alias(n) for n, c in out.items()]).distinct()

    # Queries

    def solve(self, q: Query, seed: DataFrame | None = None) -> DataFrame:
        """Solutions of a query; those of a SELECT are projected, the seed's columns stay."""
        return self._solve(q, seed, set())[0]

    def _solve(self, q: Query, seed: DataFrame | None, loose: set[str]) -> tuple[DataFrame, set[str]]:
        """The solutions from a seed whose variables ``loose`` may be unbound, and the variables that may be unbound in them."""
        before, self.maybe = self.maybe, set(loose) & set(seed.columns) if seed is not None else set()
        try:
            return self._solved(q, seed), self.maybe
        finally:
            self.maybe = before

    def _solved(self, q: Query, seed: DataFrame | None) -> DataFrame:
        now = self.group(q.where, seed)
        kept = seed.columns if seed is not None else []
        if q.form != "SELECT":
            return now
        aggregates: dict[str, tuple] = {}

        def lift(e):
            if isinstance(e, tuple) and e and e[0] == "agg":
                name = next((n for n, x in aggregates.items() if x == e), None) or self.fresh("agg")
                aggregates[name] = e
                return ("column", name)
            return tuple(map(lift, e)) if isinstance(e, tuple) else [*map(lift, e)] if isinstance(e, list) else e

        project = [(n, lift(e) if e else None) for n, e in q.project] if q.project is not None else None
        having, order = [lift(e) for e in q.having], [(d, lift(e)) for d, e in q.order]
        if aggregates or q.group:
            extra = {n: e for n, e in q.group if e != ("var", n)}
            now = self.with_terms(now, extra, seed) if extra else now
            inner = {f"_in_{n}": e[3] for n, e in aggregates.items() if e[3] is not None}
            now = self.with_terms(now, inner, seed) if inner else now
            sums = [n for n, e in aggregates.items() if e[1] in ("SUM", "AVG")]
            now = now.withColumns({f"_n{n}": t.c_number(F.col(f"_in_{n}")) for n in sums} | {f"_x{n}": t.c_exact(F.col(f"_in_{n}")) for n in sums}) if sums else now
            keys = [*kept, *[n for n, _ in q.group if n not in kept and n in now.columns]]
            now = now.groupBy(*keys).agg(*([self._aggregate(n, e).alias(n) for n, e in aggregates.items()] or [F.count(F.lit(1)).alias("_n")]))
            for e in having:
                now = self.where(now, e, seed)
        if project is not None:
            now = self.with_terms(now, {n: e for n, e in project if e is not None}, seed) if any(e is not None for _, e in project) else now
        for i, (_, e) in enumerate(order):
            now = self.with_terms(now, {f"_order{i}": e}, seed)
        rank = lambda c: F.when(c.isNull(), 0).when(t.c_is_blank(c), 1).when(t.c_is_iri(c), 2).otherwise(3)
        sorts = []
        for i, (down, _) in enumerate(order):
            c = F.col(f"_order{i}")
            sorts += [x.desc() if down else x.asc() for x in (rank(c), t.c_number(c), t.c_text(c))]
        names = [n for n, _ in project] if project is not None else [c for c in now.columns if not c.startswith("_")]
        if project is not None:
            self.maybe |= {n for n, e in project if e is not None} | {n for n in names if n not in now.columns}
        by = [f"_order{i}" for i in range(len(order))]
        shown = list(dict.fromkeys([*kept, *names]))
        now = now.select(*[F.col(f"`{n}`") if n in now.columns else _null().alias(n) for n in shown], *by)
        if q.distinct and by:  # of equal rows the one that comes first stays
            row = F.row_number().over(Window.partitionBy(*[F.col(f"`{n}`") for n in shown]).orderBy(*sorts))
            now = now.withColumn("_row", row).where("_row = 1").drop("_row") if any(variables(e) - set(shown) for _, e in order) else now.distinct()
        elif q.distinct:
            now = now.distinct()
        rest = [F.col(f"`{n}`") for n in shown if n not in kept]
        if kept and (q.limit is not None or q.offset):  # a limit holds for each pre-bound row
            row = F.row_number().over(Window.partitionBy(*kept).orderBy(*(sorts + rest or [F.lit(1)])))
            low, high = q.offset, q.offset + (q.limit if q.limit is not None else 1 << 31)
            return now.withColumn("_row", row).where((F.col("_row") > low) & (F.col("_row") <= high)).drop("_row", *by)
        # Rows that the order leaves open are cut by their terms, so that a limit gives the same rows in every run.
        now = now.orderBy(*sorts, *(rest if q.limit is not None or q.offset else [])) if sorts else now
        now = now.offset(q.offset) if q.offset else now
        now = now.limit(q.limit) if q.limit is not None else now
        return now.drop(*by) if by and q is not self.keep_order else now

    def _aggregate(self, name: str, e: tuple) -> Column:
        _, what, distinct, inner, sep = e
        c = F.col(f"_in_{name}") if inner is not None else F.lit(1)
        n = t.c_number(c) if inner is not None else None
        if what == "COUNT":
            return t.c_typed(F.count_distinct(c) if distinct else F.count(c), "integer")
        if what in ("MIN", "MAX"):
            pick = F.min if what == "MIN" else F.max
            return pick(F.struct(n.alias("n"), c.alias("c")))["c"]
        if what == "SAMPLE":
            return F.min(c)
        if what == "GROUP_CONCAT":
            texts = F.collect_set(t.c_text(c)) if distinct else F.collect_list(t.c_text(c))
            return t.c_string(F.array_join(F.array_sort(texts), sep))
        # Integers and decimals are summed as decimals: no rounding, and no dependence on the order of the rows.
        whole, exact = (F.bool_and(t.c_local_type(c).isin(*names)) for names in (t.INTEGERS, t.EXACT))
        mode = "DISTINCT " if distinct else ""
        over = lambda column, function: F.expr(f"{function}({mode}{column})")
        total = over(f"`_x{name}`", "try_sum")
        if what == "SUM":
            return F.when(whole, t.c_typed(total.cast("decimal(38,0)"), "integer")).when(exact & total.isNotNull(), t.c_typed(_plain(total), "decimal")).otherwise(t.c_typed(over(f"`_n{name}`", "sum"), "double"))
        mean = over(f"`_x{name}`", "try_avg")
        return F.when(exact & mean.isNotNull(), t.c_typed(_plain(mean), "decimal")).otherwise(t.c_typed(over(f"`_n{name}`", "avg"), "double"))

    def construct(self, q: Query, seed: DataFrame | None = None) -> DataFrame:
        """Distinct (s, p, o) of the template; parts with unbound variables or literal subjects are left out."""
        found = self.solve(q, seed)
        self.scope = set(found.columns)
        value = lambda x: self.term_of(x) if x[0] != "path" else F.lit(x[1][1])
        rows = F.array(*[F.struct(value(s).alias("s"), value(p).alias("p"), value(o).alias("o")) for s, p, o in q.template])
        out = found.select(F.explode(rows).alias("x")).select("x.*").where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL")
        return out.where(~F.startswith("s", F.lit('"')) & F.startswith("p", F.lit("<"))).distinct()
