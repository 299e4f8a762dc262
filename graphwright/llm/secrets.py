"""Secret scan over a trigram inverted index, in DataFrame functions only.

1. *Index*: each text is lower-cased and gives one posting (trigram, key) for every trigram that some
   rule's Boolean query names. Trigrams that no query asks for are never looked up, so their posting
   lists aren't built.
2. *Query*: postings meet the rules' clauses (a table of a few dozen fixed rows, broadcast). Grouped by
   (key, rule, clause), the bits of the trigrams found are or-ed; a full mask is the intersection of
   the clause's lists. No group is by trigram, so a trigram in every text makes no large group.
3. *Verify*: candidates are joined to their texts by key, and the regex itself decides. A rule without
   mandatory trigrams (a bare run of hex digits) scans every text.

The key is a hash of the row's id and text. Two rows with one key share their candidate rules, which
verification then decides, so neither repeated rows, null ids nor hash collisions change a result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .trigrams import trigram_query


@dataclass(frozen=True)
class Rule:
    """``least``: of group ``group`` so many characters are needed, else the match is dropped."""

    kind: str
    pattern: str
    any_case: bool = False
    group: int = 0
    least: int = 1
    base: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.any_case else "") + self.pattern


#: The base patterns are those of the query's contract.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", least=20, base=True),
    Rule("hex", r"[0-9a-f]+", least=24, base=True),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE_RULES + MORE_RULES

#: Entries of an array that are folded at once.
CHUNK = 256
KEY, TEXT, FOUND, SPANS = "__key", "__text", "__found", "__spans"


def _clauses(rules: tuple[Rule, ...]) -> list[tuple[str, int, str, int, int]]:
    """Rows (rule, clause, trigram, bit, full mask); rules without a query have none."""
    rows = []
    for rule in rules:
        for n, clause in enumerate(sorted(map(sorted, trigram_query(rule.pattern) or ()))):
            rows += [(rule.kind, n, t, 1 << i, (1 << len(clause)) - 1) for i, t in enumerate(clause)]
    return rows


def candidates(keyed: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, rules whose trigram query the text fulfils), at least one rule a row."""
    spark = keyed.sparkSession
    rows = _clauses(rules)
    asked = sorted({r[2] for r in rows})
    low = F.col("__low")
    postings = (
        keyed.select(KEY, F.lower(TEXT).alias("__low"))
        .select(KEY, F.explode(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in asked]))).alias("trigram"))
    )
    clauses = spark.createDataFrame(rows, "rule string, clause int, trigram string, bit int, mask int")
    met = (
        postings.join(F.broadcast(clauses), "trigram")
        .groupBy(KEY, "rule", "clause", "mask")
        .agg(F.bit_or("bit").alias("have"))
        .where("have = mask")
    )
    return met.groupBy(KEY).agg(F.collect_set("rule").alias(FOUND))


def _folded(entries: Column, start: Column, step, kind: str) -> Column:
    """(at, out): a fold of ``step(at, entry)``, which gives (at, new entries of ``out``). Entries are folded CHUNK by CHUNK, as an array
    that grows is copied with each entry: the work is in proportion to their number."""
    none = F.array().cast(f"array<{kind}>")

    def one(at: Column, chunk: Column) -> Column:
        begin = F.struct(at.alias("at"), none.alias("out"))
        return F.aggregate(chunk, begin, lambda a, x: F.element_at(F.transform(F.array(step(a["at"], x)), lambda y: F.struct(y["at"].alias("at"), F.concat(a["out"], y["new"]).alias("out"))), 1))

    def all_chunks(a, first):
        done = F.transform(F.array(one(a["at"], F.slice(entries, first, F.lit(CHUNK)))), lambda y: F.struct(y["at"].alias("at"), F.concat(a["out"], F.array(y["out"])).alias("out")))
        return F.element_at(done, 1)

    firsts = F.when(F.size(entries) > 0, F.sequence(F.lit(1), F.size(entries), F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
    begin = F.struct(start.alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.aggregate(firsts, begin, all_chunks, lambda a: F.struct(a["at"].alias("at"), F.flatten(a["out"]).alias("out")))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, end, kind) of the rule's matches. The texts between matches, which
    ``split`` gives, and the matches themselves have the lengths that add up to the positions."""
    pattern = _strict(rule)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = whole if rule.group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group))
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
    parts = F.arrays_zip(
        F.transform(between, F.length).alias("gap"), F.transform(whole, F.length).alias("own"), F.transform(judged, F.length).alias("judged")
    )
    placed = _folded(
        parts,
        F.lit(0),
        lambda at, x: F.struct(
            (at + x["gap"] + x["own"]).alias("at"),
            F.array(F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["own"]).alias("end"), x["judged"].alias("judged"))).alias("new"),
        ),
        "struct<start:int,end:int,judged:int>",
    )["out"]
    return F.transform(
        F.filter(placed, lambda x: x["judged"] >= rule.least),
        lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), x["end"].alias("end"), F.lit(rule.kind).alias("kind")),
    )


def _strict(rule: Rule) -> str:
    """The pattern with the least length in its quantifier, where it is a run of one class: its matches are
    the long enough ones of the whole runs. Other patterns stay, as a match that is dropped for its
    length still takes its place."""
    return rule.java[:-1] + "{%d,}" % rule.least if rule.java.endswith("]+") and rule.java.startswith("[") else rule.java


def find_secrets(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with a column ``__spans``: array of (start, order, end, kind), sorted by start and then
    by the rule's place in ``rules``; positions in code points, end exclusive.

    A null text counts as empty and has no spans. Every input row gives one output row, repeated rows
    too; other columns, whatever their names, pass through.
    """
    keyed = docs.withColumn(TEXT, F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    keyed = keyed.withColumn(KEY, F.xxhash64(TEXT, F.length(TEXT), *[F.col(f"`{c}`") for c in docs.columns if c == "doc_id"]))
    asked = {r[0] for r in _clauses(rules)}
    found = candidates(keyed, rules).withColumnRenamed(KEY, "__key2")
    joined = keyed.join(found, keyed[KEY] == found["__key2"], "left")
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    by_rule = [
        F.when(F.array_contains(FOUND, rule.kind) if rule.kind in asked else F.rlike(TEXT, F.lit(_strict(rule))), _spans(F.col(TEXT), rule, n)).otherwise(none)
        for n, rule in enumerate(rules)
    ]
    return joined.withColumn(SPANS, F.array_sort(F.concat(*by_rule))).drop(KEY, "__key2", TEXT, FOUND)


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every span replaced by ``mark``; overlapping spans by one mark. Null texts stay null."""
    found = find_secrets(docs, text_col, rules)
    text = F.col(f"`{text_col}`")
    # The text before each span and a mark, or nothing where the span begins within the one before.
    pieces = _folded(
        F.col(SPANS),
        F.lit(0),
        lambda at, x: F.struct(
            F.greatest(at, x["end"]).alias("at"),
            F.when(x["start"] >= at, F.array(F.substring(text, at + 1, x["start"] - at), F.lit(mark))).otherwise(F.array().cast("array<string>")).alias("new"),
        ),
        "string",
    )
    cut = F.element_at(F.transform(F.array(pieces), lambda p: F.concat(F.array_join(p["out"], ""), F.substring(text, p["at"] + 1, F.length(text)))), 1)
    return found.withColumn(text_col, F.when(F.size(SPANS) > 0, cut).otherwise(text)).drop(SPANS)


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    """Digest of the scan of ``documents``: counts of base kinds, hash of base spans, all spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_secrets(docs)
    base = [r.kind for r in RULES if r.base]
    count = lambda test: F.size(F.filter(SPANS, test)).cast("long")
    of_kind = lambda k: lambda x: x["kind"] == k
    return found.select(
        "doc_id",
        *[count(of_kind(k)).alias(f"n_{k}") for k in base],
        count(lambda x: ~x["kind"].isin(base)).alias("n_other"),
        F.sha2(joined_spans(F.filter(SPANS, lambda x: x["kind"].isin(base))), 256).alias("base_sha256"),
        joined_spans(F.col(SPANS)).alias("spans"),
    )


def _sql_literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def op2_sql() -> str:
    """The scan without an index: every pattern over every text."""
    found, lists = [], []
    for n, rule in enumerate(RULES):
        p = _sql_literal(_strict(rule))
        found.append(f"regexp_extract_all(t, {p}) AS m{n}, regexp_extract_all(t, {p}, {rule.group}) AS j{n}, CASE WHEN regexp_matches(t, {p}) THEN string_split_regex(t, {p}) ELSE [] END AS p{n}")
        lists.append(
            f"list_filter(list_transform(range(1, len(m{n}) + 1), lambda i: {{"
            f"'s': list_sum(list_transform(p{n}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m{n}[1:i-1], lambda x: length(x))), 0), "
            f"'n': {n}, 'l': length(m{n}[i]), 'j': length(j{n}[i]), 'k': '{rule.kind}'}}), lambda x: x.j >= {rule.least})"
        )
    join = lambda test: f"coalesce(list_aggregate(list_transform(list_filter(a, lambda x: {test}), lambda x: x.k || ':' || x.s::BIGINT || ':' || (x.s + x.l)::BIGINT), 'string_agg', ','), '')"
    return (
        "WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t FROM documents), "
        f"m AS MATERIALIZED (SELECT doc_id, {', '.join(found)} FROM d), "
        f"f AS MATERIALIZED (SELECT doc_id, list_sort({reduce(lambda a, b: f'list_concat({a}, {b})', lists)}) AS a FROM m) "
        "SELECT doc_id, "
        + ", ".join(f"len(list_filter(a, lambda x: x.k = '{r.kind}'))::BIGINT AS n_{r.kind}" for r in RULES if r.base)
        + ", len(list_filter(a, lambda x: x.n > 2))::BIGINT AS n_other, "
        + f"sha256({join('x.n <= 2')}) AS base_sha256, {join('true')} AS spans FROM f"
    )
