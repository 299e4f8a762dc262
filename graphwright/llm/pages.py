"""Main text of web pages by template deduction with equivalence classes.

* *Tokens.* A page's tokens are the paths of its block elements (names, classes, ids) and its pieces of text with the
  path above each.
* *Occurrence vectors.* A token's vector has its number of occurrences on every page of the host. Vectors
  aren't gathered: each page adds a hash of (page, number) to a sum by (host, token), so equal sums mean
  equal vectors. Tokens of one host with one sum are an equivalence class.
* *Template.* A class is valid if it has a page count of at least half the host's pages and its tokens occur
  once a page. Valid classes nest by the paths of their tokens: a text token of a valid class is template text, and
  so is all text below a container of a valid class whose text is the same on all its pages; a digest of
  the text is summed up with the vectors. Below an article or main element a token is part of the template only if it is in
  that element's own class, so on every page that has the element, of ARTICLE_PAGES at least: an article may
  share passages with others. Every page also takes the template of all hosts together, which has containers only.
* *Extraction.* What the template leaves are slots. Those in a page's article and main elements are its text; without
  such elements, all slots are. Where most of the article's text is template, it is an article with copies, which is kept
  whole, or a teaser: the longer one of it and the other slots is taken. Menus, forms, adverts and other asides
  go from all (``html_blocks`` says how they are told: by kind, or by a whole name, and never if an article is within); nothing else does.

All steps are aggregates over all pages with partial sums before any shuffle, so a host with a third of
all pages is summed on the map side. Templates are broadcast to the pages if they are few, else joined by host.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .html_blocks import CONTAINERS, blocks
from .settle import drop_settled, settle, small_batches

LEAST_PAGES, SUPPORT, ARTICLE_PAGES = 3, 0.5, 5
#: So many hosts, or template tokens of so many hosts and tokens in all, are broadcast.
FEW_TOKENS = 200_000
ALL = "*"
#: Stands between path and digest of a text token; no path has white space.
TEXT = "\n"


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1), F.lit("")))


def _in_article(path: tuple[str, ...]) -> bool:
    return any(x.split(".", 1)[0] in ("article", "main") for x in path)


def _article_of(path: tuple[str, ...]) -> str | None:
    """The token of the outermost article or main element of a path."""
    return next(("/".join(path[: i + 1]) for i in range(len(path)) if path[i].split(".", 1)[0] in ("article", "main")), None)


def text_token(path: tuple[str, ...], text: str) -> str:
    """The token of a piece of text: its path and a digest, so that tokens are short however long the text is."""
    return "/".join(path) + TEXT + blake2b(text.encode("utf-8", "replace"), digest_size=16).hexdigest()


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, token, the article element that it is or is below, seen times, digest of the text below it or null) of each page."""
    for batch in batches:
        hosts, tokens, articles, times, digests, pages = [], [], [], [], [], []
        for nth, (host, page) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            seen: Counter[str] = Counter()
            below: dict[str, int] = {}
            within: dict[str, str | None] = {}
            last: tuple[str, ...] = ()
            names: dict[tuple[str, ...], list[tuple[int, str]]] = {}
            heads: dict[tuple[str, ...], str | None] = {}
            for path, aside, text, _ in blocks(page or ""):
                same = 0
                while same < min(len(path), len(last)) and path[same] == last[same]:
                    same += 1
                if path not in names:
                    names[path] = [(i, "/".join(path[: i + 1])) for i in range(len(path)) if path[i].split(".", 1)[0] in CONTAINERS]
                    heads[path] = _article_of(path)
                    for i, token in names[path]:
                        within[token] = _article_of(path[: i + 1])
                data = b"" if aside else text.encode("utf-8", "replace") + b"\n"
                if not aside:
                    seen[token := text_token(path, text)] += 1
                    within[token] = heads[path]
                for i, token in names[path]:
                    seen[token] += i >= same
                    if data:
                        below[token] = zlib.crc32(data, below.get(token, 0))
                last = path
            for token in seen:
                hosts.append(host)
                tokens.append(token)
                articles.append(within[token])
                times.append(seen[token])
                digests.append(below.get(token))
                pages.append(nth)
        yield pa.RecordBatch.from_pydict(
            {"host": pa.array(hosts, pa.string()), "token": pa.array(tokens, pa.string()), "article": pa.array(articles, pa.string()), "times": pa.array(times, pa.int32()),
             "digest": pa.array(digests, pa.int64()), "page": batch.column(2).take(pa.array(pages, pa.int64()))}
        )


def templates(pages: DataFrame) -> DataFrame:
    """(host, template, pages): the tokens of template text of each host with LEAST_PAGES pages, and of all hosts as ``*``.

    ``pages`` has url and html. Hosts without template text have no row.
    """
    keyed = pages.select(host_of(F.col("url")).alias("host"), "html", F.xxhash64("url", "html").alias("page"))
    found = keyed.mapInArrow(_tokens, "host string, token string, article string, times int, digest long, page long")
    both = found.withColumn("host", F.explode(F.when(F.contains("token", F.lit(TEXT)), F.array("host")).otherwise(F.array("host", F.lit(ALL)))))
    # Sums of 64-bit hashes go into decimals, which don't overflow.
    vector = F.sum(F.xxhash64("page", "times").cast("decimal(38,0)"))
    sums = settle(both.groupBy("host", "token").agg(vector.alias("vector"), F.min("article").alias("article"), F.count(F.lit(1)).alias("pages"), F.count("digest").alias("told"), F.max("times").alias("most"), F.min("digest").alias("low"), F.max("digest").alias("high")))
    whole = sums.groupBy("host").agg(F.max("pages").alias("host_pages")).where(F.col("host_pages") >= LEAST_PAGES)
    if whole.count() <= FEW_TOKENS:
        whole = F.broadcast(whole)
    valid = sums.join(whole, "host").where((F.col("pages") >= SUPPORT * F.col("host_pages")) & (F.col("most") == 1))
    fixed = F.contains("token", F.lit(TEXT)) | ((F.col("told") == F.col("pages")) & (F.col("low") == F.col("high")))
    # Equal vectors have equal numbers of pages, so a class is valid as a whole.
    classes = valid.groupBy("host", "vector").agg(F.max("pages").alias("pages"), F.max("host_pages").alias("host_pages"), F.collect_list(F.when(F.col("token") == F.col("article"), F.col("token"))).alias("heads"), F.collect_list(F.when(fixed, F.struct("token", "article"))).alias("members"))
    nested = F.filter("members", lambda m: m["article"].isNull() | (m["article"] == m["token"]) | ((F.col("pages") >= ARTICLE_PAGES) & F.array_contains("heads", m["article"])))
    named = classes.select("host", "host_pages", F.transform(nested, lambda m: m["token"]).alias("tokens")).where(F.size("tokens") > 0)
    found = settle(named.groupBy("host").agg(F.array_sort(F.flatten(F.collect_list("tokens"))).alias("template"), F.max("host_pages").alias("pages")))
    drop_settled(sums)
    return found


def text_in(page: str | None, template: list[str]) -> str:
    """The text in the page's slots, which is all but the template's tokens and what is below them: that of the slots in article and
    main elements, or of all slots. Asides never count."""
    found = [(path, text) for path, aside, text, _ in blocks(page or "") if not aside]
    fixed = set(template)
    paths: dict[tuple[str, ...], bool] = {}
    article: list[str] = []
    inner: list[str] = []
    outer: list[str] = []
    for path, text in found:
        if path not in paths:
            paths[path] = any("/".join(path[: i + 1]) in fixed for i in range(len(path)))
        slot, inside = not paths[path] and text_token(path, text) not in fixed, _in_article(path)
        if inside:
            article.append(text)
        if slot:
            (inner if inside else outer).append(text)
    if inner and 2 * sum(map(len, inner)) >= sum(map(len, article)):
        return " ".join(inner)
    # Without an article, or with one that is mostly template: copies of one, or a teaser.
    return " ".join(max(article, outer, key=lambda texts: sum(map(len, texts))) or [text for _, text in found])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``pages`` with ``main_text`` string: the page's article. Needs columns url and html; others pass through,
    a ``main_text`` is replaced.

    A null or empty html gives an empty text; a null url counts as a host of its own name "". Repeated
    rows give repeated rows and count as so many pages with one vector entry each.
    """
    small_batches(pages.sparkSession)
    kept = [c for c in pages.columns if c != "main_text"]
    pages = pages.select(*[F.col(f"`{c}`") for c in kept])
    found = templates(pages)
    general = [token for r in found.where(F.col("host") == ALL).collect() for token in r["template"]]
    own = found.where(F.col("host") != ALL).select(F.col("host").alias("__host2"), F.col("template").alias("__template"))
    if (own.agg(F.sum(F.size("__template") + 1)).first()[0] or 0) <= FEW_TOKENS:
        own = F.broadcast(own)
    joined = pages.withColumn("__host", host_of(F.col("url"))).join(own, F.col("__host") == F.col("__host2"), "left").drop("__host", "__host2")
    place, schema = kept.index("html"), T.StructType([*pages.schema.fields, T.StructField("main_text", T.StringType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_in(p, [*(s or []), *general]) for p, s in zip(batch.column(place).to_pylist(), batch.column(len(kept)).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*kept, "main_text"])

    return joined.mapInArrow(rows, schema)


def op10_pages(spark, sf_dir: str) -> DataFrame:
    """Main text of every one of ``pages``."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    out = extract_main_text(pages)
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
