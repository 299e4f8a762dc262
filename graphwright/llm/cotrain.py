"""Quality classifier by co-training: a view of the text and a view of the page's metadata teach each other.

* *Text view*: the words of the whole text, as shares of hashed buckets, and the shape of the text.
* *Metadata view*: source, language and the stated length.

Each view is a logistic model. In every round both are fitted on the labelled rows and on the rows that the
other view is sure of (pseudo-labels, at ``PSEUDO_WEIGHT``). A view's scores are calibrated by a line through its log
odds, fitted on labelled rows that were held out of all rounds (``FOLD`` of 5), before they make
pseudo-labels and at the end, when the calibrated log odds are combined by a small logistic model.

Features are computed once, into a narrow table. All fitting is Newton steps whose sums (a matrix of
fixed size for each task) come from a pass over that whole table: no sample of labelled or unlabelled
rows is taken, sums are added up in the cluster, and the driver sees their total only. A row's pseudo-label depends on the other view's last
weights alone, so it is computed in the pass and never stored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .settle import settle, small_batches
from .textvec import mix, runs, words_of

ROUNDS, STEPS, FOLD = 3, 3, 5
#: The sums of so many tasks are added up first.
TASKS = 64
LONGEST_STEP = 4.0
SURE, PSEUDO_WEIGHT, RIDGE, LINE_RIDGE = 0.9, 0.3, 1.0, 0.1
SOURCE_BUCKETS, LANG_BUCKETS = 64, 16
WORD_BUCKETS = 64
SHAPE_FEATURES, META_DENSE = 16, 4
TEXT_FEATURES = SHAPE_FEATURES + WORD_BUCKETS
META_FEATURES = META_DENSE + SOURCE_BUCKETS + LANG_BUCKETS

_SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()-]+")
_UPPER = re.compile(r"[A-Z]+")
_DIGIT = re.compile(r"[0-9]+")


def text_features(text: str | None) -> list[float]:
    """Shape of a whole text: sizes, shares of kinds of characters, repetition of words and lines."""
    text = text or ""
    n = max(1, len(text))
    words = text.split()
    w = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    line = max(1, len(lines))
    share = lambda pattern: sum(map(len, pattern.findall(text))) / n
    return [
        1.0,
        math.log1p(len(text)) / 10,
        n / w / 10,
        min(3.0, math.sqrt(share(_SYMBOL) * 10)),
        share(_UPPER) * 4,
        share(_DIGIT) * 10,
        len(counts) / w,
        max(counts.values(), default=0) / w,
        sum(x == "|" or len(x) == 1 for x in words) / w,
        len(set(lines)) / line,
        sum(x.rstrip().endswith((".", "!", "?", ":")) for x in lines) / line,
        math.log1p(w / line) / 5,
        text.count(",") / w * 5,
        text.count(".") / w * 5,
        text.count("!") / w * 3,
        1.0 if not words else 0.0,
    ]


def word_features(texts: list[str | None]) -> np.ndarray:
    """For each text the square roots of its words' shares in WORD_BUCKETS hashed buckets."""
    out = np.zeros((len(texts), WORD_BUCKETS))
    for first, some in runs([(t or "").encode("utf-8", "replace") for t in texts]):
        words, begins = words_of(some)
        owner = np.repeat(np.arange(len(some)), np.diff(begins))
        bucket = (mix(words) >> np.uint64(40)).astype(np.int64) % WORD_BUCKETS
        counts = np.bincount(owner * WORD_BUCKETS + bucket, minlength=len(some) * WORD_BUCKETS).reshape(len(some), WORD_BUCKETS)
        out[first : first + len(some)] = np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        shape = np.array([text_features(t) for t in texts]).reshape(-1, SHAPE_FEATURES)
        both = np.concatenate([shape, word_features(texts)], 1).astype(np.float32)
        ends = pa.array(np.arange(len(texts) + 1) * TEXT_FEATURES, pa.int32())
        chars = [0 if c is None else max(0, c) for c in batch.column("n_chars").to_pylist()]
        dense = [[1.0, math.log1p(c) / 10, (math.log1p(c) / 10) ** 2, float(c < 50)] for c in chars]
        kind = pa.list_(pa.float32())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.ListArray.from_arrays(ends, pa.array(both.ravel())), pa.array(dense, kind), batch.column("source"), batch.column("lang"), batch.column("label")], names=["doc_id", "t", "m", "source", "lang", "label"]
        )


def _matrices(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    t = np.stack(batch.column("t").to_numpy(zero_copy_only=False)).astype(float).reshape(-1, TEXT_FEATURES)
    m = np.zeros((len(t), META_FEATURES))
    m[:, :META_DENSE] = np.stack(batch.column("m").to_numpy(zero_copy_only=False))
    at = np.arange(len(t))
    m[at, META_DENSE + batch.column("source").to_numpy()] = 1
    m[at, META_DENSE + SOURCE_BUCKETS + batch.column("lang").to_numpy()] = 1
    return t, m


def _p(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _added(partial: DataFrame) -> np.ndarray:
    """The sum of the rows' arrays (``sums``); empty without rows. Rows, one a task, are added up in groups of tasks, and what is
    left place by place: the driver gets one number for each place, however many tasks there are."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in batch.column("sums"):
                x = row.values.to_numpy()
                total = x.copy() if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tolist()], pa.list_(pa.float64()))})

    grouped = partial.withColumn("tasks", F.floor(F.spark_partition_id() / TASKS)).repartition("tasks").select("sums").mapInArrow(add, "sums array<double>")
    places = grouped.select(F.posexplode("sums").alias("place", "x")).groupBy("place").agg(F.sum("x").alias("x"))
    return np.array([r["x"] for r in sorted(places.collect(), key=lambda r: r["place"])])


def _newton(table: DataFrame, models: list[tuple[Callable, np.ndarray, float]]) -> list[np.ndarray]:
    """One Newton step of some ridge logistic models (rows, weights, ridge) in one pass. ``rows(batch)`` gives (features, target, weight)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [(np.zeros((len(w), len(w))), np.zeros(len(w))) for _, w, _ in models]
        for batch in batches:
            if batch.num_rows:
                for (hessian, gradient), (rows, w, _) in zip(totals, models, strict=True):
                    x, y, weight = rows(batch)
                    p = _p(x @ w)
                    hessian += (x * (weight * p * (1 - p))[:, None]).T @ x
                    gradient += x.T @ (weight * (y - p))
        yield pa.RecordBatch.from_pydict({"sums": pa.array([np.concatenate([np.append(h.ravel(), g) for h, g in totals]).tolist()], pa.list_(pa.float64()))})

    got = _added(table.mapInArrow(sums, "sums array<double>"))
    out, at = [], 0
    for _, w, ridge in models:
        n = len(w)
        if not len(got):
            out.append(w)
            continue
        hessian = got[at : at + n * n].reshape(n, n) + ridge * np.eye(n)
        gradient = got[at + n * n : at + n * n + n]
        # A step of bounded size, as a full one may overshoot where nearly all rows are sure.
        move = np.linalg.solve(hessian, gradient - ridge * w)
        out.append(w + move * min(1.0, LONGEST_STEP / max(1e-12, float(np.abs(move).max()))))
        at += n * n + n
    return out


def _rows_for(view: int, other: np.ndarray | None, line: np.ndarray | None) -> Callable:
    """Rows that teach a view: labelled ones outside the held-out fold, and those the other view, calibrated by ``line``, is sure of."""

    def rows(batch: pa.RecordBatch):
        both = _matrices(batch)
        label = batch.column("label").to_numpy(zero_copy_only=False).astype(float)  # 0, 1; -1 none; -2 held out
        weight = (label >= 0).astype(float)
        y = np.maximum(label, 0)
        if other is not None:
            p = _p(line[0] + line[1] * (both[1 - view] @ other))
            taught = (label == -1) & ((p >= SURE) | (p <= 1 - SURE))
            weight[taught], y[taught] = PSEUDO_WEIGHT, p[taught] >= 0.5
        return both[view], y, weight

    return rows


def _held_out(features: Callable) -> Callable:
    """Held-out rows with ``features(text log odds, metadata log odds)``, by the views' weights."""

    def rows(batch: pa.RecordBatch):
        truth = batch.column("truth").to_numpy(zero_copy_only=False).astype(float)
        return features(*_matrices(batch)), np.maximum(truth, 0), (truth >= 0).astype(float)

    return rows


def _line_of(view: int, w: np.ndarray) -> Callable:
    return _held_out(lambda *both: np.stack([np.ones(len(both[view])), both[view] @ w], 1))


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, text_score, meta_score, score, keep): calibrated probabilities of good quality for every row of ``docs``.

    ``docs`` has doc_id, text, lang, source, n_chars; ``labels`` has doc_id and ``label`` 0 or 1. Nulls in any of
    them count as empty, as a bucket of their own or as no label; of several labels of a document the
    highest counts. Repeated rows are scored each. Without labels all scores are 0.5. ``keep`` is score >= 0.5.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).withColumnRenamed("doc_id", "__id")
    bucket = lambda c, n: F.pmod(F.xxhash64(F.coalesce(F.col(c), F.lit(""))), F.lit(n)).cast("int").alias(c)
    small_batches(docs.sparkSession)
    narrow = docs.select("doc_id", "text", "n_chars", bucket("source", SOURCE_BUCKETS), bucket("lang", LANG_BUCKETS), F.lit(-1).alias("label"))
    table = narrow.mapInArrow(_features, "doc_id long, t array<float>, m array<float>, source int, lang int, label int").drop("label")
    labelled = table.join(known, table["doc_id"] == known["__id"], "left").drop("__id").withColumn("truth", F.coalesce("label", F.lit(-1)))
    held = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(FOLD)) == 0
    table = settle(labelled.withColumn("label", F.when(F.col("truth") < 0, -1).when(held, -2).otherwise(F.col("truth"))).withColumn("truth", F.when(held, F.col("truth")).otherwise(-1)))

    views = [np.zeros(TEXT_FEATURES), np.zeros(META_FEATURES)]
    lines = [np.array([0.0, 1.0]), np.array([0.0, 1.0])]
    for turn in range(ROUNDS):
        before = [(None, None)] * 2 if turn == 0 else list(zip(views, lines, strict=True))
        for _ in range(STEPS):
            views = _newton(table, [(_rows_for(v, *before[1 - v]), views[v], RIDGE) for v in (0, 1)])
        for _ in range(STEPS):
            lines = _newton(table, [(_line_of(v, views[v]), lines[v], LINE_RIDGE) for v in (0, 1)])
    text, meta = views
    odds = lambda t, m: (lines[0][0] + lines[0][1] * (t @ text), lines[1][0] + lines[1][1] * (m @ meta))
    mixed = np.array([0.0, 0.5, 0.5])
    for _ in range(STEPS):
        (mixed,) = _newton(table, [(_held_out(lambda t, m: np.stack([np.ones(len(t)), *odds(t, m)], 1)), mixed, LINE_RIDGE)])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, two = odds(*_matrices(batch))
                out = {"doc_id": batch.column("doc_id"), "text_score": _p(one), "meta_score": _p(two), "score": _p(mixed[0] + mixed[1] * one + mixed[2] * two)}
                yield pa.RecordBatch.from_pydict(out)

    return table.mapInArrow(scored, "doc_id long, text_score double, meta_score double, score double").withColumn("keep", F.col("score") >= 0.5)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    """Scores of both views and their combination for all ``documents``."""
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
