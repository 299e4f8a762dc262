"""Hard negatives by a vantage-point tree over norm-augmented vectors.

Every vector x gets one more component, sqrt(M - |x|^2), where M is the greatest squared norm of the table; an anchor q gets
0 there. Then |q - x|^2 = |q|^2 + M - 2 q.x: a higher score is a smaller distance, and scores from a to b are an annulus
about the anchor. So the rows wanted for (anchor, positive) are the nearest ones of another label within an annulus.

* *Cells.* A tree of vantage points, made of SAMPLE rows at most, deals all rows into cells by their distance to the points on the
  way down; a cell of more than BLOCK rows is dealt into blocks. A request goes only to the cells that its annulus may meet, by the
  triangle inequality.
* *Within a block* the tree goes on over all rows of it, halved by distance to a vantage point each time. All requests of a block walk it at
  once: each goes through the leaves by the least distance that their rows can have, nearest first, leaves inside of the annulus or beyond it
  left out, and ends when its next leaf is farther than the k-th best row that it found. Requests that are at the same leaf are scored by one product.
* *Whole results.* Each block answers with its k best, one window joins them. First every request asks the cell that it lies in; the
  k-th score found there goes along to all other cells as the annulus' new outer edge.

Distances are doubles, scores of whole numbers are exact, so bounds are widened by a relative SLACK; what is returned is decided by the
scores alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .settle import settle
from .topk import valid_vectors

#: Rows of a block at most, about (they are dealt by a hash), and requests that meet one at once. Small tables are cut into PARTS cells.
BLOCK, REQUESTS, PARTS, LEAST_BLOCK = 16_384, 8_192, 32, 1_024
#: Rows that the vantage points of the cells are chosen from, those of the smallest hashes, and cells at most.
SAMPLE, CELLS = 16_384, 1_024
#: Rows of a leaf of a block's tree, at most.
LEAF = 256
SLACK = 1e-9


def _stack(vectors: pd.Series, size: int) -> np.ndarray:
    """Vectors as rows of ``size`` components; shorter ones are filled up with zeros."""
    out = np.zeros((len(vectors), size))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _augmented(x: np.ndarray, most: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(0.0, most - (x * x).sum(1)))])


def _distances(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - to) ** 2).sum(1))


class Cells:
    """The tree above the cells: inner nodes hold a vantage point and a distance, leaves the number of a cell."""

    def __init__(self, sample: np.ndarray, cells: int, rng: np.random.Generator):
        self.nodes: list[tuple] = []  # (point, distance, near, far) or (cell,)
        self.count = 0
        self.root = self._grow(sample, cells, rng)

    def _grow(self, rows: np.ndarray, cells: int, rng: np.random.Generator) -> int:
        if cells > 1 and len(rows) > 1:
            point = rows[rng.integers(len(rows))]
            far = _distances(rows, point)
            cut = float(np.median(far))
            if (far > cut).any():  # else nothing tells these rows apart
                near_, far_ = self._grow(rows[far <= cut], cells // 2, rng), self._grow(rows[far > cut], cells - cells // 2, rng)
                self.nodes.append((point, cut, near_, far_))
                return len(self.nodes) - 1
        self.nodes.append((self.count,))
        self.count += 1
        return len(self.nodes) - 1

    def of(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        out = np.zeros(len(x), np.int32)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if len(self.nodes[node]) == 1:
                out[at] = self.nodes[node][0]
                continue
            point, cut, near, far = self.nodes[node]
            inside = _distances(x[at], point) <= cut
            todo += [(near, at[inside]), (far, at[~inside])]
        return out

    def met(self, q: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> list[list[int]]:
        """For each request the cells that the annulus from ``inner`` to ``outer`` about its q may have rows in."""
        out: list[list[int]] = [[] for _ in q]
        todo = [(self.root, np.arange(len(q)))]
        while todo:
            node, at = todo.pop()
            if len(self.nodes[node]) == 1:
                for i in at:
                    out[i].append(self.nodes[node][0])
                continue
            point, cut, near, far = self.nodes[node]
            d = _distances(q[at], point)
            inside, beyond = at[(d - outer[at] <= cut) & (inner[at] <= d + cut)], at[d + outer[at] > cut]
            todo += [(child, some) for child, some in ((near, inside), (far, beyond)) if len(some)]
        return out


class Block:
    """A vantage-point tree over the rows of a block. A node is a range of ``order`` with the least and the greatest distance of its rows
    to the vantage point of the node above."""

    def __init__(self, x: np.ndarray, rng: np.random.Generator):
        self.x = x
        self.order = np.arange(len(x))
        self.nodes: list[list] = []  # [first, last, point, (child, least, greatest), (child, least, greatest)]
        if len(x):
            self._grow(0, len(x), rng)

    def _grow(self, first: int, last: int, rng: np.random.Generator) -> int:
        me = len(self.nodes)
        self.nodes.append([first, last, None, None, None])
        if last - first > LEAF:
            own = self.order[first:last]
            point = self.x[own[rng.integers(len(own))]]
            far = _distances(self.x[own], point)
            by = np.argsort(far, kind="stable")
            self.order[first:last], far = own[by], far[by]
            half = (last - first) // 2
            self.nodes[me][2] = point
            self.nodes[me][3] = (self._grow(first, first + half, rng), far[0], far[half - 1])
            self.nodes[me][4] = (self._grow(first + half, last, rng), far[half], far[-1])
        return me

    def bounds(self, q: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """The rows of each leaf, and the least and the greatest distance that those of each leaf can have to each q (requests by leaves)."""
        leaves, least, most = [], [], []
        todo = [(0, np.zeros(len(q)), np.full(len(q), np.inf))] if self.nodes else []
        while todo:
            node, low, high = todo.pop()
            first, last, point, *children = self.nodes[node]
            if point is None:
                leaves.append(self.order[first:last])
                least.append(low)
                most.append(high)
                continue
            to = _distances(q, point)
            todo += [(child, np.maximum(low, np.maximum(to - far, near - to)), to + far) for child, near, far in children]
        return leaves, np.array(least).T, np.array(most).T

    def nearest(self, q: np.ndarray, inner: np.ndarray, outer: np.ndarray, k: int, wanted, radius, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores), a row of k a request: the best rows of each one's annulus, best first; ties go to the smaller of ``ties``, a place that
        isn't filled is -1. ``wanted(who, at, least)`` gives (request, place, score) of the rows at some places that may be answers of some requests
        and score at least that of each; ``radius(who, scores)`` the distances of scores."""
        best, score = np.full((len(q), k), -1), np.full((len(q), k), -np.inf)
        leaves, low, high = self.bounds(q)
        low, high, reach = low * (1 - SLACK), high * (1 + SLACK), outer.copy()
        turns = np.argsort(low, axis=1, kind="stable")
        alive = np.arange(len(q))
        for turn in range(len(leaves)):
            leaf = turns[alive, turn]
            near = low[alive, leaf] <= reach[alive]  # a request's later leaves are no nearer
            alive, leaf = alive[near], leaf[near]
            if not len(alive):
                break
            meets = high[alive, leaf] >= inner[alive]
            asks, leaf = alive[meets], leaf[meets]
            by = np.argsort(leaf, kind="stable")
            for group in np.split(by, np.flatnonzero(np.diff(leaf[by])) + 1):
                if not len(group):
                    continue
                who, place, s = wanted(asks[group], leaves[leaf[group[0]]], score[asks[group], -1])
                if not len(who):
                    continue
                some, of = np.unique(who, return_inverse=True)
                place, s = np.concatenate([best[some].ravel(), place]), np.concatenate([score[some].ravel(), s])
                of = np.concatenate([np.repeat(np.arange(len(some)), k), of])
                order = np.lexsort((ties[place], -s, of))
                order = order[place[order] >= 0]
                of = of[order]
                rank = np.arange(len(of)) - np.searchsorted(of, of)
                order, of, rank = order[rank < k], of[rank < k], rank[rank < k]
                best[some[of], rank], score[some[of], rank] = place[order], s[order]
                full = some[best[some, -1] >= 0]
                reach[full] = np.minimum(reach[full], radius(full, score[full, -1]))
        return best, score


def _radius(square: np.ndarray, score: np.ndarray, up: bool) -> np.ndarray:
    """The distances of rows of these scores, where ``square`` is |q|^2 + M; a little more, or less."""
    known = np.where(np.isfinite(score), score, 0.0)
    wide = SLACK * (np.abs(square) + 2 * np.abs(known) + 1)
    out = np.sqrt(np.maximum(0.0, square - 2 * known + (wide if up else -wide)))
    return np.where(score == np.inf, 0.0, np.where(score == -np.inf, np.inf, out))


_FOUND = "request long, row long, vec_id long, score double"


def _search(same: bool, k: int, size: int, most: float):
    """Answers of one block: the k best rows of each request's label (``same``), or of other ones, with low <= score <= high."""

    def search(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        names = ("request", "row", "vec_id", "score")
        if not len(rows) or not len(asked):
            return pd.DataFrame({c: np.empty(0, np.int64) for c in names}).astype({"score": "float64"})
        x, q = _stack(rows["vector"], size), _stack(asked["vector"], size)
        tree = Block(_augmented(x, most), np.random.default_rng(7))
        labels, ids, own = rows["label"].to_numpy(), rows["vec_id"].to_numpy(), rows["row"].to_numpy()
        order = np.argsort(np.lexsort((own, ids)))  # ties by id, then by row
        request, anchor, label, low, high = (asked[c].to_numpy() for c in ("request", "anchor", "label", "low", "high"))
        square = (q * q).sum(1) + most

        def wanted(who: np.ndarray, at: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            s = q[who] @ x[at].T
            i, j = np.nonzero(s >= np.maximum(low[who], least)[:, None])
            s, i, j = s[i, j], who[i], at[j]
            ok = (own[j] != anchor[i]) & ((labels[j] == label[i]) == same) & (s <= high[i])
            return i[ok], j[ok], s[ok]

        radius = lambda who, s: _radius(square[who], s, True)
        at, s = tree.nearest(np.column_stack([q, np.zeros(len(q))]), _radius(square, high, False), _radius(square, low, True), k, wanted, radius, order)
        i, rank = np.nonzero(at >= 0)
        at = at[i, rank]
        return pd.DataFrame(dict(zip(names, (request[i], own[at], ids[at], s[i, rank]), strict=True)))

    return search


class _Table:
    """The rows dealt into cells and blocks, and how to ask them."""

    def __init__(self, rows: DataFrame):
        """``rows``: row long, vec_id long, label, vector array<double>."""
        square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
        n, most, size = rows.agg(F.count(F.lit(1)), F.max(square), F.max(F.size("vector"))).first()
        self.most, self.size = float(most or 0.0), int(size or 0)
        block = min(BLOCK, max(LEAST_BLOCK, -(-n // PARTS)))
        want = min(CELLS, max(1, -(-n // block)))
        sample = rows.orderBy(F.xxhash64("row", F.lit(5)), "row").limit(SAMPLE).select("vector").toPandas() if want > 1 else None
        points = _augmented(_stack(sample["vector"], self.size), self.most) if want > 1 else np.zeros((1, self.size + 1))
        self.cells = Cells(points, want, np.random.default_rng(11))
        cells, size, most = self.cells, self.size, self.most

        def place(batches):
            for some in batches:
                some["cell"] = cells.of(_augmented(_stack(some["vector"], size), most))
                yield some

        placed = rows.mapInPandas(place, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", cell int") if want > 1 else rows.withColumn("cell", F.lit(0))
        self.rows = settle(placed)
        counts = self.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()  # CELLS rows at most
        blocks = {r["cell"]: -(-r["n"] // block) for r in counts}
        self.blocks = F.broadcast(rows.sparkSession.createDataFrame(sorted(blocks.items()), "cell int, blocks int"))
        self.filled = frozenset(blocks)

    def routed(self, requests: DataFrame, home: bool) -> DataFrame:
        """A row for each cell that a request may have answers in: the one that its anchor lies in, or the others."""
        cells, size, most, filled = self.cells, self.size, self.most, self.filled

        def route(batches):
            for some in batches:
                q = np.column_stack([_stack(some["vector"], size), np.zeros(len(some))])
                own = cells.of(_augmented(q[:, :size], most))
                square = (q * q).sum(1) + most
                inner, outer = _radius(square, some["high"].to_numpy(), False), _radius(square, some["low"].to_numpy(), True)
                met = [[int(c)] for c in own] if home else [[c for c in at if c != mine] for at, mine in zip(cells.met(q, inner, outer), own, strict=True)]
                some["cell"] = [[c for c in at if c in filled] for at in met]
                yield some.explode("cell").dropna(subset=["cell"]).astype({"cell": "int32"})

        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in requests.schema)
        return requests.mapInPandas(route, fields + ", cell int")

    def asked(self, requests: DataFrame, same: bool, k: int, home: bool) -> DataFrame:
        routed = self.routed(requests, home).join(self.blocks, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        routed = settle(routed)
        # Requests of a cell meet it in groups; the rows of the cell are there once for each group.
        parts = routed.where("block = 0").groupBy("cell").agg(F.count(F.lit(1)).alias("n")).select("cell", F.ceil(F.col("n") / REQUESTS).cast("int").alias("parts"))
        parts = F.broadcast(parts)  # CELLS rows at most
        right = routed.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("request", F.lit(2)), F.col("parts")).cast("int"))
        block = F.pmod(F.xxhash64("row", F.lit(3)), F.col("blocks")).cast("int")
        left = self.rows.join(parts, "cell").join(self.blocks, "cell").select("row", "vec_id", "label", "vector", "cell", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        keys = ("cell", "block", "part")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_search(same, k, self.size, self.most), _FOUND)

    def best(self, requests: DataFrame, same: bool, k: int) -> DataFrame:
        """(request, rank, row, vec_id, score): the k best answers of each request (request, anchor, label, vector, low, high)."""
        order = Window.partitionBy("request").orderBy(F.desc("score"), "vec_id", "row")
        near = settle(self.asked(requests, same, k, True))
        if self.cells.count > 1:
            floor = near.groupBy("request").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("request", "least")
            further = settle(requests.join(floor, "request", "left").withColumn("low", F.greatest("low", "least")).drop("least"))
            near = near.unionByName(self.asked(further, same, k, False))
        return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(table: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, least: float = 0.8) -> DataFrame:
    """(anchor_id, positive_id, rank from 1, negative_id, positive_score, negative_score): for each anchor and each of its first ``positives``
    other rows of the same label the first ``negatives`` rows of other labels that score between ``least`` times the positive's score and
    the positive's score. Higher inner products come first, ties by the smaller vec_id; fewer, where there are fewer.

    ``table`` has vec_id long, label int and vector array<double> of whole numbers. Rows of a null id, label or vector, and of vectors
    with null or non-finite components, take no part. Rows that repeat an id are rows of their own, as anchors and as
    candidates. Vectors of different lengths meet in the components that both have. A positive of a score below 0 has no negatives. An
    empty table, or one without anchors, gives no rows. Other columns aren't used.
    """
    clean = table.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & valid_vectors(F.col("vector")))
    rows = settle(clean.select("vec_id", F.col("label").cast("long").alias("label"), "vector", F.coalesce(is_anchor, F.lit(False)).alias("asked")).withColumn("row", F.monotonically_increasing_id()))
    dealt = _Table(rows.drop("asked"))
    low, high = F.lit(float("-inf")), F.lit(float("inf"))
    anchors = rows.where("asked").select(F.col("row").alias("request"), F.col("row").alias("anchor"), "label", "vector", low.alias("low"), high.alias("high"))
    found = settle(dealt.best(anchors, True, positives).select("request", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "rank"))
    pairs = found.join(rows.where("asked").select(F.col("row").alias("request"), "vec_id", "label", "vector"), "request").where("positive_score >= 0")
    # The score windows; of whole numbers, so that no rounding moves a bound.
    pairs = settle(pairs.withColumn("anchor", F.col("request")).withColumn("request", F.col("anchor") * positives + F.col("rank") - 1))
    asked = pairs.select("request", "anchor", "label", "vector", F.ceil(F.round(F.col("positive_score") * (100 * least)) / 100).cast("double").alias("low"), F.col("positive_score").alias("high"))
    best = dealt.best(asked, False, negatives)
    named = pairs.select("request", F.col("vec_id").alias("anchor_id"), "positive_id", "positive_score")
    return best.join(named, "request").select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every row of ``embeddings`` whose vec_id is divisible by 100, with the labels of every seventh row changed."""
    raw = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    whole = F.transform("embedding", lambda x: F.floor(F.lit(256) * x.cast("double")).cast("double"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = raw.where(valid_vectors(F.col("embedding"))).select("vec_id", label.alias("label"), whole.alias("vector"))
    found = hard_negatives(rows, F.col("vec_id") % 100 == 0)
    return found.withColumn("positive_score", F.col("positive_score").cast("long")).withColumn("negative_score", F.col("negative_score").cast("long"))


OP13_SQL = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.n, a.vec_id AS anchor_id, c.n AS m, c.vec_id, c.label = a.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.n != a.n),
p AS (SELECT n, m AS p, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id, m) <= 5),
r AS (SELECT s.anchor_id, p.positive_id, row_number() OVER (PARTITION BY s.n, p.p ORDER BY s.score DESC, s.vec_id, s.m)::INTEGER AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
  FROM s JOIN p ON s.n = p.n AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score)
SELECT * FROM r WHERE rank <= 5
"""
