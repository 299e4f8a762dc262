"""Exact top-k by inner product: Fagin's threshold algorithm over sorted per-dimension lists.

Candidates and queries are dealt into blocks; a pair of blocks is one group, of bounded size. Within it
each dimension's list of candidates is sorted once. For a query the lists are read from the end that
its weight favours, deeper in steps; each newly seen candidate is scored in full. When the bound (the
inner product of the query with the values at the present depth) is below the k-th best score, no unseen
candidate can enter, and reading stops; at a bound equal to it reading goes on, as ties go to the smaller
id. The first block's k-th score of each query goes with the query to all other blocks, where reading stops
as soon as the bound is below it. The blocks' results merge to the whole table's by one window over
(query, k rows a block at most).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .settle import settle

#: Candidates a block and queries a block. Small tables are cut into PARTS blocks, so that all cores work.
BLOCK, QUERY_BLOCK, PARTS, LEAST_BLOCK = 8192, 1024, 32, 2048
#: Depth of the first step, and how many times deeper each later one is.
FIRST_STEP, DEEPER = 32, 2


def valid_vectors(vector: Column) -> Column:
    """True for vectors without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & finite


def threshold_top(rows: np.ndarray, ids: np.ndarray, x: np.ndarray, query_rows: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int, int]]:
    """For each query (places of its candidates, their scores, depth at which reading stopped, candidates scored): the k
    best candidates, the query's own row left out, without those that score below its floor. Scores that are whole
    numbers below 2 ** 53 are exact."""
    n = len(x)
    lists = np.argsort(x, axis=0, kind="stable")  # ascending, a column a dimension
    values = np.take_along_axis(x, lists, axis=0)
    ranks = np.empty(x.shape, np.int32)
    np.put_along_axis(ranks, lists, np.arange(n, dtype=np.int32)[:, None], axis=0)
    out = []
    for own, q, floor in zip(query_rows, queries, floors, strict=True):
        used = np.flatnonzero(q)
        up = q[used] > 0
        seen = rows == own
        best_i, best_s = np.empty(0, np.int64), np.empty(0)
        depth, scored, left, reach = 0, 0, None, None
        while depth < n:
            deeper = min(n, max(FIRST_STEP, DEEPER * depth))
            if len(used) and not depth:
                mark = np.zeros(n, bool)
                mark[lists[n - deeper :, used[up]].ravel()] = True
                mark[lists[:deeper, used[~up]].ravel()] = True
                fresh = np.flatnonzero(mark & ~seen)
            elif len(used):
                # Deeper entries are mostly of rows that were seen: it is cheaper to ask of the others how deep they are reached.
                if left is None:
                    left = np.flatnonzero(~seen)
                    at = ranks[left][:, used]
                    reach = np.where(up, n - 1 - at, at).min(1)
                fresh = left[(reach >= depth) & (reach < deeper)]
            else:  # all scores are 0, and there is no list to read
                fresh, deeper = np.flatnonzero(~seen), n
            depth = deeper
            seen[fresh] = True
            scored += len(fresh)
            # To copy more than half of the rows costs more than a product with all of them.
            best_i, best_s = np.concatenate([best_i, fresh]), np.concatenate([best_s, x[fresh] @ q if 2 * len(fresh) < n else (x @ q)[fresh]])
            if len(best_i) > k:
                kth = np.partition(best_s, len(best_s) - k)[len(best_s) - k]
                keep = best_s >= kth
                best_i, best_s = best_i[keep], best_s[keep]
                order = np.lexsort((rows[best_i], ids[best_i], -best_s))[:k]
                best_i, best_s = best_i[order], best_s[order]
            if depth < n:
                least = max(floor, best_s.min() if len(best_i) == k else -np.inf)
                edge = np.where(up, values[n - depth, used], values[depth - 1, used])
                if edge @ q[used] < least:
                    break
        keep = best_s >= floor
        out.append((best_i[keep], best_s[keep], depth, scored))
    return out


def _matrix(vectors: pd.Series) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def top_k(table: DataFrame, is_query: Column, k: int) -> DataFrame:
    """(query_id, rank from 1, vec_id, score double): for each row for which ``is_query`` holds, the k highest inner products
    with all other rows; all, if fewer; ties to the smaller vec_id.

    ``table`` has vec_id long and vector array<double>. Rows of a null id, and vectors that are null or have
    null or non-finite components take no part. Rows that repeat an id are rows of their own, as queries and
    as candidates. Vectors of different lengths meet in the components that both have; an empty vector scores 0
    with all. An empty table gives no rows. Other columns aren't used.
    """
    clean = table.where(F.col("vec_id").isNotNull() & valid_vectors(F.col("vector"))).select("vec_id", "vector", F.coalesce(is_query, F.lit(False)).alias("asked"))
    rows = settle(clean.withColumn("row", F.monotonically_increasing_id()))
    n, asked = rows.agg(F.count(F.lit(1)), F.count_if("asked")).first()
    block = min(BLOCK, max(LEAST_BLOCK, -(-n // PARTS)))
    parts, query_parts = max(1, -(-n // block)), max(1, -(-asked // QUERY_BLOCK))
    part = lambda salt, many: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(many)).cast("int")
    upto = lambda first, last: F.explode(F.sequence(F.lit(first), F.lit(last)))
    schema = "query_row long, query_id long, row long, vec_id long, score double"

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(a) and len(b):
            both = _matrix(pd.concat([a["vector"], b["vector"]]))
            x, q = np.ascontiguousarray(both[: len(a)]), both[len(a) :]
            rows_, ids = a["row"].to_numpy(), a["vec_id"].to_numpy()
            best = threshold_top(rows_, ids, x, b["row"].to_numpy(), q, k, b["floor"].to_numpy())
            for query_row, query_id, (at, scores, _, _) in zip(b["row"], b["vec_id"], best, strict=True):
                found.append(pd.DataFrame({"query_row": np.full(len(at), query_row), "query_id": np.full(len(at), query_id), "row": rows_[at], "vec_id": ids[at], "score": scores}))
        empty = {c: np.empty(0, np.int64) for c in ("query_row", "query_id", "row", "vec_id")} | {"score": np.empty(0)}
        return pd.concat(found) if found else pd.DataFrame(empty)

    def met(first: int, last: int, queries: DataFrame) -> DataFrame:
        """The k best of each query in each of the candidates' blocks first .. last."""
        left = rows.withColumn("c", part(1, parts)).where(F.col("c").between(first, last)).select("row", "vec_id", "vector", "c", upto(0, query_parts - 1).alias("q"))
        right = queries.select("row", "vec_id", "vector", "floor", upto(first, last).alias("c"), part(2, query_parts).alias("q"))
        return left.groupBy("c", "q").cogroup(right.groupBy("c", "q")).applyInPandas(search, schema)

    queries = rows.where("asked")
    near = settle(met(0, 0, queries.withColumn("floor", F.lit(float("-inf")))))
    if parts > 1:
        floors = near.groupBy("query_row").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select(F.col("query_row").alias("row"), F.col("least").alias("floor"))
        floored = settle(queries.join(floors, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))))
        near = near.unionByName(met(1, parts - 1, floored))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of every row of ``embeddings`` whose vec_id is divisible by 20."""
    raw = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    whole = F.transform("embedding", lambda x: F.floor(F.lit(64) * x.cast("double")).cast("double"))
    rows = raw.where(valid_vectors(F.col("embedding"))).select("vec_id", whole.alias("vector"))
    return top_k(rows, F.col("vec_id") % 20 == 0, 20).withColumn("score", F.col("score").cast("long"))


OP3_SQL = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.n != q.n),
r AS (SELECT query_id, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""
