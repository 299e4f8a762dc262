"""Exact join of documents whose 5-word shingle sets have a Jaccard similarity of 0.8 or more, as classes and link counts.

Method: set-relation skipping over a prefix index.

* *Sets.* Equal sets are one set: a set's key is a 128-bit digest of its shingles. All further work is on
  distinct sets, so copies cost one row each.
* *Order and prefix.* Shingles are ordered by how often they occur (rare first, then by hash). If x is the
  smaller of two linked sets, their first common shingle is among the first |x| - ceil(8 |x| / 9) + 1 of x
  and the first |y| - ceil(0.8 |y|) + 1 of y. How often is counted over the whole table: each task reports
  what it saw LEAST_SEEN times or more, reports are summed, and the MOST_FREQUENT highest are sent to the
  tasks (a fixed size). Any order gives the same result; this one keeps passages that many documents share
  out of the prefixes.
* *Index-level skipping.* Posting lists hold (set, size, position, rank). Lists of one set are dropped; the
  rank counts the earlier shingles of a set's prefix that are in other lists, so what two sets can have in
  common before the list's shingle is bounded by their ranks, and what they can have after it by
  their sizes and positions. A list's member skips all others that these leave no room for.
* *Answer-level skipping of classes.* Members of a list meet its leaders: members whose hash lies in a ring
  that grows RING-fold each round, until all members are leaders. Links make classes, and sets of one
  class aren't compared any more. A member meets leaders of larger classes as soon as they are drawn, and
  two leaders meet when the later of them is drawn, so each pair of a list whose sets are in different
  classes is compared in the end: no link between classes is missed, and a hot list costs little more
  than its members while its classes grow.
* *Answer-level derivation of links.* Within a class, blocks of sets of like sizes meet (a block skips those
  of unlike sizes). A set's overlaps with a block are derived from those that a similar set has, by the
  postings of the shingles in which the two differ.

Candidates first meet a bitmap bound: each set has the parities of its shingles in BITS buckets, and the
parities in which two sets differ are no more than the shingles in which they differ. What is left is
verified by the whole shingle sets, as 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import component_labels
from .settle import drop_settled, free_unused, lean, settle, small_batches
from .textvec import shingle_sets

PERCENT = 80
#: Of the counts of a task those are reported; of the sums so many highest are used.
LEAST_SEEN, MOST_FREQUENT, LEAST_FREQUENT = 3, 1 << 19, 8
#: Different shingles whose counts a task holds, and shingles that it adds to them at once.
PENDING, ADDED = 1 << 20, 1 << 17
BITS = 2048
#: Keys of so many sets may be broadcast; beyond it, the same join is shuffled.
BROADCAST_KEYS = 1 << 20
#: Expected leaders of a list in the first round, and how many times more there are in each later one.
FIRST_RING, RING = 2, 8
#: Sets and shingles of a block.
BLOCK_SETS, BLOCK_SHINGLES = 512, 1 << 20


def least_overlap(a, b):
    """The least intersection that two sets of these sizes need: 100 i >= P (a + b - i)."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def _key(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _short(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def _parities(found: np.ndarray) -> list[int]:
    counts = np.bincount((found & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(counts.astype(np.uint8)).view(np.int64).tolist()


def _summed(every: np.ndarray, times: np.ndarray, some: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted numbers and their counts, with those of ``some`` added."""
    more, seen = np.unique(np.concatenate(some), return_counts=True)
    at = np.searchsorted(every, more)
    old = np.zeros(len(more), bool)
    if len(every):
        old = every[np.minimum(at, len(every) - 1)] == more
        times[at[old]] += seen[old]
    return np.insert(every, at[~old], more[~old]), np.insert(times, at[~old], seen[~old])


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind 0: row, key and its short form, n, parities) of the sets, then (kind 1: shingle, times) of this task's frequent shingles.
    A task that holds more than PENDING different shingles goes on with those that it saw more than once."""
    every, times = np.empty(0, np.uint64), np.empty(0, np.int64)
    for batch in batches:
        keys, sizes, bits, some, pending = [], [], [], [], 0
        for found in shingle_sets([t or b"" for t in _texts(batch, "text")]):
            keys.append(_key(found))
            sizes.append(len(found))
            bits.append(_parities(found) if len(found) else [])
            some.append(found)
            pending += len(found)
            if pending >= ADDED:
                every, times = _summed(every, times, some)
                some, pending = [], 0
        if some:
            every, times = _summed(every, times, some)
        if len(every) > PENDING:
            every, times = every[times > 1], times[times > 1]
        yield pa.RecordBatch.from_pydict(
            {"kind": pa.array([0] * len(keys), pa.int8()), "doc_id": batch.column("doc_id"), "key": pa.array(keys, pa.binary()), "shingle": pa.array([_short(k) for k in keys], pa.int64()),
             "n": pa.array(sizes, pa.int64()), "bits": pa.array(bits, pa.list_(pa.int64()))}
        )
    often = times >= LEAST_SEEN
    every, times = every[often].view(np.int64), times[often]
    m = len(every)
    yield pa.RecordBatch.from_pydict(
        {"kind": pa.array(np.ones(m, np.int8)), "doc_id": pa.nulls(m, pa.int64()), "key": pa.nulls(m, pa.binary()), "shingle": pa.array(every), "n": pa.array(times), "bits": pa.nulls(m, pa.list_(pa.int64()))}
    )


def _frequent(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of the most frequent shingles, MOST_FREQUENT at most."""
    sums = settle(counted.groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_FREQUENT))
    sizes = sums.groupBy(F.floor(F.log2("n") * 4).alias("b")).count().orderBy(F.desc("b")).collect()
    total, least = 0, LEAST_FREQUENT
    for b, count in sizes:
        if total + count > MOST_FREQUENT:
            least = math.ceil(2 ** ((b + 1) / 4))
            break
        total += count
    got = sums.where(F.col("n") >= least).toArrow()
    drop_settled(sums)
    keys = got.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    out = keys[order], np.minimum(got.column("n").to_numpy(), (1 << 31) - 1).astype(np.int32)[order]
    del got, keys, order
    free_unused()  # the driver's, which keeps the table's memory else
    return out


def _posting_rows(frequent: tuple[np.ndarray, np.ndarray]):
    keys, counts = frequent

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()  # copies within the task give their postings once
        for batch in batches:
            shingles, sids, sizes, places = [], [], [], []
            for found in shingle_sets([t or b"" for t in _texts(batch, "text")]):
                n = len(found)
                if not n or (key := _key(found)) in done:
                    continue
                done.add(key)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                    found = found[np.argsort(np.where(keys[at] == found, counts[at], 0), kind="stable")]
                prefix = found[: prefix_length(n)]
                shingles.append(prefix)
                sids.append(np.full(len(prefix), _short(key)))
                sizes.append(np.full(len(prefix), n))
                places.append(np.arange(len(prefix)))
            if shingles:
                yield pa.RecordBatch.from_pydict(
                    {"shingle": np.concatenate(shingles).view(np.int64), "sid": np.concatenate(sids), "n": np.concatenate(sizes).astype(np.int32), "pos": np.concatenate(places).astype(np.int32)}
                )

    return rows


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = list(shingle_sets([t or b"" for t in _texts(batch, "text")]))
        yield pa.RecordBatch.from_pydict({"key": pa.array([_key(x) for x in found], pa.binary()), "shingles": pa.array([x.tobytes() for x in found], pa.binary())})


def _array(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links among (a, b, shingles_a, shingles_b)."""
    for batch in batches:
        good = []
        for left, right in zip(batch.column("shingles_a").to_pylist(), batch.column("shingles_b").to_pylist(), strict=True):
            x, y = _array(left), _array(right)
            common = len(x) + len(y) - len(np.union1d(x, y))
            good.append(100 * common >= PERCENT * (len(x) + len(y) - common))
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _few(keys: DataFrame) -> DataFrame:
    """``keys``, to be broadcast if they are few enough."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _bounded(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and parities leave room for the least overlap."""
    a, b = (sets.select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}")) for k in "ab")
    both = pairs.join(a, "a").join(b, "b")
    apart = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return both.where(((F.col("n_a") + F.col("n_b") - apart) / 2) * (100 + PERCENT) >= PERCENT * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def _ids(pairs: DataFrame) -> DataFrame:
    return settle(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())


def _links(pairs: DataFrame, arrays: DataFrame, ids: DataFrame) -> DataFrame:
    """The pairs that are links. Only the shingles of ``ids``, the sets of the pairs, are moved."""
    some = arrays.join(_few(ids), "id", "left_semi")
    a, b = (some.select(F.col("id").alias(k), F.col("shingles").alias(f"shingles_{k}")) for k in "ab")
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "shingles_a", "shingles_b")
    return settle(both.mapInArrow(lean(_verified), "a long, b long"))


def _shingles_of(ids: DataFrame, sets: DataFrame, docs: DataFrame, arrays: DataFrame) -> DataFrame:
    """``arrays`` (id, shingles) with those of the sets ``ids`` that aren't in it. Each set's text is cut up once, and
    only texts that bear one of them."""
    wanted = settle(sets.join(ids, "id", "left_semi").join(arrays.select("id"), "id", "left_anti").select("key", "doc_id", "id"))
    if wanted.isEmpty():
        return arrays
    bearers = _few(wanted.select(F.col("doc_id").alias("bearer")).distinct())
    borne = docs.join(bearers, docs["doc_id"].eqNullSafe(F.col("bearer")), "left_semi").select("text")
    found = borne.mapInArrow(lean(_with_key), "key binary, shingles binary").join(_few(wanted.select("key", "id")), "key")
    return arrays.unionByName(settle(found.dropDuplicates(["key"]).select("id", "shingles")))


#: SQL: the sizes, positions and ranks of two postings x and y leave room for the least overlap, and the
#: smaller set's position is within the shorter prefix that is enough for it.
_POSSIBLE = f"""100 * least(x.n, y.n) >= {PERCENT} * greatest(x.n, y.n)
  AND 1 + least(x.n - 1 - x.pos, y.n - 1 - y.pos) + least(x.rank, y.rank) >= ceil({PERCENT} * (x.n + y.n) / {100 + PERCENT})
  AND CASE WHEN x.n < y.n OR (x.n = y.n AND x.id < y.id) THEN x.pos <= x.n - ceil({2 * PERCENT} * x.n / {100 + PERCENT})
      ELSE y.pos <= y.n - ceil({2 * PERCENT} * y.n / {100 + PERCENT}) END"""


def _classes(lists: DataFrame, sets: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, component) of all sets that are linked with another one, and the shingles of those (of others too)."""
    spark = lists.sparkSession
    arrays = spark.createDataFrame([], "id long, shingles binary")
    tried = links = spark.createDataFrame([], "a long, b long")
    labels = spark.createDataFrame([], "id long, component long")
    share = (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)).alias("share")
    sized = lists.groupBy("shingle").agg(F.count(F.lit(1)).alias("m"))
    lists = settle(lists.join(sized, "shingle").select("*", share, F.col("id").alias("c")))
    least, most = 0, FIRST_RING
    while True:
        # A list whose members are of one class by now is done for good.
        ends = lists.groupBy("shingle").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("shingle")
        in_class = lists.groupBy(F.col("shingle"), F.col("c")).agg(F.count(F.lit(1)).alias("mates"))
        now = settle(lists.join(ends, "shingle", "left_semi").join(in_class, ["shingle", "c"]))
        drop_settled(lists)
        largest = now.agg(F.max("m")).first()[0]
        if largest is None:
            break
        leaders = now.where(f"share * m >= {least} AND (share * m < {most} OR m <= {most})")
        pairs = now.alias("x").join(leaders.alias("y"), "shingle").where(
            "x.c != y.c AND (x.share < y.share OR (x.share = y.share AND x.id < y.id) OR y.mates >= x.mates) AND " + _POSSIBLE
        )
        pairs = pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
        pairs = settle(pairs.join(tried, ["a", "b"], "left_anti"))
        near = settle(_bounded(pairs, sets))
        ids = _ids(near)
        arrays = _shingles_of(ids, sets, docs, arrays)
        links = links.unionByName(_links(near, arrays, ids))
        drop_settled(near)
        drop_settled(ids)
        labels = settle(component_labels(links))
        if largest <= most:
            break
        tried = tried.unionByName(pairs)
        named = labels.withColumnRenamed("component", "new")
        open_still = now.where(f"m > {most}").drop("mates")
        lists = settle(open_still.join(named, "id", "left").withColumn("c", F.coalesce("new", "id")).drop("new"))
        least, most = most, most * RING
    return labels, arrays


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``left`` with all of ``right`` (sorted arrays of distinct numbers).
    Those of a set are derived from those of the set before that was counted in whole, by the postings of the
    numbers in which the two differ, if these are fewer than its own."""
    m = len(right)
    out = np.zeros((len(left), m), np.int64)
    numbers, back = np.unique(np.concatenate(right), return_inverse=True)
    owner = np.repeat(np.arange(m), [len(x) for x in right])[np.argsort(back, kind="stable")]
    at = np.concatenate([[0], np.cumsum(np.bincount(back, minlength=len(numbers)))])

    def counted(which: np.ndarray) -> np.ndarray:
        sizes = at[which + 1] - at[which]
        ends = np.cumsum(sizes)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(at[which] - ends + sizes, sizes)
        return np.bincount(owner[place], minlength=m)

    base, answers = None, None
    for i, x in enumerate(left):
        place = np.minimum(np.searchsorted(numbers, x), len(numbers) - 1)
        mine = place[numbers[place] == x]
        if base is not None:
            come, gone = np.setdiff1d(mine, base, assume_unique=True), np.setdiff1d(base, mine, assume_unique=True)
            if len(come) + len(gone) < len(mine):
                out[i] = answers + counted(come) - counted(gone)
                continue
        base, answers = mine, counted(mine)
        out[i] = answers
    return out


def _block_links(table: pa.Table) -> pa.Table:
    """(id, others) of the sets of two blocks (``right`` tells which one), or of one block with itself: how many
    documents the linked sets of the other block have."""
    ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
    right = table.column("right").to_numpy(zero_copy_only=False)
    found = [_array(x) for x in table.column("shingles").to_pylist()]
    n = np.array([len(x) for x in found])
    a, b = np.flatnonzero(~right), np.flatnonzero(right)
    alone = table.column("same")[0].as_py() and table.column("i")[0].as_py() == table.column("j")[0].as_py()
    if alone:
        b = a
    others = np.zeros(len(ids), np.int64)
    if len(a) and len(b):
        common = overlaps([found[i] for i in a], [found[i] for i in b])
        linked = (100 + PERCENT) * common >= PERCENT * (n[a][:, None] + n[b][None, :])
        if alone:
            linked[np.arange(len(a)), np.arange(len(a))] = False
        others[a] = linked @ copies[b]
        if not alone:
            others[b] = copies[a] @ linked
    return pa.table({"id": ids, "others": others})


def _link_counts(labels: DataFrame, sets: DataFrame, arrays: DataFrame) -> DataFrame:
    """(id, others): how many documents of other sets each set of a class of several sets is linked with."""
    width = math.log(100 / PERCENT) * 1.000001  # sizes that can be linked are less than one width apart
    size = F.floor(F.log(F.col("n").cast("double")) / width).cast("int")
    sized = labels.join(sets.select("id", "n", "copies"), "id").withColumn("s", size)
    within = F.greatest(F.lit(1), F.least(F.lit(BLOCK_SETS), F.floor(F.lit(BLOCK_SHINGLES) / F.exp((F.col("s") + 1) * width))))
    counts = settle(sized.groupBy("component", "s").agg(F.count(F.lit(1)).alias("m")).withColumn("blocks", F.ceil(F.col("m") / within).cast("int")))
    near = lambda by, name: counts.select("component", (F.col("s") + by).alias("s"), F.col("blocks").alias(name))
    shape = counts.join(near(-1, "above"), ["component", "s"], "left").join(near(1, "below"), ["component", "s"], "left")
    placed = sized.join(shape, ["component", "s"]).withColumn("i", F.pmod(F.xxhash64("id", F.lit(11)), F.col("blocks")).cast("int"))
    none = F.array().cast("array<int>")
    upto = lambda first, last: F.when(last >= first, F.sequence(first, last)).otherwise(none)
    at = lambda lower, i, j, right, same: F.struct(lower.alias("lower"), i.alias("i"), j.alias("j"), F.lit(right).alias("right"), F.lit(same).alias("same"))
    i, s, zero = F.col("i"), F.col("s"), F.lit(0)
    meets = F.concat(
        F.transform(F.when(F.col("m") > 1, upto(i, F.col("blocks") - 1)).otherwise(none), lambda j: at(s, i, j, False, True)),
        F.transform(F.when(F.col("m") > 1, upto(zero, i - 1)).otherwise(none), lambda j: at(s, j, i, True, True)),
        F.transform(upto(zero, F.coalesce("above", zero) - 1), lambda j: at(s, i, j, False, False)),
        F.transform(upto(zero, F.coalesce("below", zero) - 1), lambda j: at(s - 1, j, i, True, False)),
    )
    rows = placed.select("id", "component", "copies", F.explode(meets).alias("x")).select("id", "component", "copies", "x.*")
    blocks = rows.join(arrays, "id").groupBy("component", "lower", "i", "j", "same")
    return blocks.applyInArrow(_block_links, "id long, others long").groupBy("id").agg(F.sum("others").alias("others"))


def similar_classes(docs: DataFrame, links: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles (the size of its set), component_id (its class), and with ``links``
    n_links, the number of other rows that it is linked with, copies too.

    ``docs`` has doc_id long and text string. One row comes out for every row that went in, repeated
    rows too. Null and empty texts have no shingles (0) and are linked with nothing; their
    component_id is their own doc_id and n_links 0. A null doc_id takes part in links but is never the
    smallest; a component_id is null only where all ids of its class are. Other columns aren't used.
    The work for n_links grows with the square of the sets of one class and like size, divided by the
    size of a block; that for classes alone doesn't.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    found = settle(docs.mapInArrow(lean(_set_rows), "kind byte, doc_id long, key binary, shingle long, n long, bits array<long>"))
    own = found.where("kind = 0")
    frequent = _frequent(found.where("kind = 1"))
    sets = own.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.max("n").cast("int").alias("n"), F.max("bits").alias("bits"), F.max("shingle").alias("sid"), F.count(F.lit(1)).alias("copies"))
    # The first 8 bytes of a key name its set in the postings; sets that share them give more candidates, no more.
    sets = settle(sets.withColumn("id", F.monotonically_increasing_id()))

    postings = docs.mapInArrow(lean(_posting_rows(frequent)), "shingle long, sid long, n int, pos int")
    dealt = postings.repartition("shingle")
    # All columns are aggregated, so that both sides of the join read one exchange.
    ends = [f(F.struct("sid", "n", "pos")).alias(name) for f, name in ((F.min, "low"), (F.max, "high"))]
    shared = dealt.groupBy("shingle").agg(*ends).where("low.sid < high.sid OR low.n < high.n").select("shingle")
    once = dealt.join(shared, "shingle").groupBy("shingle", "sid", "n").agg(F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy("sid", "n").orderBy("pos")) - 1
    # A left join, as an inner one would ask for non-null ids on one side of the join of lists only.
    named = once.withColumn("rank", rank).join(sets.select("sid", "n", "id"), ["sid", "n"], "left")
    lists = settle(named.select("shingle", "id", "n", "pos", "rank"))

    met = settle(sets.join(lists.select("id").distinct(), "id", "left_semi"))
    labels, arrays = _classes(lists, met, docs)

    named = sets.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    first = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(first, "component").select("id", "key", "component_id", "copies")
    if links:
        others = settle(_link_counts(labels, met, arrays))
        named = named.join(others, "id", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("others", F.lit(0)))
    linked = own.join(named.drop("id", "copies"), "key", "left")
    more = [F.when(F.col("n") > 0, F.col("n_links")).otherwise(F.lit(0)).alias("n_links")] if links else []
    return linked.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), *more)


def keep_first_of_class(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose class has a row of a smaller doc_id; of rows that repeat the kept id all stay."""
    classes = similar_classes(docs).where(F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id")) | F.col("doc_id").isNull())
    kept = classes.select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__kept"]), "left_semi")


def op8_jaccard(spark, sf_dir: str) -> DataFrame:
    """Classes and numbers of links of all ``documents``."""
    return similar_classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), links=True)


OP8_SQL = """
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x != '') AS v FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(v) = 0 THEN [] WHEN len(v) < 5 THEN [array_to_string(v, ' ')]
    ELSE list_transform(range(1, len(v) - 3), lambda i: array_to_string(v[i:i+4], ' ')) END) AS g FROM w),
d AS MATERIALIZED (SELECT g, min(doc_id) AS r, len(g) AS n, count(*) AS k FROM (SELECT doc_id, list_sort(g) AS g FROM s WHERE len(g) > 0) GROUP BY g),
e AS MATERIALIZED (SELECT r, n, unnest(g) AS x FROM d),
p AS MATERIALIZED (
  SELECT a.r AS a, b.r AS b FROM e a JOIN e b ON a.x = b.x AND a.r < b.r AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
c(r, m) AS (SELECT r, r FROM d UNION SELECT l.b, c.m FROM c JOIN l ON c.r = l.a WHERE c.m < l.b),
m AS (SELECT r, min(m) AS m FROM c GROUP BY r),
o AS (SELECT l.a AS r, sum(d.k) AS o FROM l JOIN d ON l.b = d.r GROUP BY l.a),
k AS (SELECT d.g, m.m, d.k - 1 + coalesce(o.o, 0) AS n_links FROM d JOIN m USING (r) LEFT JOIN o USING (r))
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(k.m, s.doc_id) AS component_id, coalesce(k.n_links, 0)::BIGINT AS n_links FROM s LEFT JOIN k ON list_sort(s.g) = k.g
"""
