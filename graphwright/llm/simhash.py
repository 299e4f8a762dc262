"""SimHash near-duplicates: a byte-position inverted index with count filtering.

A fingerprint has 64 bits, 8 positional bytes. Two that differ in ``differ`` bits at most share 8 - differ positional
bytes at least: the guaranteed minimum. The tally of a pair reaches it just where the pair stands together in the
intersection of that many posting lists. So the lists are intersected first, for each choice of that many positions,
and pairs are only looked at within an intersection: to tally them over single lists, each of which holds a 256th of all
fingerprints, would be to write down a 64th of all pairs.

* *Copies.* The index holds distinct fingerprints, so copies of a text, and texts of one fingerprint, cost one entry.
* *Bounded lists.* All members of an intersection have 6 bytes in common (differ = 2), so the other 2 tell them apart: there are
  65,536 of them at most, whatever the table. A third of all rows in one cluster makes no longer list.
* *No pairs.* Within an intersection each member is looked up under the 136 changes of one or two bits in its free
  bytes (that is the verification, it is exact), which is linear in the members. Of what is linked, each member is
  written with the least of its part: links are kept by connection, their number is below that of the members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import component_labels
from .settle import settle, small_batches

SEED = 42
SHINGLE = 3
#: A fingerprint of one in so many rows or more is frequent: there are so many of them at most, a set of fixed size.
FREQUENT = 1000
#: Postings taken at once; a list is never cut.
POSTINGS = 1 << 16
#: Shingles whose bits are counted at once; a text is never cut.
SHINGLES = 1 << 16
#: For each byte the eight bits of it, a byte each.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64).ravel()


def shingle_hashes(text: bytes) -> np.ndarray:
    """XXH64 of each run of three words of the text in lower case, repeats included; of fewer words, of them all; none without words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    at = np.cumsum([0, *map(len, words)]) + np.arange(len(words) + 1)  # where each word begins in the line
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(at[:-SHINGLE].tolist(), (at[SHINGLE:] - 1).tolist(), strict=True)], np.uint64)


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """For each text 64 bits: a bit is set if it is in over half of the shingles' hashes; 0 for a text without words."""
    out, some, size, first = np.zeros(len(texts), np.uint64), [], 0, 0
    for i, text in enumerate(texts):
        some.append(shingle_hashes(text))
        size += len(some[-1])
        if size >= SHINGLES or i == len(texts) - 1:
            out[first : i + 1] = _majorities(some)
            some, size, first = [], 0, i + 1
    return out


def _majorities(hashes: list[np.ndarray]) -> np.ndarray:
    counts = np.array([len(h) for h in hashes])
    has = np.flatnonzero(counts)
    out = np.zeros(len(hashes), np.uint64)
    if len(has):
        n = counts[has]
        # Bits are counted in lanes of a byte, so by pieces of 255 hashes at most; then the pieces of a text are summed.
        pieces = -(-n // 255)
        ends = np.cumsum(pieces)
        at = np.repeat(np.cumsum(n) - n, pieces) + 255 * (np.arange(ends[-1]) - np.repeat(ends - pieces, pieces))
        lanes = _LANES[np.concatenate(hashes).view(np.uint8)].reshape(-1, 8)
        counted = np.add.reduceat(lanes, at, axis=0).view(np.uint8).reshape(-1, 64)
        ones = np.add.reduceat(counted.astype(np.int64), ends - pieces, axis=0)
        out[has] = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = fingerprints([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64), pa.int64())], names=["doc_id", "fp"])


def _free_bytes(differ: int) -> list[tuple[int, ...]]:
    """The choices of positions that two linked fingerprints may differ in."""
    return list(combinations(range(8), differ))


def _mask(free: tuple[int, ...]) -> int:
    return sum(0xFF << (8 * p) for p in free)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _linked(lists: np.ndarray, own: np.ndarray, differ: int) -> np.ndarray:
    """For each posting (number of its list, bits in the free bytes; sorted, distinct) the place of the least one that is
    reached by changes of ``differ`` bits at most within the list."""
    whole = (lists << (8 * differ)) | own
    label = np.arange(len(whole))
    left, right = [], []
    for n in range(1, differ + 1):
        for bits in combinations(range(8 * differ), n):
            change = sum(1 << b for b in bits)
            other = whole ^ change
            at = np.minimum(np.searchsorted(whole, other), len(whole) - 1)
            met = np.flatnonzero((whole[at] == other) & (other > whole))
            left.append(met)
            right.append(at[met])
    a, b = np.concatenate(left), np.concatenate(right)
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def _link_rows(differ: int):
    masks = np.array([_mask(free) for free in _free_bytes(differ)], np.uint64)
    free = np.array(_free_bytes(differ), np.uint64).reshape(len(masks), differ)

    def links(combo: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        """Of whole lists: (fingerprint, least fingerprint that it is connected with in the list)."""
        key = fp & ~masks[combo]
        fresh = np.r_[True, (key[1:] != key[:-1]) | (combo[1:] != combo[:-1])]
        group = np.cumsum(fresh) - 1
        several = np.bincount(group)[group] > 1
        fp, combo, group = fp[several], combo[several], group[several]
        own = np.zeros(len(fp), np.int64)
        for j in range(differ):
            own |= ((fp >> (free[combo, j] * np.uint64(8))) & np.uint64(0xFF)).astype(np.int64) << (8 * j)
        order = np.lexsort((own, group))
        fp = fp[order]
        label = _linked(group[order], own[order], differ) if len(fp) else np.empty(0, np.int64)
        changed = label != np.arange(len(fp))
        a, b = fp[changed].view(np.int64), fp[label[changed]].view(np.int64)
        return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        combos, fps, size = [], [], 0
        for batch in batches:
            combos.append(np.asarray(batch.column(0)).astype(np.int64))
            fps.append(np.asarray(batch.column(1)).view(np.uint64))
            size += len(combos[-1])
            if size < POSTINGS:
                continue
            combo, fp = np.concatenate(combos), np.concatenate(fps)
            key = fp & ~masks[combo]
            # The last list may go on in the next batch.
            changes = np.flatnonzero((key[1:] != key[:-1]) | (combo[1:] != combo[:-1])) + 1
            whole = changes[-1] if len(changes) else 0
            if whole:
                yield links(combo[:whole], fp[:whole])
            combos, fps, size = [combo[whole:]], [fp[whole:]], len(combo) - whole
        if size:
            yield links(np.concatenate(combos), np.concatenate(fps))

    return rows


def links(prints: DataFrame, differ: int = 2) -> DataFrame:
    """(a, b) of distinct fingerprints ``prints`` (fp long): pairs that are connected by steps of ``differ`` bits at most, such that
    every two fingerprints that differ by so many bits are connected by them. Fewer than 28 for each fingerprint."""
    postings = F.explode(F.array(*[F.struct(F.lit(i).cast("byte").alias("combo"), F.col("fp").bitwiseAND(F.lit(_signed(~_mask(free) & ((1 << 64) - 1)))).alias("key")) for i, free in enumerate(_free_bytes(differ))]))
    index = prints.select("fp", postings.alias("x")).select("x.combo", "fp", "x.key")
    return index.repartition("key", "combo").sortWithinPartitions("combo", "key").select("combo", "fp").mapInArrow(_link_rows(differ), "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", differ: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): for each row of ``docs`` its fingerprint (long) and the smallest id that is reached by
    links, from its own on. Two rows are linked if their fingerprints differ in ``differ`` (1 or 2) bits at most.

    Null and empty texts have the fingerprint 0, which is linked like any other. Repeated rows come out as often as they went in.
    A null id takes part in links and is never the smallest; the component is null only if all its ids are. Ids are whole
    numbers. Other columns aren't used, whatever their names; an empty table gives no rows.
    """
    if differ not in (1, 2):
        raise ValueError("one or two bits may differ")
    small_batches(docs.sparkSession)
    rows = settle(docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(_fingerprint_rows, "doc_id long, fp long"))
    prints = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")))
    joined = settle(component_labels(settle(links(prints.select("fp"), differ))))
    least = joined.join(prints, F.col("id") == F.col("fp")).groupBy("component").agg(F.min("first").alias("component_id"))
    linked = joined.join(least, "component").select(F.col("id").alias("fp"), F.col("component_id").alias("least"))
    labels = settle(prints.join(linked, "fp", "left").select("fp", "copies", F.coalesce("least", "first").alias("component_id")))
    # A fingerprint that many rows have is no key of an exchange: these few meet their rows by a broadcast.
    often = labels.where(F.col("copies") * FREQUENT >= F.lit(rows.count()))
    common = F.broadcast(often.select("fp", "component_id"))
    others = rows.join(F.broadcast(often.select("fp")), "fp", "left_anti").join(labels.select("fp", "component_id"), "fp")
    return rows.join(common, "fp").unionByName(others).select("doc_id", "fp", "component_id")


def op12_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all ``documents``."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
