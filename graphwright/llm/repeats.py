"""Periodic run detection: repeated k-gram masking, then Main-Lorentz on what survives.

A run is a stretch of words with smallest period q (words q apart are equal), of at least ``least_words`` words and
``least_periods`` periods, that no neighbouring word extends. Of a run of length L the words up to L - q from its
start stand q further on again, so the run is covered by k-grams that occur twice in the document, for k = the least
overlap L - q that a run of any period has. Words outside all repeated k-grams can't be in a run; what is left falls
into segments, and a run lies within one segment as a whole.

Segments are halved, and the halves again. A run that crosses the middle of a segment has half of its
least length on one side of it, so for each period there is one test on each side: is a stretch of so many
words equal to that one period further? What passes is extended to both ends. All segments of a slice of documents
are tested and extended at once, by hashes of stretches of words; words themselves are told apart exactly, and
each run that is found is compared word by word in the end. (A document of which one doesn't hold is done again
by comparing words for every period; equal stretches have equal hashes, so no run is missed.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .settle import small_batches
from .textvec import mix, powers

U = np.uint64
#: White space between words: 0x20 and 0x09-0x0D, which is what bytes.split() splits by.
SPACE = r"[\x20\x09-\x0D]+"
#: Documents are taken together up to so many words, one document at least.
SLICE_WORDS = 1 << 17
_BASE, _GRAM = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)

RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def least_overlap(least_words: int, least_periods: int) -> int:
    """The least length without one period of any run: max(least_words, least_periods * q) - q for the best q."""
    return min(max(least_words, least_periods * q) - q for q in range(1, least_words + 1))


def _marked(ids: np.ndarray, owner: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in a k-gram that occurs twice or more in the same document."""
    n = len(ids) - k + 1
    out = np.zeros(len(ids) + 1, np.int64)
    if n > 0:
        grams = np.zeros(n, U)
        spread = mix(ids.astype(U))
        for j in range(k):
            grams = grams * U(_GRAM) + spread[j : j + n]
        grams = mix(grams ^ mix(owner[:n].astype(U) + U(1)))
        within = owner[:n] == owner[k - 1 :]  # not across documents
        _, place, times = np.unique(grams[within], return_inverse=True, return_counts=True)
        at = np.flatnonzero(within)[times[place] > 1]
        np.add.at(out, at, 1)
        np.add.at(out, at + k, -1)
    return np.cumsum(out[:-1]) > 0


class _Stretches:
    """Equality of stretches of words by hashes of their prefixes."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        self.total = np.zeros(n + 1, U)
        np.cumsum(mix(ids.astype(U) + U(7)) * powers(_BASE, n), out=self.total[1:])
        self.back = powers(_INVERSE, n + 1)

    def equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        one = (self.total[a + n] - self.total[a]) * self.back[a]
        return one == (self.total[b + n] - self.total[b]) * self.back[b]

    def forward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """For how many words, ``most`` at most, those from a on equal those from b on."""
        low, high = np.zeros_like(a), most.copy()
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.equal(a, b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def backward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The same for the words before a and b."""
        low, high = np.zeros_like(a), most.copy()
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.equal(a - mid, b - mid, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def _ranges(sizes: np.ndarray) -> np.ndarray:
    """0 .. size - 1 for each size, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _segment_runs(ids: np.ndarray, first: np.ndarray, last: np.ndarray, least_words: int, least_periods: int) -> np.ndarray:
    """(start, end, period) of the runs within the segments [first, last) of ``ids``."""
    words = _Stretches(ids)
    low, high, left, right = first, last, first, last
    found = [np.empty((0, 3), np.int64)]
    while len(low):
        middle = (low + high) >> 1
        # Each node of this level with each period that a run within it can have.
        each = (high - low) // least_periods
        node, q = np.repeat(np.arange(len(low)), each), _ranges(each) + 1
        c, l, r = middle[node], left[node], right[node]
        # Half of the run's least length lies on one side of the middle; all but q of these words equal those a period further.
        half = (least_periods * q + 1) // 2
        stretch = half - q
        before, after = c - half >= l, c + half <= r
        hit = np.zeros(len(q), bool)
        hit[before] = words.equal((c - half)[before], (c - stretch)[before], stretch[before])
        hit[after] |= words.equal(c[after], (c + q)[after], stretch[after])
        for shift in (0, -1):
            a = c[hit] + shift * q[hit]  # words from a and those from a + q on: the run has a whole period on that side
            b, l_, r_ = a + q[hit], l[hit], r[hit]
            ok = (a >= l_) & (b <= r_)
            a, b, l_, r_, p = a[ok], b[ok], l_[ok], r_[ok], q[hit][ok]
            start, end = a - words.backward(a, b, a - l_), b + words.forward(a, b, r_ - b)
            long = end - start >= np.maximum(least_words, least_periods * p)
            found.append(np.stack([start[long], end[long], p[long]], 1))
        keep = high - low >= 2 * max(2, least_words)
        low, high = np.concatenate([low[keep], middle[keep]]), np.concatenate([middle[keep], high[keep]])
        left, right = np.tile(left[keep], 2), np.tile(right[keep], 2)
    every = np.concatenate(found)
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    # Of the periods that one stretch has, the smallest comes first.
    return every[np.r_[True, (every[1:, :2] != every[:-1, :2]).any(1)]] if len(every) else every


def _runs_by_words(ids: np.ndarray, least_words: int, least_periods: int) -> np.ndarray:
    """The same for one whole document, by comparing words for every period."""
    best: dict[tuple[int, int], int] = {}
    for q in range(1, len(ids) // least_periods + 1):
        same = np.diff((ids[q:] == ids[:-q]).astype(np.int8), prepend=0, append=0)
        for s, e in zip(np.flatnonzero(same == 1).tolist(), (np.flatnonzero(same == -1) + q).tolist(), strict=True):
            if e - s >= max(least_words, least_periods * q):
                best.setdefault((s, e), q)
    return np.array(sorted((s, e, q) for (s, e), q in best.items()), np.int64).reshape(-1, 3)


def runs_of(docs: list[np.ndarray], least_words: int, least_periods: int) -> list[np.ndarray]:
    """For each document, given as numbers of its words, the (start, end, period) of its runs by start, then period."""
    if not docs:
        return []
    ids = np.concatenate(docs)
    begins = np.cumsum([0, *map(len, docs)])
    owner = np.repeat(np.arange(len(docs)), np.diff(begins))
    marked = _marked(ids, owner, least_overlap(least_words, least_periods))
    step = np.diff(marked.astype(np.int8), prepend=0, append=0)
    turn = np.flatnonzero(np.diff(owner) != 0) + 1
    cut = turn[marked[turn] & marked[turn - 1]] if len(turn) else turn  # segments end with their document
    first = np.sort(np.concatenate([np.flatnonzero(step == 1), cut]))
    last = np.sort(np.concatenate([np.flatnonzero(step == -1), cut]))
    found = _segment_runs(ids, first, last, least_words, least_periods)
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    at = np.searchsorted(found[:, 0], begins)
    out = []
    for d, own in enumerate(docs):
        mine = found[at[d] : at[d + 1]] - [begins[d], begins[d], 0]
        if not all(np.array_equal(own[s : e - q], own[s + q : e]) for s, e, q in mine.tolist()):
            mine = _runs_by_words(own, least_words, least_periods)
        out.append(mine)
    return out


def _numbers(texts: list[bytes]) -> tuple[list[list[bytes]], list[np.ndarray]]:
    """The words of each text, and the same as numbers: equal for equal words."""
    known: dict[bytes, int] = {}
    words = [t.split() for t in texts]
    return words, [np.fromiter((known.setdefault(w, len(known)) for w in each), np.int64, len(each)) for each in words]


def _slices(texts: list[bytes]) -> Iterator[list[bytes]]:
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t) // 6 + 1
        if size >= SLICE_WORDS:
            yield some
            some, size = [], 0
    if some:
        yield some


def _run_rows(least_words: int, least_periods: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, counts, kept = [], [], []
            for texts in _slices([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]):
                words, numbers = _numbers(texts)
                for own, found in zip(words, runs_of(numbers, least_words, least_periods), strict=True):
                    runs.append([{"start": s, "length": e - s, "period": q} for s, e, q in found.tolist()])
                    counts.append(len(own))
                    drop = np.zeros(len(own), bool)
                    for s, e, q in found.tolist():
                        drop[s + q : e] = True
                    kept.append(b" ".join([w for w, d in zip(own, drop.tolist(), strict=True) if not d] if len(found) else own).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, _RUN), pa.array(kept, pa.string())], names=["__row", "n_words", "runs", "collapsed"])

    return rows


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = 6, least_periods: int = 4) -> DataFrame:
    """(key, n_words, runs, collapsed): a row for each row of ``docs``, with the runs of its text (start in words from 0, length and
    period in words; by start, then period) and the text without what repeats: the words joined by one space, of each
    run only the first period.

    Null and empty texts have no words, no runs and an empty ``collapsed``. Repeated rows and null keys stay rows of
    their own. Other columns aren't used, whatever their names. The work for a text of n words is n log n; a text is
    handled as a whole in one task. ``least_periods`` is 2 at least.
    """
    if least_periods < 2 or least_words < 2:
        raise ValueError("a run has two words and two periods at least")
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(F.col(f"`{key}`").alias("__row"), F.col(f"`{text}`").alias("__text")).mapInArrow(_run_rows(least_words, least_periods), f"__row {kind}, n_words long, runs {RUN}, collapsed string")
    return found.withColumnRenamed("__row", key)


def planted(doc_id: Column, text: Column) -> Column:
    """The text with a periodic end, in a tenth of the documents, as the query's contract has it: h = crc32(doc_id); where h % 10 = 0
    and there are words, each word i >= a becomes word a + (i - a) % p, with g = h div 10, a = g % n, p = 1 + (n - a) div (3 + g % 8)."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def of_words(words: Column) -> Column:
        n = F.nullif(F.size(words).cast("long"), F.lit(0).cast("long"))
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        place = lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))
        return F.when(n.isNotNull(), F.array_join(F.transform(words, place), " "))

    changed = F.element_at(F.transform(F.array(F.filter(F.split(text, SPACE), lambda w: w != "")), of_words), 1)
    return F.when((h % 10 == 0) & text.isNotNull(), F.coalesce(changed, text)).otherwise(text)


def op11_runs(spark, sf_dir: str) -> DataFrame:
    """The runs of every text of ``documents``, planted as the contract has it: their number, the longest one, digests of all runs and
    of the text without repeats. A null doc_id has no hash, so its text stays as it is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = periodic_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    found = found.withColumn("best", longest)
    best = F.col("best")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-best["start"]).alias("start"),
        best["length"].alias("length"),
        (-best["period"]).alias("period"),
        F.floor(F.lit(1000) * best["length"] / -best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
