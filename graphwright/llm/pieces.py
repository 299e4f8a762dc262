"""SentencePiece encoding and decoding by a relational lattice.

A text is cut into units that no piece crosses: white space is U+2581 and stands before the word that follows it, and
characters that stand together in no piece, nor are joined by others that do, are in different units.
Units are encoded relationally: their substrings of the lengths of pieces that begin alike are exploded and
equi-joined to the piece table, which gives the lattice's edges; edges are grouped by unit, and a
higher-order ``aggregate`` folds them to the unit's pieces:

* a *unigram* model by Viterbi: edges in order of their ends; each place keeps the best score and where it came from;
* a *BPE* model by merges in rank order: an edge is applied if its span is exactly two present symbols. The
  places that are still borders are the bits of a long, and an edge is a long of its rank, its piece's id
  and its span's bits. (Viterbi over a BPE model's scores gives other pieces than the model's own merges; for the 32k
  model at hand it does for 59 % of distinct words.)

Units that are frequent, by counts over all texts, ``HOT_UNITS`` at most, are encoded first and sent to all tasks:
a bounded cache, which changes no result. All other units are encoded for the row they stand in:
(row key, unit) is dealt by row key, so edges are grouped where they arise. Rows then meet their
units' ids, and each text's ids are put together, by arrays over the distinct words of many texts. There a BPE model's units whose bits don't fit a long (of more
than 31 characters for 32k pieces) are merged by the same rule.
"""

from __future__ import annotations

import heapq
import pickle
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .settle import drop_settled, free_unused, lean, settle_alone, small_batches

SPACE = "▁"
#: Bounds of the cache, of words beside it in a worker's dict, and of those that a task holds before it reports their counts.
HOT_UNITS, WORDS, HELD = 1 << 17, 1 << 16, 1 << 22
#: The cache of op7_pieces, which has more of the driver's memory than a stage of a pipeline.
MORE_UNITS = 1 << 19
#: Single characters below are looked up in an array, others in the piece table.
NEAR = 0x250
#: First characters of a span that say what lengths it may have.
HEAD = 4
#: Rows that are handled at once within a batch, and bytes of their texts.
SLICE, SLICE_BYTES = 1024, 1 << 22
MOST_PIECES = 1 << 20
#: Texts whose units one task encodes, and the most tasks.
TASK_TEXTS, MOST_TASKS = 1000, 20_000


@dataclass
class PieceModel:
    """``pieces``: (piece, id, score) without control, unknown and byte pieces. ``byte``: the id of byte 0."""

    pieces: list[tuple[str, int, float]]
    kind: str
    byte: int | None
    unknown: int
    prefix: bool = True
    names: dict[int, str] = field(default_factory=dict)
    units: str = ""
    runs: str = ""

    def __post_init__(self):
        self.names = {i: p for p, i, _ in self.pieces}
        if len(self.pieces) >= MOST_PIECES or max(self.names, default=0) >= MOST_PIECES:
            raise ValueError("the piece table is too large to be broadcast")
        if any(len(p) > 1 and (set("\n\t") & set(p) or SPACE in p.lstrip(SPACE)) for p in self.names.values()):
            raise ValueError("a piece crosses the borders of units")
        self.units, self.runs = unit_pattern(self.names.values()), joined_runs(self.names.values())

    @property
    def longest(self) -> int:
        return max((len(p) for p in self.names.values()), default=1)

    @property
    def id_bits(self) -> int:
        """Bits of an edge for the rank, and as many for the id."""
        return (max([len(self.pieces), *self.names]) + 1).bit_length()

    @property
    def span_bits(self) -> int:
        """Bits that an edge has for the places of its unit."""
        return 63 - 2 * self.id_bits

    @property
    def longest_unit(self) -> int:
        """Characters of a unit that can be encoded relationally."""
        return self.span_bits - 2 if self.kind == "bpe" else 1 << 31

    def ranked(self) -> list[tuple[str, int]]:
        """(piece, id) of several characters, best score first."""
        return [(p, i) for p, i, _ in sorted(self.pieces, key=lambda x: -x[2]) if len(p) > 1]


def joined_runs(pieces) -> str:
    """A pattern of runs of characters that pieces join, directly or by others; empty where none do."""
    group: dict[str, set[str]] = {}
    for p in pieces:
        p = p.lstrip(SPACE)
        if len(p) > 1:
            joined = set().union(*(group.get(c, {c}) for c in p))
            for c in joined:
                group[c] = joined
    runs = sorted({"".join(sorted(g)) for g in group.values()}, key=lambda g: (-len(g), g))
    return "|".join("[" + "".join(re.escape(c) for c in g) + "]+" for g in runs)


def unit_pattern(pieces) -> str:
    """A pattern of units: after marks of spaces a run of characters that pieces join, or one other character."""
    runs = joined_runs(pieces)
    return f"{SPACE}*(?:{runs + '|' if runs else ''}[^{SPACE}])|{SPACE}+"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message: numbers and length-led bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        elif kind == 2:
            n = number()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            at += 4 if kind == 5 else 8


def load_model(path: str) -> PieceModel:
    """Reads a SentencePiece model with identity normalisation."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    spec = dict(_fields(dict(_fields(sp.serialized_model_proto())).get(2, b"")))
    rules = dict(_fields(dict(_fields(sp.serialized_model_proto())).get(3, b"")))
    if rules.get(2) or rules.get(4, 1):
        raise ValueError("only models with identity normalisation that keep white space can be used")
    ids = range(sp.get_piece_size())
    plain = [(sp.id_to_piece(i), i, float(sp.get_score(i))) for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    first = next((i for i in ids if sp.is_byte(i)), None)
    return PieceModel(plain, {1: "unigram", 2: "bpe"}.get(spec.get(3, 1), "other"), first, sp.unk_id(), bool(rules.get(3, 1)))


def marked(text: str, prefix: bool = True) -> str:
    return (SPACE if prefix else "") + text.replace(" ", SPACE) if text else ""


def units_of(text: str, model: PieceModel) -> list[str]:
    return re.findall(model.units, marked(text, model.prefix), re.S)


# The relational encoder


def piece_table(spark: SparkSession, model: PieceModel) -> DataFrame:
    """(piece, id, score, rank, hash), with an empty piece that every unit meets, so that none is lost. ``rank`` is the order
    of a BPE model's scores, equal ones alike; single characters, which merge nothing, come last, and near ones aren't there."""
    last = len(model.pieces)
    if model.kind == "bpe":
        scores = {i: s for _, i, s in model.pieces}
        place = {s: r for r, s in enumerate(sorted({scores[i] for _, i in model.ranked()}, reverse=True))}
        rows = [(p, i, scores[i], place[scores[i]]) for p, i in model.ranked()] + [(p, i, s, last) for p, i, s in model.pieces if len(p) == 1 and ord(p) >= NEAR]
    else:
        rows = [(*x, 0) for x in model.pieces]
    table = spark.createDataFrame([*rows, ("", 0, 0.0, last)], "piece string, id int, score double, rank long")
    return table.withColumn("hash", F.xxhash64("piece"))


def length_table(spark: SparkSession, model: PieceModel) -> DataFrame:
    """(head, lengths, head_hash): the HEAD first characters of pieces, and the lengths of the pieces that have them, HEAD at least."""
    heads: dict[str, set[int]] = {}
    for p in model.names.values():
        if len(p) >= HEAD:
            heads.setdefault(p[:HEAD], set()).add(len(p))
    table = spark.createDataFrame([(h, sorted(found)) for h, found in heads.items()], "head string, lengths array<int>")
    return table.withColumn("head_hash", F.xxhash64("head"))


def lattice(units: DataFrame, model: PieceModel, by: list[str]) -> DataFrame:
    """``by``, ``unit`` and ``edges`` of each row of ``units``: for a BPE model an array of longs (the rank, then the bits from
    start to end), else of (end, start, score, id). Rows are grouped without a shuffle if ``units`` is dealt by ``by``."""
    bpe = model.kind == "bpe"
    # The number of a row within its task keeps a unit's edges together: they come, and are sorted, in its order.
    numbered = units.withColumns({"__row": F.monotonically_increasing_id(), "n": F.length("unit")})
    starts = numbered.select("__row", *by, "unit", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    # Lengths of pieces with the start's first characters, and those of shorter ones: a span of another length is no piece.
    starts = starts.withColumn("first", F.expr(f"substring(unit, i + 1, {HEAD})")).withColumn("hash", F.xxhash64("first"))
    starts = starts.join(F.broadcast(length_table(units.sparkSession, model)), F.expr("hash = head_hash AND NOT (first < head OR first > head)"), "left")
    far = F.ascii(F.substring("unit", F.col("i") + 1, F.lit(1))) >= NEAR
    short = [F.lit(k) for k in range(1, HEAD)]
    least = F.when(F.col("i") == 0, F.array(F.lit(0), *short)).when(far | F.lit(not bpe), F.array(*short)).otherwise(F.array(*short[1:]))
    lengths = F.when(F.col("lengths").isNull(), least).otherwise(F.concat(least, "lengths"))
    spans = starts.select("__row", *by, "unit", "n", "i", F.explode(lengths).alias("k")).where(F.col("i") + F.col("k") <= F.col("n"))
    rows = spans.select("__row", *by, "unit", "i", (F.col("i") + F.col("k")).alias("j"), F.expr("substring(unit, i + 1, k)").alias("sub"))
    # Equality by a hash, which is probed ten times as fast as a string, and by neither string being less.
    met = rows.withColumn("hash", F.xxhash64("sub")).join(F.broadcast(piece_table(units.sparkSession, model)), "hash").where("NOT (sub < piece OR sub > piece)")
    code = F.shiftleft("rank", model.id_bits + model.span_bits) + F.shiftleft(F.col("id").cast("long"), model.span_bits)
    edge = code + F.expr("shiftleft(2L, j) - shiftleft(1L, i)") if bpe else F.struct("j", "i", "score", "id")
    unit = [] if "unit" in by else [F.first("unit").alias("unit")]
    return met.groupBy("__row", *by).agg(*unit, F.collect_list(edge).alias("edges")).drop("__row")


def _once(value: Column, use) -> Column:
    """``use(value)``, with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _spelt(i: Column, model: PieceModel) -> Column:
    """Ids of the character at ``i`` of the unit, which is no piece: its bytes, or the unknown id."""
    if model.byte is None:
        return F.array(F.lit(model.unknown))
    char = F.encode(F.substring(F.col("unit"), i + 1, F.lit(1)), "utf-8")
    return F.transform(F.sequence(F.lit(1), F.octet_length(char)), lambda b: F.conv(F.hex(F.substring(char, b, F.lit(1))), 16, 10).cast("int") + model.byte)


def _merged_ids(model: PieceModel) -> Column:
    """BPE: ids of the spans between the borders left after all edges, best rank first and leftmost first."""
    n = F.length("unit")
    long = lambda x: F.lit(x).cast("long")
    shift = lambda x, k: F.call_function("shiftleft", long(x), k)
    # Of pieces of one score the one that ends first is tried first.
    singles = {ord(p): i for p, i, _ in model.pieces if len(p) == 1 and ord(p) < NEAR}
    near = F.array(*[F.lit(singles.get(c, -1)) for c in range(NEAR)])
    id_of = lambda e: F.shiftright(e, model.span_bits).bitwiseAND((1 << model.id_bits) - 1).cast("int")

    def apply(mask, span):
        # The borders from the edge's start to its end: they are to be both of these and one between, which goes.
        between = span.bitwiseAND(F.shiftleft(span, 1)).bitwiseAND(F.shiftright(span, 1))
        one = (F.bit_count(mask.bitwiseAND(span)) == 3) & (F.bit_count(mask.bitwiseAND(between)) == 1)
        return F.when(one, mask.bitwiseAND(F.bitwise_not(between))).otherwise(mask)

    def ids(edges, borders, spans):
        def one_id(k):
            i, j = F.element_at(borders, k), F.element_at(borders, k + 1)
            listed = _once(F.array_position(spans, shift(2, j) - shift(1, i)).cast("int"), lambda at: F.when(at > 0, F.array(id_of(F.element_at(edges, at)))).otherwise(_spelt(i, model)))
            code = F.ascii(F.substring("unit", i + 1, F.lit(1)))
            return F.when(j - i > 1, listed).otherwise(_once(code, lambda c: F.when(c >= NEAR, listed).otherwise(_once(F.element_at(near, c + 1), lambda x: F.when(x >= 0, F.array(x)).otherwise(_spelt(i, model))))))

        return F.flatten(F.transform(F.sequence(F.lit(1), F.size(borders) - 1), one_id))

    return _once(F.sort_array("edges"), lambda edges: _once(
        F.transform(edges, lambda e: e.bitwiseAND(long((1 << model.span_bits) - 1))), lambda spans: _once(
            F.aggregate(spans, shift(2, n) - 1, apply), lambda mask: _once(
                F.filter(F.sequence(F.lit(0), n), lambda k: F.call_function("shiftright", mask, k).bitwiseAND(1) == 1), lambda borders: ids(edges, borders, spans)))))


def _best_ids(model: PieceModel) -> Column:
    """Unigram: ids of the path of the highest score; characters without a piece cost more than any piece."""
    n = F.length("unit")
    worst = min((s for *_, s in model.pieces), default=0.0) - 10.0
    kind = "struct<j:int,i:int,score:double,id:int>"
    chars = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i + 1).alias("j"), i.alias("i"), F.lit(worst).alias("score"), F.lit(-1).alias("id")).cast(kind))
    edges = F.array_sort(F.concat(F.filter("edges", lambda e: e["j"] > e["i"]).cast(f"array<{kind}>"), chars))
    state = "struct<scores:array<double>,back:array<struct<i:int,id:int>>,j:int,best:double,at:struct<i:int,id:int>>"
    start = F.struct(F.array(F.lit(0.0)).alias("scores"), F.array().cast("array<struct<i:int,id:int>>").alias("back"), F.lit(0).alias("j"), F.lit(0.0).alias("best"), F.struct(F.lit(0).alias("i"), F.lit(-1).alias("id")).alias("at")).cast(state)

    def apply(a, e):
        moved = e["j"] != a["j"]
        scores = F.when(moved & (a["j"] > 0), F.concat(a["scores"], F.array(a["best"]))).otherwise(a["scores"])
        back = F.when(moved & (a["j"] > 0), F.concat(a["back"], F.array(a["at"]))).otherwise(a["back"])
        found = F.element_at(scores, e["i"] + 1) + e["score"]
        better = moved | (found > a["best"])
        at = F.struct(e["i"].alias("i"), e["id"].alias("id"))
        return F.struct(scores.alias("scores"), back.alias("back"), e["j"].alias("j"), F.when(better, found).otherwise(a["best"]).alias("best"), F.when(better, at).otherwise(a["at"]).alias("at")).cast(state)

    def path(back):
        begin = F.struct(n.alias("at"), F.array().cast("array<int>").alias("ids"))
        step = lambda a, _: F.when(a["at"] == 0, a).otherwise(_once(F.element_at(back, a["at"]), lambda b: F.struct(b["i"].alias("at"), F.concat(F.when(b["id"] >= 0, F.array(b["id"])).otherwise(_spelt(b["i"], model)), a["ids"]).alias("ids"))))
        return F.aggregate(F.sequence(F.lit(1), n), begin, step, lambda a: a["ids"])

    return _once(F.aggregate(edges, start, apply), lambda a: _once(F.concat(a["back"], F.array(a["at"])), path))


def bpe_ids(unit: str, byte: int | None, unknown: int, table: dict[str, tuple[int, float]]) -> list[int]:
    """The merges of one unit, best rank first and leftmost first, with a heap: for units of any length."""
    left, right, text = list(range(-1, len(unit) - 1)), [*range(1, len(unit)), -1], list(unit)
    heap: list[tuple[float, int, int, str]] = []

    def offer(i: int) -> None:
        j = right[i]
        if i >= 0 and j >= 0 and (got := table.get(text[i] + text[j])) is not None:
            heapq.heappush(heap, (-got[1], i, j, text[i] + text[j]))

    for i in range(len(unit) - 1):
        offer(i)
    while heap:
        _, i, j, both = heapq.heappop(heap)
        if right[i] != j or not text[i] or text[i] + text[j] != both:
            continue
        text[i], text[j], right[i] = both, "", right[j]
        if right[j] >= 0:
            left[right[j]] = i
        offer(left[i])
        offer(i)
    out: list[int] = []
    for s in text:
        if s:
            out += [table[s][0]] if s in table else [byte + b for b in s.encode()] if byte is not None else [unknown]
    return out


def encode_units(units: DataFrame, model: PieceModel, by: list[str]) -> DataFrame:
    """``by``, ``unit`` and ``ids`` array<int> for each row of ``units``, dealt by ``by``. Units aren't empty, and have
    ``longest_unit`` characters at most."""
    found = lattice(units, model, by)
    return found.select(*dict.fromkeys([*by, "unit"]), (_merged_ids if model.kind == "bpe" else _best_ids)(model).alias("ids"))


# Texts

_cache: dict[int, tuple[dict[str, bytes], dict[str, bytes], int]] = {}
_tables: dict[int, tuple[dict[str, tuple[int, float]], list[bytes]]] = {}


def slices(batch: pa.RecordBatch, place: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of SLICE rows and SLICE_BYTES in the column at ``place`` at most, or of one row."""
    ends, at = np.cumsum(pc.binary_length(batch.column(place)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while at < batch.num_rows:
        fit = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right"))
        to = min(at + SLICE, max(at + 1, fit))
        yield batch.slice(at, to - at)
        at = to


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """What stands between the spaces of all texts in turn; where each text's begins, and the end."""
    lists = pc.split_pattern(texts, " ")
    return lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)])


def _rows_of(places: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The texts in which the words at these places stand."""
    return np.searchsorted(ends, places, "right") - 1


def _worded(texts: pa.Array, prefix: bool) -> tuple[pa.Array, np.ndarray, list[int]]:
    """The words of all texts in turn, each to be led by the mark of a space; where each text's begin, and the end; and the texts where
    spaces don't just stand between words, which have no words here."""
    words, ends = _split(texts)
    odd = _rows_of(np.flatnonzero(pc.binary_length(words).to_numpy(zero_copy_only=False) == 0), ends) if prefix else np.flatnonzero(texts.is_valid())
    if len(odd):
        other = np.zeros(len(texts), bool)
        other[odd] = True
        words, ends = _split(pc.if_else(pa.array(other), pa.scalar(None, texts.type), texts))
    return words, ends, sorted(set(odd.tolist()))


def _strings(values: pa.Array) -> list[str]:
    """``values.to_pylist()`` of texts that aren't null, at a tenth of its time."""
    return values.to_numpy(zero_copy_only=False).tolist()


def _units_in(find: Callable[[str], list[str]], words: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The units of all words in turn, which of them a mark leads, and the numbers of their words."""
    if any(SPACE in w for w in words):  # their units aren't told from the next word's by the mark
        found = [(k, u) for k, w in enumerate(words) for u in find(SPACE + w)]
        units, of = pa.array([u for _, u in found], pa.string()), np.array([k for k, _ in found], np.int64)
        return units, pc.starts_with(units, SPACE).to_numpy(zero_copy_only=False), of
    units = pa.array(find(SPACE + SPACE.join(words)) if words else [], pa.string())
    led = pc.starts_with(units, SPACE).to_numpy(zero_copy_only=False)
    return units, led, np.cumsum(led) - 1


def _ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of ``values``, one after the other."""
    return values[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]


class _Known:
    """Strings of 31 bytes at most, looked up many at once: by hash, then compared in whole. Of strings with one hash only
    one is found, so one that isn't found may still be there."""

    def __init__(self, strings: pa.Array):
        table, _ = self._rows(strings)
        hashes = self._hashes(table)
        self.order = np.argsort(hashes)
        self.hashes, self.table = hashes[self.order], table[self.order]

    @staticmethod
    def _rows(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each string as four numbers, its length the last byte; and whether it fits. Those that don't are all alike."""
        strings = strings.cast(pa.string())
        size = pc.binary_length(strings).to_numpy(zero_copy_only=False).astype(np.int64)
        fits, out = size < 32, np.zeros((len(size), 32), np.uint8)
        if len(size):
            starts = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(size)].astype(np.int64)
            n, data = np.where(fits, size, 0), strings.buffers()[2]
            if n.any():
                within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                out.ravel()[np.repeat(np.arange(len(size)) * 32, n) + within] = np.frombuffer(data, np.uint8)[np.repeat(starts, n) + within]
            out[:, 31] = np.where(fits, size, 255)
        return out.view(np.uint64), fits

    @staticmethod
    def _hashes(rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.uint64)
        for k in range(4):
            out = (out ^ rows[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def find(self, strings: pa.Array) -> np.ndarray:
        """The number of each string among those of the table, or -1."""
        if not len(self.order) or not len(strings):
            return np.full(len(strings), -1)
        rows, fits = self._rows(strings)
        hashes = self._hashes(rows)
        order, at = np.argsort(hashes), np.empty(len(rows), np.int64)
        at[order] = np.searchsorted(self.hashes, hashes[order]).clip(max=len(self.order) - 1)
        return np.where(fits & (self.table[at] == rows).all(axis=1), self.order[at], -1)


_known: dict[int, tuple[_Known, _Known, np.ndarray, np.ndarray, np.ndarray]] = {}


def _known_units(table: bytes, mark: int) -> tuple[_Known, _Known, np.ndarray, np.ndarray, np.ndarray]:
    """The worker's own cache: its units that a mark leads, without it; its others; all their ids, in this order; and where each
    one's begin, and how many they are."""
    if mark not in _known:
        _known.clear()
        units, raw = (c.combine_chunks() for c in pa.ipc.open_stream(table).read_all().columns)
        led = pc.starts_with(units, SPACE)
        raw = pa.chunked_array([raw.filter(led), raw.filter(pc.invert(led))], pa.binary())
        size = pc.binary_length(raw).to_numpy().astype(np.int64) // 4
        _known[mark] = _Known(pc.utf8_slice_codeunits(units.filter(led), 1)), _Known(units.filter(pc.invert(led))), np.frombuffer(b"".join(raw.to_numpy().tolist()), np.int32), np.cumsum(size) - size, size
    return _known[mark]


def _find_units(words: _Known, inner: _Known, units: pa.Array, led: np.ndarray) -> np.ndarray:
    """The numbers of units in the cache, or -1."""
    out = np.empty(len(units), np.int64)
    out[led] = words.find(pc.utf8_slice_codeunits(units.filter(pa.array(led)), 1))
    found = inner.find(units.filter(pa.array(~led)))
    out[~led] = np.where(found < 0, -1, found + len(words.order))
    return out


def _id_bytes(ids: pa.Array) -> list[bytes]:
    """The ids of each list, as bytes of 32-bit numbers."""
    raw, at = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32).tobytes(), np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))]) * 4
    return [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _cached(table: bytes, mark: int) -> tuple[dict[str, bytes], dict[str, bytes], int]:
    """The worker's own dicts, for texts with odd spaces, which are read only where there are such: ids of words, which are the cache's units
    without the mark of a space that leads them; ids of its other units; and how many words there may be, if a caller adds some."""
    if mark not in _cache:
        _cache.clear()
        words: dict[str, bytes] = {}
        inner: dict[str, bytes] = {}
        for batch in pa.ipc.open_stream(table):
            for unit, ids in zip(_strings(batch.column(0)), _strings(batch.column(1)), strict=True):
                if unit[0] == SPACE:
                    words[unit[1:]] = ids
                else:
                    inner[unit] = ids
        _cache[mark] = words, inner, len(words) + WORDS
    return _cache[mark]


def _unpacked(tables: bytes, mark: int) -> tuple[dict[str, tuple[int, float]], list[bytes]]:
    """The worker's own piece table and spellings, which are read once, not in every task."""
    if mark not in _tables:
        _tables.clear()
        _tables[mark] = pickle.loads(tables)
    return _tables[mark]


def _spelt_by(spelling: list[bytes], raw: bytes, text: str) -> bool:
    """Whether ids, as bytes, spell a text with marks for spaces."""
    return b"".join([spelling[i] for i in np.frombuffer(raw, np.int32).tolist()]) == text.encode("utf-8", "surrogatepass")


def _unit_counts(docs: DataFrame, model: PieceModel, held: int) -> DataFrame:
    """(unit, n): how often each unit that can be in the cache occurs in all texts."""
    pattern, runs, prefix, longest = model.units, model.runs, model.prefix, min(64, model.longest_unit)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, seen, words, many = re.compile(pattern, re.S).findall, Counter(), [], 0

        def report() -> Iterator[pa.RecordBatch]:
            found = pc.value_counts(pa.chunked_array(words, pa.string()))
            words.clear()
            values, counts = found.field("values"), found.field("counts")
            one = pc.match_substring_regex(values, f"^(?:{runs})$") if runs else pa.array(np.zeros(len(values), bool))
            alone = pc.binary_join_element_wise(SPACE, values.filter(one), "")
            short = pc.less_equal(pc.utf8_length(alone), longest)
            yield pa.RecordBatch.from_arrays([alone.filter(short), counts.filter(one).filter(short)], names=["unit", "n"])
            values, times = values.filter(pc.invert(one)), counts.filter(pc.invert(one)).to_pylist()
            for at in range(0, len(values), 1 << 16):
                units, _, of = _units_in(find, _strings(values.slice(at, 1 << 16)))
                for k, unit in zip(of.tolist(), _strings(units), strict=True):
                    seen[unit] += times[at + k]
            some = [u for u in seen if len(u) <= longest]
            yield pa.RecordBatch.from_pydict({"unit": pa.array(some, pa.string()), "n": pa.array([seen[u] for u in some], pa.int64())})
            seen.clear()

        for batch in batches:
            for part in slices(batch, 0):
                texts = part.column(0)
                plain, _, odd = _worded(texts, prefix)
                for k in odd:
                    seen.update(find(marked(texts[k].as_py(), prefix)))
                words.append(plain.cast(pa.string()))
                many += len(plain)
                if many + len(seen) >= held:
                    yield from report()
                    many = 0
        yield from report()

    return docs.select("text").mapInArrow(lean(counted), "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def _hot(docs: DataFrame, model: PieceModel, rows: int, most_units: int, held: int) -> tuple[bytes, int]:
    """The cache, as a compressed Arrow stream: units that occur most in all of ``docs``, twice at least, and their ids as bytes. Units
    that their ids don't spell aren't in it. A task that holds ``held`` words reports their counts and starts anew, so
    sums are exact; ``rows`` is the number of texts, none of which need no job."""
    counts = settle_alone(_unit_counts(docs, model, held).where("n > 1")) if rows else None
    spelling, cache = spellings(model), pa.schema({"unit": pa.string(), "ids": pa.binary()})

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(u, i) for u, i in zip(batch.column(0).to_pylist(), _id_bytes(batch.column(1)), strict=True) if _spelt_by(spelling, i, u)]
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in pairs], pa.string()), pa.array([i for _, i in pairs], pa.binary())], schema=cache)

    if counts is None:
        got = cache.empty_table()
    else:
        # Each count up to 22 has a size of its own; there are 1,008 sizes at most.
        size = F.floor(F.log2("n") * 16)
        sizes = {r["size"]: r["c"] for r in counts.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("c")).collect()}
        least, total = max(sizes, default=0) + 1, 0
        for one in sorted(sizes, reverse=True):
            if total + sizes[one] > most_units:
                break
            least, total = one, total + sizes[one]
        got = encode_units(counts.where(size >= least).select("unit").repartition("unit"), model, ["unit"]).mapInArrow(spelt, "unit string, ids binary").toArrow()
        drop_settled(counts)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, cache, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(got.cast(cache).combine_chunks(), max_chunksize=1 << 16)
    raw = sink.getvalue().to_pybytes()
    return raw, hash(raw)


def decode_ids(ids: list[int], model: PieceModel) -> str:
    """The text of ids: pieces as they are, runs of byte pieces as UTF-8; the leading space is taken off."""
    out = bytearray()
    for i in ids:
        if model.byte is not None and model.byte <= i < model.byte + 256:
            out.append(i - model.byte)
        else:
            out += model.names.get(i, "").encode()
    text = out.decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:] if model.prefix and text.startswith(" ") else text


def spellings(model: PieceModel) -> list[bytes]:
    """The bytes of each id, up to the highest; none for ids without a spelling."""
    out = [b""] * (max([*model.names, model.unknown, (model.byte or 0) + 255]) + 1)
    for i, p in model.names.items():
        out[i] = p.encode()
    for b in range(256 if model.byte is not None else 0):
        out[model.byte + b] = bytes([b])
    return out


def encode(docs: DataFrame, model: PieceModel, text_col: str = "text", most_units: int | None = None) -> DataFrame:
    """``docs`` with ``ids`` array<int> and ``exact`` boolean (decoding gives the text back); columns of these
    names are replaced, others pass through.

    A null text has null ids and null ``exact``; an empty text has no ids and is exact. A text with
    U+2581 itself isn't exact, as the model's form of a space is that sign. Repeated rows are encoded each.
    ``most_units`` (HOT_UNITS) bounds the cache, which changes no result.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("ids", "exact")]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    # Copies of a text are dealt by their other columns too, so no key has more rows than repeated rows.
    plain_kind = lambda t: not isinstance(t, (T.MapType, T.StructType, T.ArrayType, T.VariantType))
    keyed = docs.withColumn("__key", F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if plain_kind(f.dataType)]))
    plain = keyed.select("__key", F.col(f"`{text_col}`").alias("text"))
    number = plain.count()
    hot, mark = _hot(plain.where("text IS NOT NULL"), model, number, HOT_UNITS if most_units is None else most_units, HELD)
    pattern, prefix, most = model.units, model.prefix, model.longest_unit
    byte, unknown = model.byte, model.unknown
    packed = pickle.dumps(({p: (i, s) for p, i, s in model.pieces}, spellings(model)))
    packed_mark = hash(packed)
    free_unused()

    def cold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (words, inner, *_), find = _known_units(hot, mark), re.compile(pattern, re.S).findall
        for part in (p for batch in batches for p in slices(batch, 1)):
            keys, texts = part.columns
            all_words, ends, odd = _worded(texts, prefix)
            all_words = all_words.dictionary_encode()
            # Units of words that aren't in the cache.
            missing = np.flatnonzero(words.find(all_words.dictionary) < 0)
            units, led, of = _units_in(find, _strings(all_words.dictionary.take(pa.array(missing))))
            new = (_find_units(words, inner, units, led) < 0) & pc.less_equal(pc.utf8_length(units), most).to_numpy(zero_copy_only=False)
            units, size = units.filter(pa.array(new)).dictionary_encode(), np.bincount(missing[of[new]], minlength=len(all_words.dictionary))
            need, names = units.indices.to_numpy(zero_copy_only=False).astype(np.int64), units.dictionary
            # Words with such units, text by text; then their units, each once a text.
            numbers = all_words.indices.to_numpy(zero_copy_only=False)
            at = np.flatnonzero(size[numbers])
            n = size[numbers[at]]
            rows, need = np.repeat(_rows_of(at, ends), n), _ragged(need, (np.cumsum(size) - size)[numbers[at]], n)
            if odd:
                known, others, _ = _cached(hot, mark)
                more = [(k, u) for k in odd for u in set(find(marked(texts[k].as_py(), prefix))) if len(u) <= most and (u[1:] not in known if u[0] == SPACE else u not in others)]
                rows, need = np.concatenate([rows, np.array([k for k, _ in more], np.int64)]), np.concatenate([need, np.arange(len(names), len(names) + len(more))])
                names = pa.concat_arrays([names, pa.array([u for _, u in more], pa.string())])
            rows, need = np.divmod(np.unique(rows * len(names) + need), max(1, len(names)))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows)), names.take(pa.array(need))], names=["key", "unit"])

    # A task groups the edges of its units in memory, so tasks are small; beyond MOST_TASKS they grow, and spill.
    tasks = max(1, min(MOST_TASKS, -(-number // TASK_TEXTS)))
    rest = plain.mapInArrow(cold, "key long, unit string").repartition(tasks, "key")
    own = encode_units(rest, model, ["key"]).groupBy("key").agg(F.collect_list("unit").alias("__units"), F.collect_list("ids").alias("__ids"))
    own = own.withColumnRenamed("key", "__own")
    joined = keyed.join(own, F.col("__key") == F.col("__own"), "left").drop("__key", "__own")
    place = kept.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (words, inner, cached_ids, begin, count), find = _known_units(hot, mark), re.compile(pattern, re.S).findall
        table, spelling = _unpacked(packed, packed_mark)
        for part in (p for batch in batches for p in slices(batch, place)):
            texts, units, ids = part.column(place), part.column(len(kept)), part.column(len(kept) + 1)
            # A unit has the same ids in every row.
            mine = dict(zip(_strings(units.flatten()), _id_bytes(ids.flatten()), strict=True))

            def unit_ids(u: str) -> bytes:
                if (got := mine.get(u)) is None:
                    got = mine[u] = np.array(bpe_ids(u, byte, unknown, table), np.int32).tobytes()  # longer than ``most``
                return got

            all_words, ends, odd = _worded(texts, prefix)
            all_words = all_words.dictionary_encode()
            numbers, names = all_words.indices.to_numpy(zero_copy_only=False), all_words.dictionary
            # Decoding joins the spellings of ids, so a text is exact if each of its words is. A word with a mark in it isn't.
            exact, wrong = np.ones(len(texts), bool), pc.match_substring(names, SPACE).to_numpy(zero_copy_only=False).copy()
            at = words.find(names)
            missing = np.flatnonzero(at < 0)
            units, led, of = _units_in(find, _strings(names.take(pa.array(missing))))
            known = _find_units(words, inner, units, led)
            fresh, more = np.flatnonzero(known < 0), []
            for k, u in zip(missing[of[fresh]].tolist(), _strings(units.take(pa.array(fresh))), strict=True):
                more.append(got := unit_ids(u))
                wrong[k] |= not _spelt_by(spelling, got, u)  # the cache's units are spelt by their ids
            if wrong.any():
                exact[_rows_of(np.flatnonzero(wrong[numbers]), ends)] = False
            if odd:
                others = _cached(hot, mark)
                for k in odd:
                    whole = marked(text := texts[k].as_py(), prefix)
                    more.append(b"".join([others[0].get(u[1:]) or unit_ids(u) if u[0] == SPACE else others[1].get(u) or unit_ids(u) for u in find(whole)]))
                    exact[k] = SPACE not in text and _spelt_by(spelling, more[-1], whole)
            # Ids of the cache and those that aren't in it; then those of words of several units; then those of texts, an odd one being a word.
            pool, size = np.concatenate([cached_ids, np.frombuffer(b"".join(more), np.int32)]), np.concatenate([count, np.fromiter(map(len, more), np.int64, len(more)) // 4])
            start = np.cumsum(size) - size
            known[fresh] = len(count) + np.arange(len(fresh))
            joined = _ragged(pool, start[known], size[known])
            own = np.bincount(of, weights=size[known], minlength=len(missing)).astype(np.int64)
            word_start, word_size = start[at], size[at]
            word_start[missing], word_size[missing] = len(pool) + np.cumsum(own) - own, own
            if odd:
                numbers = np.insert(numbers, ends[odd], len(names) + np.arange(len(odd)))
                ends[1:] += np.cumsum(np.isin(np.arange(len(texts)), odd))
                word_start, word_size = np.concatenate([word_start, start[-len(odd) :]]), np.concatenate([word_size, size[-len(odd) :]])
            n = word_size[numbers]
            at = np.concatenate([[0], np.cumsum(n)])
            flat = _ragged(np.concatenate([pool, joined]), word_start[numbers], n)
            null = texts.is_null()
            lists = pa.ListArray.from_arrays(pa.array(at[ends], pa.int32()), pa.array(flat), mask=null)
            yield pa.RecordBatch.from_arrays([*part.columns[:-2], lists, pc.if_else(null, pa.scalar(None, pa.bool_()), pa.array(exact))], names=[*kept, "ids", "exact"])

    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("exact", T.BooleanType())])
    return joined.mapInArrow(rows, schema)


def decode(df: DataFrame, model: PieceModel, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``decoded`` string of the ids; null ids give null."""
    back = F.udf(lambda ids: None if ids is None else decode_ids(list(ids), model), "string", useArrow=True)
    return df.withColumn("decoded", back(F.col(f"`{ids_col}`")))


def op7_pieces(spark, sf_dir: str, model_path: str = "/opt/tokenizers/piece_bpe_32k.model") -> DataFrame:
    """Piece ids of the whole text of every one of ``documents``, and whether they decode to it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode(docs, load_model(model_path), most_units=MORE_UNITS)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "exact")
