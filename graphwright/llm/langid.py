"""Language of texts by a linear-chain conditional random field over their words.

A word's features are its character 2- and 3-grams with the word's borders, its prefixes and suffixes of
2 to 4 letters, and its place in lexicons of each language's frequent words. Transitions between the
labels of neighbouring words are learned with them. Forward-backward gives each word's label
probabilities, so code-switched text is labelled word by word; a text's language has the highest mean.

Training runs on the driver over a bounded sample (``SAMPLE_DOCS`` different texts, an equal share for every
language; of a longer text a passage of ``SAMPLE_CHARS`` characters), spliced into code-switched sequences so that
transitions see switches. Labelling runs over whole texts in Arrow batches: words of many texts are
handled at once, long sequences by products of transfer matrices over blocks of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .settle import free_unused, lean, small_batches
from .textvec import mix, span_hashes

#: Rows of the weights that a step of the fit changes at once, as training is on the driver.
UPDATED = 1 << 13
SAMPLE_DOCS, SAMPLE_CHARS = 400, 5_000
BUCKETS = 1 << 16
LEXICON_WORDS = 300
BLOCK = 64
#: Characters of the texts that are labelled at once, and rows of a batch that are held as texts.
RUN_CHARS, SLICE = 1 << 18, 512
ROUNDS, RATE, DECAY = 20, 0.15, 1e-4
UNDETERMINED = "und"
_ALPHA = np.fromiter((chr(i).isalpha() for i in range(0x10000)), bool, 0x10000)
U = np.uint64


@dataclass
class Words:
    """Words of some texts: ``grams`` are buckets of character n-grams, those of word i in
    ``grams[gram_at[i]:gram_at[i + 1]]``; ``affixes`` has a row of buckets a word; ``begins`` says where
    each text's words begin."""

    grams: np.ndarray
    gram_at: np.ndarray
    affixes: np.ndarray
    hashes: np.ndarray
    begins: np.ndarray


def _letters(codes: np.ndarray) -> np.ndarray:
    out = _ALPHA[np.minimum(codes, 0xFFFF)]
    if (high := codes > 0xFFFF).any():
        values, back = np.unique(codes[high], return_inverse=True)
        out[high] = np.array([chr(v).isalpha() for v in values])[back]
    return out


def _bucket(x: np.ndarray) -> np.ndarray:
    return (mix(x) >> U(48)).astype(np.int32) & (BUCKETS - 1)


def words_of(texts: list[str]) -> Words:
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer((" ".join(["", *lowered, " "])).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = _letters(codes)
    edges = np.diff(letters.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    text_at = np.cumsum([1, *[len(t) + 1 for t in lowered]])
    begins = np.searchsorted(starts, text_at)
    c = np.where(letters, codes, 0).astype(U)
    two = c[:-1] * U(0x1F123BB5) + c[1:] + U(1 << 60)
    three = c[:-2] * U(0x5DEECE66D1F1) + c[1:-1] * U(0x1F123BB5) + c[2:] + U(1 << 61)
    # A word has the 2-grams that begin at start - 1 .. end - 1 and the 3-grams at start - 1 .. end - 2.
    n = ends - starts
    per = np.concatenate([[0], np.cumsum(2 * n + 1)])
    kind = np.int32 if max(per[-1], len(codes)) < 1 << 30 else np.int64
    place = np.arange(per[-1], dtype=kind) - np.repeat(per[:-1].astype(kind), 2 * n + 1)
    own = np.repeat((n + 1).astype(kind), 2 * n + 1)
    is_two = place < own
    place[~is_two] -= own[~is_two]
    at = place
    at += np.repeat((starts - 1).astype(kind), 2 * n + 1)
    del place, own
    grams = _bucket(np.where(is_two, two[at], three[np.minimum(at, len(three) - 1)]))
    hashes = span_hashes(c, starts, ends)
    affixes = []
    for k in (2, 3, 4):
        cut = np.minimum(n, k)
        affixes += [_bucket(span_hashes(c, starts, starts + cut) + U(k)), _bucket(span_hashes(c, ends - cut, ends) + U(100 + k))]
    return Words(grams, per, np.stack(affixes, 1) if len(starts) else np.zeros((0, 6), np.int32), hashes, begins)


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # bucket x label
    lexicon: np.ndarray  # sorted word hashes
    member: np.ndarray  # word x language
    lexical: np.ndarray  # language x label
    moves: np.ndarray  # log weights, from x to

    def scores(self, w: Words) -> np.ndarray:
        if not len(w.hashes):
            return np.zeros((0, len(self.labels)))
        out = np.add.reduceat(self.weights[w.grams], w.gram_at[:-1], axis=0).astype(np.float64)
        for k in range(w.affixes.shape[1]):
            out += self.weights[w.affixes[:, k]]
        return out + self.listed(w.hashes) @ self.lexical

    def listed(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.lexicon):
            return np.zeros((len(hashes), len(self.labels)))
        at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        return self.member[at] * (self.lexicon[at] == hashes)[:, None]


def forward_backward(scores: np.ndarray, begins: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scaled forward, scaled backward, exp scores) of the words of all sequences; the product of the first
    two, scaled to sum 1, gives each word's label probabilities. A sequence starts as if after a word of
    any label. Sequences are cut into blocks; the blocks' transfer matrices carry both messages."""
    n, k = scores.shape
    step = np.exp(moves - moves.max())
    e = np.exp(scores - scores.max(1, keepdims=True)) if n else scores
    forward, backward = np.ones((n, k)), np.ones((n, k))
    sizes = np.diff(begins)
    blocks = -(-sizes // BLOCK)
    if not n:
        return forward, backward, e
    seq = np.repeat(np.arange(len(sizes)), blocks)
    nth = np.arange(len(seq)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = begins[seq] + nth * BLOCK
    size = np.minimum(BLOCK, begins[seq + 1] - start)
    order = np.argsort(-size, kind="stable")
    s, z = start[order], size[order]
    active = [int(np.searchsorted(-z, -t)) for t in range(BLOCK)]  # blocks longer than t

    whole = np.broadcast_to(np.eye(k), (len(seq), k, k)).copy()
    for t, m in enumerate(active):
        if not m:
            break
        x = (whole[:m].reshape(-1, k) @ step).reshape(m, k, k) * e[s[:m] + t][:, None, :]
        whole[:m] = x / x.max((1, 2), keepdims=True)
    transfer = np.empty_like(whole)
    transfer[order] = whole

    ahead, behind = np.ones((len(seq), k)), np.ones((len(seq), k))
    first = np.cumsum(blocks) - blocks
    by_blocks = np.argsort(-blocks, kind="stable")
    for j in range(1, int(blocks.max())):
        at = first[by_blocks[: int(np.searchsorted(-blocks[by_blocks], -j))]] + j
        x = np.einsum("ij,ijk->ik", ahead[at - 1], transfer[at - 1])
        ahead[at] = x / x.max(1, keepdims=True)
    for j in range(int(blocks.max()) - 2, -1, -1):
        at = first[by_blocks[: int(np.searchsorted(-blocks[by_blocks], -(j + 1)))]] + j
        x = np.einsum("ijk,ik->ij", transfer[at + 1], behind[at + 1])
        behind[at] = x / x.max(1, keepdims=True)

    a, b = ahead[order], behind[order]
    for t, m in enumerate(active):
        if not m:
            break
        x = (a[:m] @ step) * e[s[:m] + t]
        a[:m] = x / x.max(1, keepdims=True)
        forward[s[:m] + t] = a[:m]
    for t in range(BLOCK - 1, -1, -1):
        if not (m := active[t]):
            continue
        backward[s[:m] + t] = b[:m]
        x = (b[:m] * e[s[:m] + t]) @ step.T
        b[:m] = x / x.max(1, keepdims=True)
    return forward, backward, e


def word_probabilities(model: Model, w: Words) -> np.ndarray:
    forward, backward, _ = forward_backward(model.scores(w), w.begins, model.moves)
    both = forward * backward
    return both / both.sum(1, keepdims=True)


def train(texts: list[str], langs: list[str]) -> Model:
    """Fits all weights by Adam on the likelihood of the spliced sequences."""
    labels = sorted(set(langs))
    k = len(labels)
    w = words_of(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(w.begins))
    gold = np.array([labels.index(x) for x in langs], int)[owner]
    # Lexicons: each language's most frequent words, by the number of texts that hold them.
    pairs = np.unique(np.stack([w.hashes, owner.astype(U)], 1), axis=0)
    lang_of = np.array([labels.index(x) for x in langs], int)[pairs[:, 1].astype(int)]
    chosen = []
    for lang in range(k):
        values, counts = np.unique(pairs[lang_of == lang, 0], return_counts=True)
        chosen.append(values[np.argsort(-counts, kind="stable")[:LEXICON_WORDS]])
    lexicon = np.unique(np.concatenate(chosen)) if chosen else np.zeros(0, U)
    member = np.stack([np.isin(lexicon, x) for x in chosen], 1).astype(float)
    model = Model(labels, np.zeros((BUCKETS, k), np.float32), lexicon, member, np.zeros((k, k)), np.zeros((k, k)))

    # Splicing: pieces of 2 to 30 words in random order, in sequences of 16 pieces.
    rng = np.random.default_rng(7)
    pieces = []
    for a, b in zip(w.begins[:-1], w.begins[1:], strict=True):
        while a < b:
            pieces.append((a, min(b, a + int(rng.integers(2, 31)))))
            a = pieces[-1][1]
    pieces = [pieces[i] for i in rng.permutation(len(pieces))]
    order = np.concatenate([np.arange(*p) for p in pieces]) if pieces else np.zeros(0, int)
    cuts = np.cumsum([0, *[b - a for a, b in pieces]])
    begins = np.unique(np.append(cuts[::16], cuts[-1]))
    counts = np.diff(w.gram_at)
    y, inner = gold[order], np.ones(len(order), bool)
    inner[begins[:-1]] = False
    later = np.flatnonzero(inner)
    listed = model.listed(w.hashes)
    params = {"weights": model.weights.astype(float), "lexical": model.lexical, "moves": model.moves}
    mean, square = ({name: np.zeros_like(x) for name, x in params.items()} for _ in range(2))
    for turn in range(1, ROUNDS + 1):
        model.weights, model.lexical, model.moves = params["weights"].astype(np.float32), params["lexical"], params["moves"]
        forward, backward, e = forward_backward(model.scores(w)[order], begins, model.moves)
        p = forward * backward
        p /= p.sum(1, keepdims=True)
        miss = -p
        miss[np.arange(len(y)), y] += 1
        at_word = np.empty_like(miss)
        at_word[order] = miss
        grad = np.zeros((BUCKETS, k))
        for j in range(k):
            grad[:, j] = np.bincount(w.grams, np.repeat(at_word[:, j], counts), BUCKETS)
            for c in range(w.affixes.shape[1]):
                grad[:, j] += np.bincount(w.affixes[:, c], at_word[:, j], BUCKETS)
        step = np.exp(model.moves - model.moves.max())
        joint = forward[later - 1][:, :, None] * step[None]
        joint *= (e * backward)[later][:, None, :]
        joint /= joint.sum((1, 2), keepdims=True)
        joined = joint.sum(0)
        del joint, forward, backward, e, p, miss
        moved = np.zeros((k, k))
        np.add.at(moved, (y[later - 1], y[later]), 1)
        grads = {"weights": grad, "lexical": listed.T @ at_word, "moves": moved - joined}
        for name, g in grads.items():
            for at in range(0, len(g), UPDATED):
                part, m, s, d = (x[at : at + UPDATED] for x in (params[name], mean[name], square[name], g))
                d = d / max(1, len(y)) * 100 - DECAY * part
                m[:] = 0.9 * m + 0.1 * d
                s[:] = 0.99 * s + 0.01 * d * d
                part += RATE * (m / (1 - 0.9**turn)) / (np.sqrt(s / (1 - 0.99**turn)) + 1e-6)
    model.weights, model.lexical, model.moves = params["weights"].astype(np.float32), params["lexical"], params["moves"]
    return model


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model from a sample of ``labelled``; None if no row has text and language. Each language gives the
    SAMPLE_DOCS / languages different texts of the smallest hashes (all, if fewer), whatever their number and however
    often one is repeated. Of a text over SAMPLE_CHARS characters a passage of so many is learned, at a place that
    depends on the hash. Beyond SAMPLE_DOCS languages, one text each is learned."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang IS NOT NULL AND length(text) > 0")
    hashed = rows.withColumn("h", F.xxhash64("text"))
    # Different texts of each language, but for 5 %.
    counts = {r["lang"]: r["n"] for r in hashed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return None
    share = max(1, SAMPLE_DOCS // len(counts))
    # Four times as many as needed are below the bound, so a window over few rows finds the smallest hashes.
    below = [(lang, min((1 << 63) - 1, -(1 << 63) + (1 << 64) * (4 * share + 50) // max(1, n))) for lang, n in counts.items()]
    bounds = F.broadcast(labelled.sparkSession.createDataFrame(below, "lang string, bound long"))  # a row a language
    start = F.when(F.length("text") > SAMPLE_CHARS, F.pmod("h", F.length("text") - SAMPLE_CHARS)).otherwise(0).cast("int")
    few = hashed.join(bounds, "lang").where("h <= bound").select("lang", "h", F.substring("text", start + 1, F.lit(SAMPLE_CHARS)).alias("text")).dropDuplicates(["lang", "h"])
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    got = sorted((r["lang"], r["text"]) for r in few.withColumn("nth", nth).where(F.col("nth") <= share).collect())
    model = train([t for _, t in got], [lang for lang, _ in got]) if got else None
    free_unused()  # the driver's, which keeps what training took else
    return model


def label_texts(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """(language, its mean probability over the words) of each text; ``und`` and 0 without a letter."""
    return judge_texts(model, texts)[:2]


def judge_texts(model: Model, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
    """As ``label_texts``, and the mean of each word's highest probability, whichever language has it."""
    langs, scores, sure = [UNDETERMINED] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (size == 0 or size + len(texts[last] or "") <= RUN_CHARS):
            size += len(texts[last] or "") + 1
            last += 1
        w = words_of([t or "" for t in texts[first:last]])
        if len(w.hashes):
            p = word_probabilities(model, w)
            full = np.flatnonzero(np.diff(w.begins))
            mean = np.add.reduceat(p, w.begins[full], axis=0) / np.diff(w.begins)[full][:, None]
            highest = np.add.reduceat(p.max(1), w.begins[full]) / np.diff(w.begins)[full]
            for i, row, high in zip(full.tolist(), mean, highest.tolist(), strict=True):
                best = int(row.argmax())
                sure[first + i] = min(1.0, high)
                langs[first + i], scores[first + i] = model.labels[best], min(1.0, max(0.0, float(row[best])))
        first = last
    return langs, scores, sure


def label_words(model: Model, text: str) -> list[tuple[str, str]]:
    """(word, language) of every word: the labelling of code-switched text."""
    w = words_of([text])
    low = text.lower()
    found, word = [], ""
    for ch in low + " ":
        if ch.isalpha():
            word += ch
        elif word:
            found.append(word)
            word = ""
    return [(x, model.labels[i]) for x, i in zip(found, word_probabilities(model, w).argmax(1), strict=True)] if found else []


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` string, ``lang_score`` double and ``lang_sure`` double, the mean of each word's
    highest probability; a column of that name is replaced. Null texts and texts without a letter get ``und``
    and 0, as all do without a model."""
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("lang_pred", "lang_score", "lang_sure")]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNDETERMINED), "lang_score": F.lit(0.0), "lang_sure": F.lit(0.0)})
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_sure", T.DoubleType())])
    place = kept.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            langs, scores, sure = judge_texts(model, batch.column(place).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(sure, pa.float64())], names=[*kept, "lang_pred", "lang_score", "lang_sure"])

    return docs.mapInArrow(lean(rows), schema)


def learnable(docs: DataFrame) -> DataFrame:
    """The rows that a model may learn from: crc32 of doc_id as text, modulo 3, isn't 1. A null id isn't learned from."""
    return docs.where("crc32(cast(doc_id AS string)) % 3 != 1")


def op6_language(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every one of ``documents``, learned from those that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(learnable(docs))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id", F.coalesce(F.expr("crc32(cast(doc_id AS string)) % 3 = 1"), F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )
