"""Mixing sources to target weights by soft membership, in DataFrame functions only.

1. *Classifier.* Domains are the classes of a labelled table. A logistic model over marker words is
   fitted on a bounded sample of labelled documents (``SAMPLE_ROWS``): the words whose presence tells the
   domains apart best become the markers (``MARKERS``, a fixed number), and each document's posterior is
   the softmax of the domains' offsets and the weights of the markers that it has. Its ridge is the one of
   ``RIDGES`` of the least log loss on folds that it wasn't fitted on, so that posteriors are calibrated.
2. *Totals.* With n_i tokens and posterior p_i, document i gives r_i n_i p_i tokens to the domains at rate r_i.
3. *Rates.* Projected-gradient least squares from r = 1: each pass sums the residual (one number a domain),
   and r_i moves against its gradient and is cut at 0. The residual is measured in the inverse of the
   second-moment matrix of n_i p_i over the rows that aren't cut (as many numbers as pairs of domains), in
   which the step 1 meets the targets unless more rows are cut; it is halved while a pass makes the
   residual larger. Passes end when the totals are within ``TOLERANCE`` of the targets or after ``PASSES``.

Texts are read once for tokens and posteriors; every pass reads a narrow table of one row a document.
Only sums with as many numbers as domains reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .settle import drop_settled, settle

#: Labelled rows that the classifier learns from at most; of longer texts so many characters; marker words.
SAMPLE_ROWS, SAMPLE_CHARS, MARKERS = 4000, 20_000, 48
#: Ridges that are tried, folds, and steps of a fit.
RIDGES, FOLDS, STEPS = (0.3, 1.0, 3.0, 10.0, 30.0), 5, 300
#: Documents of a domain and overall in which a marker must be found.
LEAST_DOCS = 5
PASSES, TOLERANCE = 20, 1e-6
WORDS = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; an empty first entry may stand before them."""
    return F.split(F.lower(text), WORDS)


def shaped(rows: DataFrame) -> DataFrame:
    """Rows with ``text`` (not null), as the same rows with ``words`` and ``shape`` in its place: words for classes of the
    share of signs (``#signs1`` ..), of capitals (``#upper``) and of repeated words (``#again``). No word begins with #."""
    kept = [c for c in rows.columns if c != "text"]
    split = rows.select(*kept, "text", words(F.col("text")).alias("words"))
    n = F.greatest(F.length("text"), F.lit(1))
    gone = lambda chars: (n - F.length(F.translate(F.col("text"), chars, ""))) / n
    # Each share is a column of its own: it is compared with several edges.
    shares = split.select(
        *kept, "words", gone("%*#$&|+=<>{}[]~^_/\\@").alias("signs"), gone("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("upper"),
        (1 - F.size(F.array_distinct("words")) / F.size("words")).alias("again"),
    )
    mark = lambda name, *edges: F.concat(F.lit("#" + name), sum((F.when(F.col(name) > e, 1).otherwise(0) for e in edges), F.lit(0)).cast("string"))
    return shares.select(*kept, "words", F.array(mark("signs", 0.002, 0.02, 0.08), mark("upper", 0.06, 0.3), mark("again", 0.35, 0.6, 0.8)).alias("shape"))


def fit_markers(labelled: DataFrame, domain: Column) -> tuple[list[str], dict[str, list[float]], list[float]]:
    """(domains, marker word -> weight a domain, offset a domain) from rows with ``text`` and doc_id: the SAMPLE_ROWS rows of the
    smallest hashes, whatever their number. Rows with a null domain or text aren't learned from; of a text over
    SAMPLE_CHARS characters a passage of so many is, at a place that depends on the hash."""
    hashed = labelled.select(F.xxhash64("doc_id", "text").alias("h"), "text", domain.cast("string").alias("domain")).where("domain IS NOT NULL AND text IS NOT NULL")
    n = hashed.count()
    bound = min((1 << 63) - 1, -(1 << 63) + (1 << 64) * (2 * SAMPLE_ROWS + 100) // max(1, n))
    start = F.when(F.length("text") > SAMPLE_CHARS, F.pmod("h", F.length("text") - SAMPLE_CHARS)).otherwise(0).cast("int")
    rows = settle(hashed.where(F.col("h") <= bound).orderBy("h").limit(SAMPLE_ROWS).select("h", "domain", F.substring("text", start + 1, F.lit(SAMPLE_CHARS)).alias("text")))
    sizes = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    domains = sorted(sizes)
    if not domains:
        drop_settled(rows)
        return [], {}, []
    tokens = shaped(rows.select("domain", "text")).select("domain", F.explode(F.array_distinct(F.concat("words", "shape"))).alias("word")).where("word != ''")
    has = [F.sum(F.when(F.col("domain") == d, 1).otherwise(0)).alias(f"d{i}") for i, d in enumerate(domains)]
    counts = tokens.groupBy("word").agg(*has, F.count(F.lit(1)).alias("all")).where(F.col("all") >= LEAST_DOCS)
    total = sum(sizes.values())
    # Mutual information of the word's presence and the domain.
    gain = F.lit(0.0)
    for i, d in enumerate(domains):
        for there, whole in ((F.col(f"d{i}").cast("double"), F.col("all")), (sizes[d] - F.col(f"d{i}").cast("double"), total - F.col("all"))):
            gain = gain + F.when(there > 0, there / total * F.log(there * total / (whole * sizes[d]))).otherwise(0.0)
    best = [r["word"] for r in counts.withColumn("gain", gain).orderBy(F.desc("gain"), "word").limit(MARKERS).collect()]
    listed = F.array(*[F.lit(w) for w in best]) if best else F.array().cast("array<string>")
    has = shaped(rows.select("h", "domain", "text")).select("h", "domain", F.array_intersect(F.concat("words", "shape"), listed).alias("found"))
    got = sorted((r["h"], r["domain"], r["found"]) for r in has.collect())  # SAMPLE_ROWS rows at most
    drop_settled(rows)
    place = {w: i for i, w in enumerate(best)}
    x = np.zeros((len(got), len(best) + 1))
    x[:, 0] = 1
    for i, (_, _, found) in enumerate(got):
        x[i, [1 + place[w] for w in found]] = 1
    y = np.array([domains.index(d) for _, d, _ in got])
    w = fit_logistic(x, y, len(domains))
    return domains, {m: w[1 + i].tolist() for m, i in place.items()}, w[0].tolist()


def _probabilities(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    z = x @ w
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _descend(x: np.ndarray, y: np.ndarray, k: int, ridge: float) -> np.ndarray:
    """Weights of a softmax model by accelerated gradient steps; the first column is the offset, which has no ridge."""
    truth = np.eye(k)[y]
    w = ahead = np.zeros((x.shape[1], k))
    step = 1 / (0.5 * np.linalg.norm(x, 2) ** 2 / len(x) + ridge / len(x))
    for turn in range(1, STEPS + 1):
        gradient = x.T @ (_probabilities(x, ahead) - truth) / len(x)
        gradient[1:] += ridge / len(x) * ahead[1:]
        new = ahead - step * gradient
        ahead, w = new + turn / (turn + 3) * (new - w), new
    return w


def log_loss(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    return float(-np.log(np.maximum(_probabilities(x, w)[np.arange(len(y)), y], 1e-12)).mean())


def fit_logistic(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """Weights (features x domains) with the ridge of the least log loss on held-out folds; the prior alone is one of the models."""
    fold = np.arange(len(y)) % FOLDS
    losses = {}
    for ridge in (*RIDGES, 1e6):
        ws = [(_descend(x[fold != f], y[fold != f], k, ridge), f) for f in range(FOLDS) if (fold == f).any() and (fold != f).any()]
        losses[ridge] = float(np.mean([log_loss(x[fold == f], y[fold == f], w) for w, f in ws])) if ws else 0.0
    return _descend(x, y, k, min(losses, key=losses.get))


def posteriors(found: Column, weights: dict[str, list[float]], prior: list[float]) -> Column:
    """Array of probabilities of the domains, of the marker words ``found`` in a text (an array of words)."""
    table = F.create_map(*[x for w in sorted(weights) for x in (F.lit(w), F.array(*[F.lit(float(v)) for v in weights[w]]))]) if weights else None
    start = F.array(*[F.lit(float(p)) for p in prior])
    log = F.aggregate(found, start, lambda a, w: F.zip_with(a, F.element_at(table, w), lambda x, y: x + y)) if weights else start
    # Each step is the finish of a fold over one entry, so that what it uses twice is computed once.
    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    soft = once(log, lambda v: once(F.array_max(v), lambda m: F.transform(v, lambda x: F.exp(x - m))))
    return once(soft, lambda v: once(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), lambda t: F.transform(v, lambda x: x / t)))


def mix_rates(docs: DataFrame, labels: DataFrame, domain: Column, targets: dict[str, float] | None = None, budget: float = 1.0) -> DataFrame:
    """(doc_id, n_tokens long, posterior array<double>, domain string, rate double): the rate at which each row of
    ``docs`` is to be taken so that domains have shares ``targets`` of ``budget`` x all tokens.

    ``docs`` has doc_id and text; ``labels`` has doc_id, and ``domain`` is an expression over it. ``targets``
    need not sum to 1 and default to equal shares; domains without a target get none, targets of
    unknown domains are ignored. Null and empty texts have 0 tokens and keep rate 1. Repeated rows count
    and are returned each. Without labelled rows, or with all tokens 0, every rate is ``budget``.
    """
    docs = docs.select("doc_id", "text")
    known = labels.select(F.col("doc_id"), domain.alias("__domain")).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("__domain").alias("__domain"))
    domains, weights, prior = fit_markers(docs.join(known, "doc_id"), F.col("__domain"))
    if not domains:
        return docs.select("doc_id", F.size(F.filter(words(F.coalesce("text", F.lit(""))), lambda w: w != "")).cast("long").alias("n_tokens"), F.array().cast("array<double>").alias("posterior"), F.lit(None).cast("string").alias("domain"), F.lit(float(budget)).alias("rate"))
    split = shaped(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    listed = F.array(*[F.lit(w) for w in sorted(weights)]) if weights else F.array().cast("array<string>")
    empty = F.when(F.element_at("words", 1) == "", 1).otherwise(0) + F.when((F.size("words") > 1) & (F.element_at("words", -1) == ""), 1).otherwise(0)
    met = split.select("doc_id", (F.size("words") - empty).cast("long").alias("n_tokens"), F.concat(F.array_intersect("words", listed), F.array_intersect("shape", listed)).alias("found"))
    # The posterior is a few numbers; the texts aren't read again.
    rows = settle(met.select("doc_id", "n_tokens", posteriors(F.col("found"), weights, prior).alias("posterior")))

    k = len(domains)
    part = [F.col("n_tokens") * F.element_at("posterior", i + 1) for i in range(k)]
    moved = [F.sum(F.when(F.col("rate") > 0, part[i] * part[j])) for i in range(k) for j in range(i, k)]

    def measured(state: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Domain totals at the present rates, and the second moments of the rows that aren't at 0."""
        got = state.agg(*[F.sum(F.col("rate") * x) for x in part], *moved).first()
        second, values = np.zeros((k, k)), iter(got[k:])
        for i in range(k):
            for j in range(i, k):
                second[i, j] = second[j, i] = next(values) or 0.0
        return np.array([x or 0.0 for x in got[:k]], float), second

    state = rows.withColumn("rate", F.lit(1.0))
    totals, second = measured(state)
    if not totals.sum():
        return rows.select("doc_id", "n_tokens", "posterior", _top(domains), F.lit(float(budget)).alias("rate"))
    wanted = np.array([(targets or dict.fromkeys(domains, 1.0)).get(d, 0.0) for d in domains], float)
    goal = wanted / wanted.sum() * totals.sum() * budget if wanted.sum() > 0 else totals * budget
    length = 1.0
    for turn in range(1, PASSES + 1):
        miss = totals - goal
        if np.abs(miss).max() <= TOLERANCE * goal.sum():
            break
        pull = np.linalg.pinv(second, rcond=1e-10, hermitian=True) @ miss
        while True:
            step = sum((part[i] * float(pull[i] * length) for i in range(k)), F.lit(0.0))
            after = settle(state.withColumn("rate", F.greatest(F.lit(0.0), F.col("rate") - step)))
            totals, second = measured(after)
            if length < 1e-3 or np.abs(totals - goal).sum() < np.abs(miss).sum():
                break
            drop_settled(after)
            length /= 2
        if turn > 1:
            drop_settled(state)
        state, length = after, min(1.0, 2 * length)
    return state.select("doc_id", "n_tokens", "posterior", _top(domains), "rate")


def _top(domains: list[str]) -> Column:
    names = F.array(*[F.lit(d) for d in domains])
    return F.element_at(names, F.array_position("posterior", F.array_max("posterior")).cast("int")).alias("domain")


def take_at_rates(docs: DataFrame, rates: DataFrame, seed: int = 17) -> DataFrame:
    """``docs`` with each row as often as its rate says: the whole part always, one more if a hash of the id is
    below the rest. Rows of one doc_id have one rate; a null doc_id stays once."""
    chosen = rates.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("rate").alias("__rate")).withColumnRenamed("doc_id", "__id")
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 32)) / float(1 << 32)
    copies = F.coalesce((F.floor("__rate") + F.when(draw < F.col("__rate") - F.floor("__rate"), 1).otherwise(0)).cast("int"), F.lit(1))
    joined = docs.join(chosen, docs["doc_id"] == chosen["__id"], "left").withColumn("__n", copies).where("__n > 0")
    return joined.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*[docs[c] for c in docs.columns])


#: The domains of the labels table, and the shares of tokens that they are to have.
TARGETS = {"good": 0.85, "good_toxic": 0.05, "poor": 0.09, "poor_toxic": 0.01}


def label_domain() -> Column:
    return F.concat(F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor"), F.when(F.col("toxic") == 1, "_toxic").otherwise(""))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    """Rates at which all ``documents`` are to be taken for the domains of ``labels`` to have the shares TARGETS of the tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mix_rates(docs, labels, label_domain(), TARGETS)
