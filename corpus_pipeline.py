"""The corpus pipeline: language ID, near-duplicate removal, secret redaction, mixing to target weights, encoding.

STAGES are run in order; each is written as Parquet and read again as the next one's documents, all but the
last return the columns of ``documents``. The driver's ``run`` applies them to ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwright.llm import jaccard, langid, mixing, pieces, secrets
from graphwright.llm.settle import shared_folder

#: A document without a letter goes, and one whose words have a lower mean of their highest probabilities.
LEAST_SCORE = 0.5
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID by words. Keeps documents whose words have a language each, be it one or several; ``lang`` is
    filled in where it is null. Where no model can be fitted, every document with a letter stays as it is."""
    model = langid.fit(langid.learnable(docs))
    if model is None:
        return docs.where(F.rlike("text", F.lit(r"\p{L}")))
    found = langid.identify(docs, model).where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("lang_sure") >= LEAST_SCORE))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each class of similar shingle sets."""
    return jaccard.keep_first_of_class(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark; ``n_chars`` follows the text."""
    out = secrets.redact_secrets(docs)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))).select(*docs.columns)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents at the rates that bring the domains' token totals to the targets: a rate's whole part
    is so many copies, the rest is drawn by a hash of the id."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rates = mixing.mix_rates(docs, labels, mixing.label_domain(), mixing.TARGETS)
    return mixing.take_at_rates(docs, rates)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text."""
    return pieces.encode(docs.select("doc_id", "lang", "source", "text"), pieces.load_model(MODEL_PATH)).select("doc_id", "lang", "source", "ids", "exact")


STAGES = [
    ("language_id", keep_known_language),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_to_targets),
    ("pieces", encode_pieces),
]

#: A conditional random field and a piece lattice can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            path = f"{shared_folder(spark)}/pipeline/{uuid.uuid4().hex}/{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
