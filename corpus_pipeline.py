"""The corpus pipeline: each stage calls one training-data operator.

Stages take and return documents; the last returns the pieces of packed
sequences. A row with null text goes in the first stage, as does any in which
no language is recognised; nulls in other columns stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import common, language, mixing, packing, secrets, simhash


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language stay; a null ``lang`` gets the one predicted."""
    model = language.train(docs)
    own = {c: f"__own_{c}" for c in docs.columns if c in ("lang_pred", "score", "fit")}
    found = language.annotate(docs.withColumnsRenamed(own), model).filter(language.accepted())
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the smallest id."""
    return simhash.deduplicate(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; no document goes."""
    clean = secrets.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its fitted rate, rounded at random, says; documents that are surely not toxic stay once at least."""
    labelled = mixing.quality_domains(common.docs_table(spark, sf_dir, "labels"))
    mixed = mixing.mix(docs, labelled, whole=("high", "low"), vocabulary=True)
    rates = common.stash(mixing.copies(mixed, seed=mixing.SEED).select("doc_id", "copies"), "copies")
    return mixing.apply(docs, rates)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences."""
    pieces = packing.tokenize_pieces(docs)
    digests = pieces.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(common.stash(digests, "pieces"))


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: Trained models take part, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and reread."""
    docs = common.docs_table(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
