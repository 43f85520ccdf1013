"""The corpus pipeline: five operators, each on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm import decontaminate, jaccard_join, language_id, secrets, sentencepiece_fst, shared


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; texts without a letter (``und``) go."""
    model = language_id.fit(language_id.learnable(docs))
    if model is None:  # nothing to learn from: no text can be told, and those with a letter stay
        return docs.where(F.col("text").rlike(r"\p{L}"))
    label, score = shared.unused(docs, "_language"), shared.unused(docs, "_likelihood")
    rows = language_id.predict(docs, model, label, score)
    return rows.where(F.col(label) != language_id.UNDETERMINED).drop(label, score)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the lowest doc_id, of each group of near duplicates, once if its row is repeated; rows without an id stay."""
    return jaccard_join.keep_first(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.decontaminate(docs, shared.table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; n_chars follows the new text."""
    out = secrets.mask_secrets(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))) if "n_chars" in docs.columns else out


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with piece ids, their number, and whether decoding gives the text back."""
    return sentencepiece_fst.encode(docs)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", join_near_duplicates),
    ("decontamination", remove_contaminated),
    ("secret_scan", mask_secrets),
    ("sentencepiece", encode_pieces),
]

#: No SQL expresses the classifier, the joins' tokenisation at scale, or the transducer; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
