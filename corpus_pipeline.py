"""From raw documents to token ids: language, near duplicates, personal data, mixing, tokens.

Each stage reads what the one before it wrote. Stages drop documents only by their own decision; all but the last return the columns of
``documents``, further columns included.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import bpe, chosen_path, langid, mixing, pii
from trackloom.llm._common import checkpointed, quoted, remove, shared_folder, unused

#: A document is rejected if a smaller share of its distinct n-grams occurs in any text that stands for a language: another script, or junk.
LEAST_KNOWN = 0.1


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled documents teach; a missing ``lang`` is filled in.

    Null texts and those without a letter go, and those of whose distinct n-grams less than ``LEAST_KNOWN`` are known. (How sure the
    model is between the languages it knows says nothing of others, and does not count.) If there are no labels, all stay.
    """
    if docs.where("lang is not null").isEmpty():
        return docs
    added = unused(docs.columns, "lang_pred", "score", "known")
    guess, _, known = added
    kept = langid.identify(docs, F.lit(True), added=tuple(added)).where((F.col(guess) != "und") & (F.col(known) >= LEAST_KNOWN))
    return kept.withColumn("lang", F.coalesce("lang", guess)).select(*map(quoted, docs.columns))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of the smallest id; documents without an id stay."""
    key, rows = unused(docs.columns, "kept_id", "kept_rows")
    classes = chosen_path.join(docs)
    chosen = checkpointed(classes.where("doc_id = class_id").groupBy(F.col("doc_id").alias(key)).agg(F.count("*").alias(rows)))
    joined = docs.join(chosen.hint("shuffle_hash"), docs["doc_id"] == chosen[key], "left").where(F.col(key).isNotNull() | docs["doc_id"].isNull())
    columns = [quoted(c) for c in docs.columns]
    if chosen.where(F.col(rows) > 1).isEmpty():
        return joined.select(*columns)
    once = joined.where(F.coalesce(rows, F.lit(1)) == 1).select(*columns)
    return once.unionByName(joined.where(F.col(rows) > 1).select(*columns).dropDuplicates(["doc_id", "text"]))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars follows the text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    tokens, weight, copies, copy = unused(docs.columns, "mix_tokens", "mix_weight", "mix_copies", "mix_copy")
    taken = mixing.mixed(docs, added=(tokens, weight, copies)).where(F.col(copies) > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*map(quoted, docs.columns))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of every row."""
    return bpe.bpe_digest(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), with_ids=True).drop("byte_lengths")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("ngram_jaccard_join", one_of_each),
    ("pii", without_personal_data),
    ("mixing", mixed_sources),
    ("byte_level_bpe", token_ids),
]

#: Language ID and PII are learnt models, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next; a stage's table is removed when the next stands."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if k:
                remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
