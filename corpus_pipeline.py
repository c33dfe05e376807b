"""From raw documents to token ids: five stages, each applying one operator.

A stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor
kept; its result is written as Parquet and read again for the next. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowscore.llm import langid
from flowscore.llm.bpe import encode_and_decode, read_ranks
from flowscore.llm.decontam import contamination
from flowscore.llm.hashing import id_filter, parted
from flowscore.llm.linededup import dedup_lines
from flowscore.llm.minhash import NearRule, near_duplicates
from flowscore.session import stage_table

# A document whose likeliest language is less likely than this is rejected.
LANGUAGE_SCORE = 0.3
RANK_FILE = "byte_bpe_multi_50k.tiktoken"

# Several stages hold a language model, a network or a deduplication: no SQL.
ORACLE_SQL = None


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` but for the given doc_ids; rows without an id stay.

    Only rows that a filter of fixed size lets through are shuffled.
    """
    gone = stage_table(gone.select("doc_id").where("doc_id IS NOT NULL").distinct(), "gone")
    rest, maybe = parted(docs, id_filter(gone), "doc_id")
    kept = maybe.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
    return rest.unionByName(kept)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network recognises.

    Rejected are texts that are null or without a letter, and those whose
    likeliest language has less than LANGUAGE_SCORE. ``lang`` is left as given.
    """
    names, network = langid.train(docs.where(~langid.held_out()))
    found = langid.predict(docs, names, network)
    keep = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LANGUAGE_SCORE)
    return found.where(keep).select(*docs.columns)


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, later copies of repeated runs of lines taken out.

    A text may be empty afterwards. ``n_chars``, where there is one, follows.
    """
    found = dedup_lines(docs)
    if "n_chars" in docs.columns:
        changed = F.size("removed") > 0
        count = F.when(changed, F.length("text")).otherwise(F.col("n_chars"))
        found = found.withColumn("n_chars", count.cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def deduplicate_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity 0.8."""
    return without(docs, near_duplicates(docs, NearRule()).where("NOT kept"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return without(docs, contamination(docs, items).where("size(covered) > 0"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256``: the ids, and the digest of what they decode to."""
    ranks = read_ranks(public_tokenizers.path(RANK_FILE))
    decoded = encode_and_decode(docs, ranks, public_tokenizers.PATTERN)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", deduplicate_lines),
    ("near_dedup", deduplicate_near),
    ("decontamination", decontaminate),
    ("byte_bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return docs
