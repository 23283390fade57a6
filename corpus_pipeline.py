"""Corpus pipeline: language, near-duplicates, benchmark leaks, secrets, token ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written and read
again as the ``docs`` of the next. All stages but the last return the columns of ``documents``.

Rows with null, empty or letterless texts leave in the first stage. Extra columns of ``docs`` pass through all stages
but the last. A stage of an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labeltrail.llm import bpe_codec, decontaminate, language_id, secret_scan, simhash
from labeltrail.llm.common import table
from labeltrail.scratch import cut

#: SQL cannot express the network of the first stage; tests compare the pipeline with one-by-one versions.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network can tell, with null languages filled in; those without text or letters are rejected.

    No language and no score is rejected here, so that clean documents stay; ``keep_known`` takes both as arguments.
    If no labelled row is outside the held-out third, nothing is learnt, and the texts with a letter stay as they are.
    """
    net = language_id.fit(docs.filter(~language_id.is_held_out()))
    return language_id.keep_known(docs, net)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts."""
    return secret_scan.redact(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and the text that they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe_codec.encode_decode(docs.select("doc_id", "lang", "text"), path).select(
        "doc_id", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded"
    )


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("tokens", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
