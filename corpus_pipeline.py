"""The corpus pipeline: documents -> language ID -> line dedup -> n-gram Jaccard join ->
mixing to target weights -> byte-level BPE. Every stage is written as Parquet to the shared
checkpoint folder and read again by the next."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import bpe, jaccard_join, lang_id, line_dedup, mixing
from fathom.session import ensure_checkpoint_dir

#: A document goes if no language has this share of the weight, or if its letters cost so many standard
#: deviations more than in texts of the language that describes them best: foreign text and noise.
MIN_SCORE, MAX_EXCESS = 0.5, 20.0


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; ``und`` ones, those below MIN_SCORE and those
    beyond MAX_EXCESS go."""
    samples = lang_id.sample(docs.filter(~lang_id.held_out("doc_id")))
    found = lang_id.predict(docs, lang_id.ContextTrees.fit(samples), limits=lang_id.letter_limits(samples))
    return found.filter((F.col("lang_pred") != lang_id.UND) & (F.col("score") >= MIN_SCORE) & (
        F.col("excess") <= MAX_EXCESS)).select(*docs.columns)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the lines that their source repeats; ``n_chars`` is brought up to date."""
    out = line_dedup.drop_site_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join."""
    return jaccard_join.one_per_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as the mix takes them."""
    return mixing.training_rows(docs, mixing.mix(docs))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and whether the ids decode to the text."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    done = bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)
    return done.select("doc_id", "lang", "source", F.size("ids").alias("n_tokens"), "ids",
                       (F.coalesce("text", F.lit("")).cast("binary") == F.col("decoded")).alias("round_trip"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_boilerplate_lines),
    ("jaccard_join", drop_near_copies),
    ("source_mix", mix_sources),
    ("byte_bpe", tokenize),
]

#: Language models and token ids are beyond SQL; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
