"""A corpus cleaning pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of
``documents``; the last returns ids of tokens.  ``run`` writes each stage's documents to the shared scratch
area as Parquet and reads them again.

Null texts are kept by all stages but a classifier that rejects them (they score as empty ones do) and have no tokens; so do empty ones.  Repeated rows
are treated alike, but for their lines: rows of one id and text keep the same lines, and of rows with different ids only the first
keeps a line.  Null ids are ids like others in the order of lines.  Empty tables give empty results; extra columns of any name pass through to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers
from graupel.llm.bpe import bpe_round_trip
from graupel.llm.decontaminate import decontaminate
from graupel.llm.jaccard_join import ngram_jaccard_join
from graupel.llm.line_dedup import dedup_lines
from graupel.llm.quality import CUT, score, train
from graupel.session import Scratch

RANKS = "byte_bpe_multi_50k.tiktoken"


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rated = _free(docs, "score")
    return score(docs, model, out=rated).where(F.col(rated) >= CUT).drop(rated)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines seen before; those that lose all of their lines go."""
    total, gone = _free(docs, "n_lines"), _free(docs, "n_removed")
    done = dedup_lines(docs, counts=(total, gone))
    left = F.col("text").rlike("\\S")
    shorter = F.when(F.col(gone) > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return done.where(F.col(gone).eqNullSafe(0) | left).withColumn("n_chars", shorter).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates.

    Rows of one id stay or go together.  Rows without an id are named by their text, after all ids: one whose group holds a document with an id goes, and
    of groups without any, the rows of one text stay.
    """
    key = _free(docs, "key")
    own = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseAND(F.lit((1 << 61) - 1)) + (1 << 62))
    named = docs.withColumn(key, own)
    groups = ngram_jaccard_join(named.select(key, "text"), id=key)
    later = Scratch(spark, "later").save(groups.where(F.col("component_id") != F.col(key)).select(key).distinct(), "ids")
    return named.join(later, key, "left_anti").select(docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and whether they decode to its text."""
    coded = bpe_round_trip(docs.select("doc_id", "text"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "round_trip")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("byte-level BPE encoding and decoding", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
