"""A training corpus from raw documents: classify, deduplicate, mix, pack.

Each stage takes what the one before kept, written as Parquet and read again:
``quality`` drops documents that the classifier rejects, ``near_dedup`` keeps one document
of each group of near duplicates (five-word shingles, similarity 0.8), ``substring_dedup``
cuts passages of fifty words or more that an earlier document has, ``mix`` takes sources
in proportion 1 : 2 : 3 (a document up to three times), and ``pack`` returns the pieces of
the mixed documents in sequences of 1024 tokens.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.llm import mixing, neardup, packing, quality, substring
from rillmark.llm.common import delete, shared_folder, tokenizer_path


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score of quality is 0.3 or more.

    Null and empty texts score by the model's bias; repeated rows go or stay together; an empty table
    stays empty; all columns are kept, whatever their names."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.classify(docs.select(F.struct(*docs.columns).alias("_row"), "text"), model).where("predicted = 1").select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id.

    Texts without words have no duplicates and stay, and so do all rows with a null id; of rows alike in
    id and text one stays; an empty table stays empty; all columns are kept."""
    return neardup.keep_one_of_each(docs, width=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that a smaller id has.

    Null texts stay null; a null id is larger than all others; rows with one id repeat nothing of
    each other; an empty table stays empty; all columns are kept, ``n_chars`` follows the text."""
    spare = "_" * (1 + max(map(len, docs.columns)))  # names that no column has
    cut = substring.remove_repeats(docs, width=50, count_cols=(f"{spare}words", f"{spare}removed"))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col(f"{spare}removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return cut.drop(f"{spare}words", f"{spare}removed").select(*(f"`{c}`" for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, none to three times.

    Null texts have no words; a null source is one of its own; rows alike are taken by their number; an
    empty table stays empty; all columns are kept."""
    return mixing.take(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences.

    A null or empty text is one piece, its end token; repeated rows are packed one by one; an empty table
    gives no pieces; other columns are left out."""
    return packing.best_fit_pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", classify_quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix", mix_sources),
    ("pack", pack),
]

#: No stage but the last could be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  What each stage but the last kept is written as Parquet in a
    folder of its own below the shared one, so that no stage runs twice, and deleted once the
    next stage's lies beside it.  What the last stage reads stays: its owner may delete it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, done = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}", None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            if done:
                delete(spark, done)
            done = f"{folder}/{name}"
    return docs
