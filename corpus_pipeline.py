"""From raw documents to packed training sequences, in five stages over the table ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its result
is written as Parquet and read again as the next one's input.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import cut_lineage, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language can be told, and writes it into lang.

    Null texts and texts without a letter go; each row is told by its own text, whatever its id.
    """
    from tidemark.llm import languages

    model = languages.train(docs)
    told = languages.predict(docs, model)
    told = told.where(languages.accepted(F.col("lang_pred"), F.col("score")))
    return told.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of every group linked by shingle Jaccard of 0.8: the smallest id that only one row has.

    Rows that share an id (or have none) are documents of their own: rows equal in id and text
    count once, others are linked by their texts alone, and stand behind all ids of single rows when
    a group's document is chosen.  Null, empty and wordless texts link with nothing and stay.
    """
    from tidemark.llm import jaccard

    repeated = docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_id"), F.lit(True).alias("_again"))
    repeated = cut_lineage(repeated, "repeated-ids")
    own = F.lit(1 << 62) + F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 61))
    keyed = docs.join(repeated, docs["doc_id"].eqNullSafe(repeated["_id"]), "left")
    keyed = keyed.withColumn("_key", F.when(F.col("_again"), own).otherwise(F.col("doc_id").cast("long")))
    groups = jaccard.near_groups(keyed.select("_key", "text"), id_col="_key")
    others = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_key"))
    kept = keyed.join(others, "_key", "left_anti")
    again = kept.where("_again").dropDuplicates(["_key"])
    return kept.where("_again is null").select(*COLUMNS).unionByName(again.select(*COLUMNS))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts 50-word passages that a document of a smaller id has; a document left without words by that goes.

    Null and short texts stay as they are; a null id counts as the largest, and rows of one id
    take nothing from each other.
    """
    from tidemark.llm import substrings

    left = substrings.remove_repeats(docs)
    cut = F.col("n_removed") > 0
    out = left.withColumn("text", F.when(cut, F.col("kept")).otherwise(F.col("text")))
    out = out.where(~cut | (F.col("n_removed") < F.col("n_words")))
    return out.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret's span by a mark; all rows stay, texts without a find (null and empty ones too) unchanged."""
    from tidemark.llm import secrets

    out = secrets.mask(docs)
    found = F.col("n_spans") > 0
    out = out.withColumn("text", F.when(found, F.col("masked")).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.when(found, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every row's text with its sequence and its place there; texts without words have no piece to place."""
    from tidemark.llm import packing

    return packing.pack(packing.sized(docs))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack_sequences),
]
ORACLE_SQL = None  # learned and compressed decisions have no SQL form; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written to the shared folder and reread."""
    place = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{place}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
