"""One registered query for each operator of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import checks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {
    "op4_arc_to_warc": checks.OP4,
    "op8_lattice_dedup": checks.OP8,
    "op9_substring_dedup": checks.OP9,
    "op10_ngram_jaccard": checks.OP10,
    "op12_quality_rules": checks.OP12,
}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query
def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document, stored, read back and checked by crc32."""
    import public_tokenizers

    from . import token_store

    path = token_store.store(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.with_crc32(token_store.read(spark, path))


@query
def op4_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through ARC archives into WARC files and back."""
    from . import warc

    rows = warc.read(spark, warc.archive(table(spark, sf_dir, "pages")))
    return rows.select(rows.source_id.alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document by pattern and by novelty."""
    from . import secrets

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.scan(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from four fifths of the labelled ones."""
    from . import languages

    docs = table(spark, sf_dir, "documents")
    told = languages.predict(docs.select("doc_id", "text"), languages.train(docs))
    return told.select("doc_id", languages.held_out(told.doc_id).alias("held_out"), "lang_pred", "score")


@query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 2,048 words, one of a source and of a group of copies in each."""
    from . import packing

    return packing.pack(packing.sized(table(spark, sf_dir, "documents")))


@query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document by Viterbi search, and whether decoding gives the text back."""
    import public_tokenizers
    from pyspark.sql import functions as F

    from . import pieces

    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = pieces.decode(pieces.encode(docs, model), model)
    same = F.coalesce("text", F.lit("")) == F.col("decoded")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_ids"), same.alias("round_trip"), "ids")


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 50-word windows of earlier ones."""
    from . import substrings

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs, digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies among all documents: five-word shingles, Jaccard of 0.8."""
    from . import jaccard

    return jaccard.near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op8_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings with cosine 0.98 and equal labels."""
    from . import lattice

    return lattice.near_copies(table(spark, sf_dir, "embeddings"))


@query
def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest embeddings of every hundredth one, by greedy search of an NN-descent graph."""
    from pyspark.sql import functions as F

    from . import neighbours

    found = neighbours.nearest(table(spark, sf_dir, "embeddings"), F.pmod("id", F.lit(100)) == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of a byte-level BPE and of a piece model cover each other in every document."""
    import public_tokenizers

    from . import alignment

    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.aligned_counts(table(spark, sf_dir, "documents"), a, b, digest=True)


@query
def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stored rule bits of every document say under the strict policy."""
    from . import rules

    rows = rules.judged(rules.ledger(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", *rules.MEASURES, "failed", "base_failed", "kept")


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forms and roots of all words of the documents, one letter dropped in some."""
    from ..session import cut_lineage
    from . import spelling

    return spelling.variants(cut_lineage(spelling.word_counts(table(spark, sf_dir, "documents"), drop_one_in=31), "vocabulary"))
