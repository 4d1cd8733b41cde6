"""The registered queries of the training-data operators; each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_round_trip
from .common import id_bucket, read_table
from .decontaminate import benchmark_hits
from .html import extract_main_text
from .media import media_columns
from .neardup import near_duplicates
from .oracles import ORACLES
from .ppm import score_texts
from .pii import pseudonymise
from .quality import fit_quality, quality_scores
from .substrings import remove_repeats
from .toxicity import fit_toxicity, toxicity_scores

#: Name of the public vocabulary file of the queries below; operators take any path.
VOCABULARY = "byte_bpe_50k.json"


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text they decode to, as digests."""
    coded = bpe_round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document, learned from the labels of documents that aren't held out."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = fit_quality(docs, labels, train=id_bucket("doc_id", 5) != 0)
    return quality_scores(docs, model).select("doc_id", (id_bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document, learned from the labels of documents that aren't held out."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels, train=id_bucket("doc_id", 3) != 1)
    return toxicity_scores(docs, model).select("doc_id", (id_bucket("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: three-word shingles, similarity 0.85 or more."""
    return near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_main_text(read_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as sound: digests of the samples read back, of the file, and of its fingerprint."""
    made = media_columns(read_table(spark, sf_dir, "documents"))
    prints = F.array_join(F.col("fingerprint").cast("array<string>"), ",")
    return made.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("fingerprint").cast("string"), F.sha2(prints, 256)).alias("feature"),
    )


#: Key of the pseudonyms; a deployment sets its own.
PII_KEY = "plumbline-example-key"


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data as pseudonyms."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, PII_KEY)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages, with the passage and how near it is."""
    return benchmark_hits(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of every document, by partial matching and by unigrams, learned from those not held out."""
    held_out = id_bucket("doc_id", 5) == 1
    scored = score_texts(read_table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 35-word passages that occur more than once."""
    done = remove_repeats(read_table(spark, sf_dir, "documents"), window=35)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html": op1_html,
    "op2_decontamination": op2_decontamination,
    "op3_toxicity": op3_toxicity,
    "op4_pii": op4_pii,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_substrings": op6_substrings,
    "op7_lm": op7_lm,
    "op8_media": op8_media,
    "op9_bpe": op9_bpe,
    "op10_quality": op10_quality,
}
