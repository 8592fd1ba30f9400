"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, decontaminate, html_extract, jaccard, ogg, quality, suffix_dedup, superkmer_dedup, token_counts, toxicity
from .oracles import ORACLES


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Place of a public tokenizer file; the files stay where they are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"), length=50, with_text=False)


def op2_jaccard_join(spark, sf_dir):
    return jaccard.classes(read(spark, sf_dir, "documents"), size=4, num=85, den=100)


def op3_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op4_decontamination(spark, sf_dir):
    found = decontaminate.spans(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), window=10)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda t, x: t + x["end"] - x["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op5_superkmer_dedup(spark, sf_dir):
    return superkmer_dedup.remove_windows(read(spark, sf_dir, "documents"), length=20, with_text=False)


def op6_ogg(spark, sf_dir):
    return ogg.store_documents(read(spark, sf_dir, "documents"), with_media=False)


def op7_quality(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, read(spark, sf_dir, "labels")), threshold=0.3)


def op8_html_extraction(spark, sf_dir):
    return html_extract.extract_pages(read(spark, sf_dir, "pages"))


def op9_bpe(spark, sf_dir):
    return bpe_codec.encode_documents(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), with_text=False)


def op10_token_counts(spark, sf_dir):
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_jaccard_join, op3_toxicity, op4_decontamination, op5_superkmer_dedup, op6_ogg, op7_quality, op8_html_extraction, op9_bpe, op10_token_counts)}

__all__ = ["ORACLES", "QUERIES", "read", "tokenizer"]
