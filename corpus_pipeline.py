"""From raw documents to token ids, in five stages; each stage's rows are written as Parquet and read by the next.

1. quality classifier: documents that it rejects go;
2. n-gram Jaccard join (five words, similarity 0.8): the smallest id of each class stays;
3. suffix-array deduplication: strings of 50 bytes stay in their smallest id only;
4. benchmark decontamination: documents that hold a window of ten benchmark words go;
5. BPE encoding, with the digest of the decoded text.

Rows with a null id or text pass through the stages that cannot judge them. All stages but
the last return the columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe_codec, decontaminate, jaccard, quality, suffix_dedup
from palimpsest.llm.queries import read, tokenizer
from palimpsest.llm.shared import remove, shared_folder


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, read(spark, sf_dir, "labels"), threshold=0.3)


def keep_first_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.first_of_classes(docs, size=5, num=80, den=100)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(docs, length=50).withColumn("n_chars", F.char_length("text").cast("long"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"), window=10)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe_codec.encode_documents(docs, tokenizer("byte_bpe_50k.json"))
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", keep_quality),
    ("near_copies", keep_first_of_near_copies),
    ("repeats", cut_repeats),
    ("contamination", drop_contaminated),
    ("tokens", encode),
]

#: The stages learn a model, sort suffixes and merge byte pairs: tested against brute force instead.
ORACLE_SQL = None


#: Folders of runs in this session whose result may still be read.
_FOLDERS: list[str] = []


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    A stage's rows go once the next stage's are written; those that the result is read from stay
    in the shared folder until ``clean``.
    """
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs, done = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if done:
            remove(spark, done)
        done = f"{folder}/{name}"
    _FOLDERS.append(folder)
    return STAGES[-1][1](spark, docs, sf_dir)


def clean(spark: SparkSession) -> None:
    """Removes what this session's runs left in the shared folder; their results cannot be read afterwards."""
    while _FOLDERS:
        remove(spark, _FOLDERS.pop())
