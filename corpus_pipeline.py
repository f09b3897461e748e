"""A corpus pipeline: language, near-duplicates, benchmark passages, personal data, mix.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and returns a DataFrame that is written as Parquet and read again as the next
one's docs.  All but the last return the columns of ``documents``.

Defined results: rows with a null or empty text, or one without letters, go at the first
stage; very long texts are rows like any other, cut nowhere; of repeated rows, and of texts that
are near-duplicates, one stays; unlike texts of one id are documents of their own; rows with
a null id are never near-duplicates; ties between languages go to the first by code
point; further columns, whatever their names, are carried along up to the mix; empty
tables give empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squall.llm import decontaminate, language, mixing, near_dedup, pii
from squall.llm.common import shared_dir, table
from squall.shipping import ship

#: Of a text's words with letters, the share that its language needs at least.
MIN_SHARE = 0.5


def one_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and texts of which no language holds half."""
    ship(spark)
    found = language.predictor(spark, language.train(docs))(F.col("text"))
    judged = docs.select(F.struct(*docs.columns).alias("whole"), found.alias("found"))
    return judged.where((F.col("found.lang") != "und") & (F.col("found.score") >= MIN_SHARE)).select("whole.*")


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the least id: shingles of five words, similarity 0.8."""
    ship(spark)
    return near_dedup.drop_near_duplicates(docs, percent=80, width=5)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    ship(spark)
    return decontaminate.clean_only(docs, table(spark, sf_dir, "benchmark"))


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text."""
    ship(spark)
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    return mixing.mix(spark, docs).select("doc_id", "size", "source_size", "target", "taken")


STAGES = [
    ("language", one_language),
    ("near_duplicates", no_near_duplicates),
    ("benchmark", no_benchmark),
    ("personal_data", no_personal_data),
    ("mix", mixed),
]

#: SQL can express neither the learned stages nor their order; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; a stage's files go once the next one's are written."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for k, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return made
        made.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}"), True)
