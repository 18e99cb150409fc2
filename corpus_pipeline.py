"""A training corpus in five stages; each reads what its predecessor kept and wrote.

toxicity drops documents scored 0.5 or more; line dedup cuts later copies of line runs (three lines, or eight words) from texts and drops documents it empties; the n-gram join
keeps one document (smallest doc_id, then text) of each component of links at 0.8 similarity of five-word shingles; decontamination drops documents that hold a
benchmark item; mixing gives each document the number of words the mix takes from it and drops those it takes none of.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haploframe.llm import decontamination, jaccard, lines, mixing, toxicity
from haploframe.llm.common import documents, keep

#: Mixing and the near-duplicate join have no SQL form together with a trained classifier; tests compare each stage by brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # What has lost all its lines is a copy: no word of it is left for the n-gram join to tell.
    found = lines.dedup_lines(docs, min_words=lines.MIN_WORDS).filter((F.col("n_removed") == 0) | (F.col("text") != ""))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else found.select(docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, jaccard.STAGE)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    taken = mixing.mix_sources(docs)
    return taken.filter("taken > 0")


STAGES = [("toxicity", drop_toxic), ("line dedup", dedup_lines), ("n-gram join", keep_one_of_each), ("decontamination", decontaminate), ("mixing", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
