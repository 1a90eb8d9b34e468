"""A corpus pipeline of five stages, each one of the llm operators over all that its predecessor kept.

Defined results: rows with null or empty texts pass all filters as texts without words, but rows that repeat both id and text are one
row after near-duplicate removal; a row without an id stays if no row of its class has one and it is the class's first; n_chars
follows a text that was cut, and stays as it is otherwise; extra columns stay, whatever their names and types; without labels of both
values nothing is rejected; an empty table gives an empty result. Ids are whole numbers, as substring dedup orders rows by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, near_dup, packing, substring_dedup, toxicity
from quern.llm.common import staged
from quern.llm.queries import tokenizer_path


def _retexted(docs: DataFrame, cut: DataFrame) -> DataFrame:
    """docs with the texts of cut (doc_id, text, changed); the columns, their order and their types stay."""
    text = F.col("_new")
    size = F.when(F.col("_changed"), F.char_length("_new")).otherwise(F.col("n_chars"))
    made: dict[str, Column] = {"text": text, "n_chars": size.cast(docs.schema["n_chars"].dataType)}
    return cut.select(*[made[c].alias(c) if c in made else F.col(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go. Labels of the held-out fold are never learned from."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judge = toxicity.flag(docs, model)
    return judge.filter(~F.col("_toxic")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that with the smallest id."""
    return near_dup.keep_one(docs).select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document holds go; a text that loses none stays as it is."""
    return _retexted(docs, substring_dedup.retext(docs))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts."""
    return _retexted(docs, decontaminate.retext(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    return packing.pack(docs, packing.PackingParams(tokenizer_path()))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: A trained classifier and a tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
