"""The corpus pipeline: five stages over ``documents``, each reading what the one before it kept.

toxicity (rejected documents go), near duplicates (one document of each group stays), benchmark
decontamination (passages are cut out), mixing sources to target weights (rows repeat as often as they are
taken), sharding (the last; its rows say where each document goes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from screenlake.functions.storage import stored
from screenlake.llm import decontaminate, mixing, near_dedup, sharding
from screenlake.llm import toxicity as toxic


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxic.drop_toxic(docs, toxic.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.cut_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take_mix(docs)


def _shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.kd_shards(docs)


STAGES = [("toxicity", _toxicity), ("near_dedup", _near_dedup), ("decontaminate", _decontaminate), ("mix", _mix), ("shard", _shard)]

#: SQL can express neither the segment search nor the signatures; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
