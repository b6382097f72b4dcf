"""Damaged conversations and their cheapest repair."""

from pyspark.sql import DataFrame, SparkSession

from notelake.llm.queries import query
from notelake.llm.repair import damaged, repaired_conversations


@query("op13_conversation_repair")
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repaired_conversations(damaged(rows), original=rows)[0]
