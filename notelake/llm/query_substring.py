"""Repeated passages of 35 words in all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.queries import documents, query
from notelake.llm.substring import repeated_passages


@query("op8_substring")
def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut, whole = repeated_passages(documents(spark, sf_dir), window=35)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")).union(whole.select("doc_id", "n_words", F.lit(0).cast("long"), "whole"))
