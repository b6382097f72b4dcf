"""Rates that mix all documents to target weights of the languages."""

from pyspark.sql import DataFrame, SparkSession

from notelake.llm.mixing import mixed_rates
from notelake.llm.queries import documents, query

TARGETS = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}


@query("op9_mixing")
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return mixed_rates(docs, docs, TARGETS).select("doc_id", "tokens", "posterior", "rate", "copies")
