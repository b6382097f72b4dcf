"""Classes of documents whose 3-word shingles overlap in nine tenths."""

from pyspark.sql import DataFrame, SparkSession

from notelake.llm.join import jaccard_components
from notelake.llm.queries import documents, query


@query("op12_ngram_join")
def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir), k=3)
