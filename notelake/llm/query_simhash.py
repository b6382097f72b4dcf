"""SimHash components of all documents."""

from pyspark.sql import DataFrame, SparkSession

from notelake.llm.queries import documents, query
from notelake.llm.simhash import simhash_components


@query("op2_simhash")
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir), k=3, radius=2)
