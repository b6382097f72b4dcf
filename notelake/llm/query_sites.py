"""Quality of all documents with their sites: the source is the host, source and language the path."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.queries import documents, labels, query
from notelake.llm.sites import site_quality


@query("op4_site_quality")
def op4_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return site_quality(docs, labels(spark, sf_dir), host=F.col("source"), path=F.concat_ws("/", "source", "lang"))
