"""Personal data in all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.pii import KINDS, find_personal_data, listed
from notelake.llm.queries import documents, query


@query("op6_pii")
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = find_personal_data(documents(spark, sf_dir).select("doc_id", "text"))
    number = lambda kind: F.size(F.filter("base", lambda x: x["name"] == kind)).cast("long")
    counts = [number(k).alias(f"n_{k}") for k in KINDS]
    return made.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
