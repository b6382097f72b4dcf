"""Toxicity of all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.queries import documents, labels, query
from notelake.llm.toxicity import learn_toxicity, score_toxicity


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    made = score_toxicity(docs, *learn_toxicity(docs, labels(spark, sf_dir).where(fold != 0)))
    return made.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_toxic")
