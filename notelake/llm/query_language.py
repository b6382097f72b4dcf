"""Language of all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.language import detect, learn_languages
from notelake.llm.queries import documents, query


@query("op5_language")
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    made = detect(docs, *learn_languages(docs.where(fold != 1)))
    return made.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
