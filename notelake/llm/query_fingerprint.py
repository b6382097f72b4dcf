"""Fingerprints of all documents and of their edited texts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.fingerprint import fingerprint_edits
from notelake.llm.queries import documents, query


@query("op1_fingerprint")
def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprint_edits(documents(spark, sf_dir))
    return made.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
