"""Quality rules over all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.queries import documents, labels, query
from notelake.llm.rules import judged


@query("op7_quality_rules")
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = judged(documents(spark, sf_dir), labels(spark, sf_dir), keep=["doc_id"])
    counts = [F.col(f"_counts.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return made.select("doc_id", *counts, F.col("_base_failed").alias("base_failed"), (~F.col("_base_failed") & F.col("_rule").isNull()).alias("kept"), F.col("_rule").alias("rule"))
