"""Best-fit packing of all documents."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from notelake.llm.packing import pack
from notelake.llm.queries import documents, query


@query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)
