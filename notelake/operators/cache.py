"""Read-through cache of model results, kept as Parquet files that runs append to."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.operators.rerank import cache_merge, cache_misses
from notelake.sources.workdir import cut

SCHEMA = "cache_key string, result_json string, created_at long"


@dataclass(frozen=True)
class ResultCache:
    """Results by key below ``root``. Those older than ``ttl_ms`` at ``now_ms`` do not count."""

    root: str
    now_ms: int
    model: str = "model"
    ttl_ms: int = 3_600_000

    def entries(self, spark: SparkSession) -> DataFrame:
        """Newest live entry per key; none if nothing was written yet."""
        try:
            held = spark.read.schema(SCHEMA).option("recursiveFileLookup", True).parquet(f"{self.root}/entries")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            held = spark.createDataFrame([], SCHEMA)
        live = held.filter(F.lit(self.now_ms) - F.col("created_at") <= self.ttl_ms)
        return cache_merge(live, live.limit(0))

    def add(self, fresh: DataFrame) -> None:
        """Append ``cache_key, result_json``. Each run writes a folder of its own, so runs do not disturb each other."""
        rows = fresh.select("cache_key", "result_json", F.lit(self.now_ms).alias("created_at"))
        rows.write.parquet(f"{self.root}/entries/run={uuid.uuid4().hex}")


def read_through(keyed: DataFrame, compute: Callable[[DataFrame], DataFrame], item: str, cache: ResultCache) -> DataFrame:
    """``query_id`` and the columns of ``item`` of every query, computed only for keys without a live entry.

    ``keyed``: ``query_id, cache_key``. ``compute`` gets the ids of one query per missing key and returns their rows;
    queries it returns nothing for are not kept and are asked again next time. A key's rows are one bounded result.
    """
    spark = keyed.sparkSession
    held = cut(cache.entries(spark).join(keyed.select("cache_key").distinct(), "cache_key", "left_semi"))
    first = keyed.groupBy("cache_key").agg(F.min("query_id").alias("query_id"))
    missing = cut(cache_misses(first, held, cache.now_ms, cache.ttl_ms))
    known = held.select("cache_key", "result_json")
    if not missing.isEmpty():
        names = [part.split()[0] for part in item.split(", ")]
        rows = compute(missing.select("query_id")).select("query_id", F.struct(*names).alias("_row"))
        fresh = cut(rows.join(missing, "query_id").groupBy("cache_key").agg(F.to_json(F.collect_list("_row")).alias("result_json")))
        cache.add(fresh)
        known = known.unionByName(fresh)
    parsed = keyed.join(known, "cache_key").select("query_id", F.explode(F.from_json("result_json", f"array<struct<{item.replace(' ', ':').replace(',:', ',')}>>")).alias("_row"))
    return parsed.select("query_id", "_row.*")
