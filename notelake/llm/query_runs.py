"""Periodic runs of all documents, every tenth stretched by a repeated beginning."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.queries import documents, query
from notelake.llm.runs import periodic_runs, stretched


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(stretched(documents(spark, sf_dir)))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
    period = -F.col("best.period")
    return out.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), period.alias("period"), F.floor(F.col("best.length") * 1000 / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
