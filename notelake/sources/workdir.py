"""Shared working folder and lineage cuts."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Plans that are made and run with this leave no shuffle files. Else those stay until the driver happens to collect its
#: garbage, and the shuffles of all steps of a query lie on disk together.
SHUFFLES_REMOVED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session for the plans that are made and run inside."""
    before = {name: spark.conf.get(name) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def work_dir(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a
    cluster the folder has to be shared and therefore has to be named.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext.getCheckpointDir()
    if not named and not held and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if not named:
        named = held.rsplit("/", 1)[0] if held else tempfile.mkdtemp(prefix="notelake-")
    if not held:
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame, more: dict[str, str] | None = None) -> DataFrame:
    """Reliable checkpoint of a result that several later steps read; ``more`` are settings it is planned with."""
    work_dir(df.sparkSession)
    with settings(df.sparkSession, SHUFFLES_REMOVED | (more or {})):
        return df.select("*").checkpoint()  # a plan of its own: that of df may run again
