"""Small tables that several actions read, stored once on shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame


def stored(table: DataFrame) -> DataFrame:
    """Compute a table once, on shared storage, and cut its lineage there.

    Uses the folder the cluster names in ``spark.checkpoint.dir``, so the rows
    survive the loss of an executor. There is no other folder to fall back on.
    """
    spark = table.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(folder)
    return table.checkpoint()
