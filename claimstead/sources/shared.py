"""Cutting lineage where a result is used several times, and spreading few splits over all cores."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def durable(rows: DataFrame) -> DataFrame:
    """Runs rows once and keeps them in the folder of spark.checkpoint.dir, which all executors share.

    Where it is unset, as in tests on a local master, a new local folder serves; on a cluster it has to be set.
    """
    spark = rows.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="claimstead-"))
    return rows.checkpoint(eager=True)


def spread(rows: DataFrame) -> DataFrame:
    """Rows over at least as many partitions as there are cores: for work that costs far more than its reading."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.isStreaming or rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)
