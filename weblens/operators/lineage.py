"""Cutting the lineage of iterative jobs in the folder that the session names."""

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint of a frame; where the session names no folder and all runs on one machine, in a temporary one."""
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()
