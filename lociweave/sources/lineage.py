"""Cutting a plan's lineage by a table in the folder that the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the folder of ``spark.checkpoint.dir`` and read again: what follows neither repeats it nor carries its plan, and knows its size.

    Only where that is unset and all runs on this machine, as in tests, a temporary folder is used. Like checkpoints, the
    tables stay until the folder is cleared, as results read them.
    """
    spark = df.sparkSession
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(path)
    path = f"{path.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
