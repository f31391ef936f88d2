"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written below ``spark.checkpoint.dir`` and read again; on one machine, the warehouse does where that is unset."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    base = base or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
