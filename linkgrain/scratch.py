"""Tables that cut a lineage: written to the shared folder, so that a lost executor does not take them along."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir`` (where unset, as in tests, the warehouse)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base}/linkgrain/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to ``spark.checkpoint.dir`` (where unset, the warehouse) and read again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` for a join that deals and sorts both sides.  Ids, paths and lines pack so well that tables of
    millions look small enough to be sent whole through the driver, which does not hold them."""
    return df.hint("merge")
