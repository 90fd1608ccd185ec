"""Tables on the folder that all executors share, for steps that read a result more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a new temporary folder only where it is unset and all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder not used yet below the shared one."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str = "step", by: tuple[str, ...] = ()) -> DataFrame:
    """df, written once and read again: its plan ends here and lost executors don't bring it back. by: few values each; a filter on them reads only their files."""
    path = new_folder(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
