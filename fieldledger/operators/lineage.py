"""Cut the lineage of small intermediate tables that several later steps read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``.

    Only a session that runs in this one process may leave it unset: it gets a fresh folder. On a cluster, where a
    local folder would be another one on every machine, this raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="run-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Compute once into a table in the shared folder and read that instead.

    The table outlives any executor, and unlike a checkpoint it is computed in a single pass and keeps
    its size known to the optimizer.
    """
    path = f"{shared_folder(df.sparkSession)}/fieldledger-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
