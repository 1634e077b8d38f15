"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.

    Where none is set: the session's checkpoint folder, else a temporary folder
    in local mode (as in tests), else a folder in the warehouse, which executors
    share.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    local = spark.sparkContext.master.split("[")[0] == "local"
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stored")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from Parquet: lineage ends here, and lost executors cost nothing that came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Send whole texts to Python in batches of at most `rows` rows, and no more rows once a batch has `size` bytes: ten thousand long texts at once would fill a worker.

    The session's limits are lowered where they are higher, and stay so.
    """
    rows_key, size_key = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows_key)) <= rows:
        spark.conf.set(rows_key, str(rows))
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(size_key)) <= size:
        spark.conf.set(size_key, str(size))
