"""Session helpers shared by operators that have to cut lineage."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; only a local master may fall back to a temporary one."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="plumbline-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


_written: list[str] = []


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that `checkpointed` writes inside the block when the block ends. For jobs
    that have written their results by then; a DataFrame that still reads such a table fails."""
    start = len(_written)
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for name in _written[start:]:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)
        del _written[start:]


def checkpointed(df: DataFrame) -> DataFrame:
    """Write `df` once below the checkpoint folder and read it back.

    Later reads see the same rows in the same placement columns even when executors are lost, their
    plans start at a scan that prunes columns, and its size is known to the optimizer.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
