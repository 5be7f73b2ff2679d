"""Tables in the folder that all executors share, for plans that grow round by round."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, which ``spark.checkpoint.dir`` or ``setCheckpointDir`` names.

    Where it is unset a local session, whose only executor is the driver, gets a
    temporary folder of its own; on a cluster that would be another one on each machine,
    so it is an error there.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="ledgerleaf-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/ledgerleaf-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out.staged_path = path
    return out


def drop(*staged: DataFrame) -> None:
    """Delete staged tables that nothing still to be run reads."""
    for df in staged:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession, rows: int = 250) -> None:
    """Texts go to Python in Arrow batches of at most so many rows, unless the session asks for another number than Spark's.

    A task holds a batch on both sides, beside the heap, and Spark's 10,000 rows of texts are tens of MB each time.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
