"""Tables kept in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Paths of the tables kept so far.
_KEPT: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. A folder of our own serves only where driver and executors are one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not context.getCheckpointDir():
            if not re.match(r"local($|\[)", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="reminisce-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """df written once and read back, so that what follows doesn't recompute it, on any executor."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _KEPT.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> int:
    """Deletes the tables that this process has kept, once no result that reads them is needed; how many there were."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    n = len(_KEPT)
    while _KEPT:
        path = jvm.org.apache.hadoop.fs.Path(_KEPT.pop())
        path.getFileSystem(conf).delete(path, True)
    return n
