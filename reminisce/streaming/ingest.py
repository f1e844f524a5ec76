"""Streams: messages taken in once and numbered per conversation, per-second flood counts, cache telemetry, spending windows.

State is keyed and lives in the state store; sinks are append-only or idempotent per batch, so a restarted query repeats nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from reminisce.sources.scratch import shared_folder


def folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream has now, through its sink: written as Parquet with its own checkpoint, and read back."""
    spark, path = stream.sparkSession, folder(stream.sparkSession)
    if mode == "append":
        stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{path}/out")
    write = lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/out/{batch}")
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/out")
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    last = max(int(x.getPath().getName()) for x in fs.listStatus(hadoop))
    return spark.read.parquet(f"{path}/out/{last}")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    name = path.rsplit("/", 1)
    files = spark.readStream.schema(schema).option("pathGlobFilter", name[1] if not _is_dir(spark, path) else "*.parquet").parquet(path if _is_dir(spark, path) else name[0])
    return files.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def deduplicated(stream: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """Each key once within the watermark: idempotent intake."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, width: str, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Rows and values by tumbling window and type."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def over_limit(stream: DataFrame, width: str, limit: int, key: str, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Windows in which a key came more than `limit` times: floods and spending."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select(key, F.col("w.start").alias("start"), "n")


def numbered(stream: DataFrame, key: str, order: str) -> DataFrame:
    """key, order and seq: rows numbered on for each key from what its state has counted, in the order of each batch."""
    schema = f"{key} long, {order} long, seq long"

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = sorted(x for f in frames for x in f[order].tolist())
        n = state.get[0] if state.exists else 0
        state.update((n + len(rows),))
        yield pd.DataFrame({key: [k[0]] * len(rows), order: rows, "seq": range(n + 1, n + len(rows) + 1)})

    return stream.select(key, order).groupBy(key).applyInPandasWithState(step, schema, "n long", "append", GroupStateTimeout.NoTimeout)


def telemetry(stream: DataFrame, key: str, cold_after: int = 2) -> DataFrame:
    """key, state (hot, cold, unknown), cold streak and turns of each key, as an update stream of (key, cached)."""
    schema = f"{key} long, state string, cold_streak long, turns long"

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        hot, streak, turns = state.get if state.exists else (False, 0, 0)
        for f in frames:
            for cached in f["cached"].tolist():
                turns += 1
                hot, streak = (True, 0) if cached > 0 else (hot, streak + 1)
        state.update((hot, streak, turns))
        name = "cold" if streak >= cold_after else "hot" if hot else "unknown"
        yield pd.DataFrame({key: [k[0]], "state": [name], "cold_streak": [streak], "turns": [turns]})

    return stream.select(key, "cached").groupBy(key).applyInPandasWithState(step, schema, "hot boolean, streak long, turns long", "update", GroupStateTimeout.NoTimeout)
