"""Structured Streaming over event files: closed sessions, first arrivals, running state, and a sink that adds each key once.

Each query reads its files to the end and stops; state and checkpoints live in the shared folder, so that a query that is
started again goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.files import appended
from ..sources.stored import shared_path

#: What keyed state is kept in.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(rows: DataFrame, mode: str) -> DataFrame:
    """All that a streaming frame gives until its source is read, as a table."""
    spark, path = rows.sparkSession, shared_path(rows.sparkSession)
    rows.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/state").option("path", f"{path}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/out")


def closed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, start, n of sessions with gaps under 30 minutes that the watermark has passed; those still open have no row."""
    rows = _events(spark, sf_dir).withWatermark("ts", "10 minutes").groupBy(F.session_window("ts", "30 minutes").alias("s"), "user_id").agg(F.count("*").alias("n"))
    found = _drained(rows.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n"), "append")
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


def first_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id of each event once, of a stream that brings every event twice within the watermark's reach."""
    twice = _events(spark, sf_dir).select("event_id", F.explode(F.array("ts", F.col("ts") + F.expr("INTERVAL 1 MINUTE"))).alias("ts"))
    return _drained(twice.withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["event_id"]).select("event_id"), "append")


class Totals(StatefulProcessor):
    """Keeps the number of events and clicks of a user and gives them after each batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", StructType([StructField("n", LongType()), StructField("clicks", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, clicks = self.seen.get() if self.seen.exists() else (0, 0)
        for part in rows:
            n, clicks = n + len(part), clicks + int((part["event_type"] == "click").sum())
        self.seen.update((n, clicks))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "clicks": [clicks]})

    def close(self) -> None:
        pass


def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, n, clicks at the end of the stream, from keyed state."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        schema = "user_id long, n long, clicks long"
        rows = _events(spark, sf_dir).select("user_id", "event_type").groupBy("user_id").transformWithStateInPandas(Totals(), schema, "update", "none")
        path, batches = shared_path(spark), []

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/out/{number}")
            batches.append(f"{path}/out/{number}")

        rows.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(schema).parquet(*batches).groupBy("user_id").agg(F.max("n").alias("n"), F.max("clicks").alias("clicks"))


def reviewed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source of documents that the labels lack, from a stream of documents; each batch adds the keys that the sink lacks,
    so that a batch that comes again adds nothing."""
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/documents*")
    path = shared_path(spark)

    def add(batch: DataFrame, number: int) -> None:
        known = batch.sparkSession.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id").distinct()
        new = batch.select("doc_id", "source").join(known, "doc_id", "left_anti")
        for _ in range(2):  # as if it came again
            appended(batch.sparkSession, f"{path}/out", new, "doc_id")

    stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(add).start().awaitTermination()
    return spark.read.schema("doc_id long, source string").parquet(f"{path}/out")
