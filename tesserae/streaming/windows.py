"""Structured Streaming: windowed event counts with a watermark, and dictionary tagging of a document stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tesserae.operators import dictionary


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) of a stream of events (ts, event_type, value)."""
    g = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding_counts(events: DataFrame, width: str, slide: str, late: str = "1 hour") -> DataFrame:
    """(start, event_type, n) over windows of ``width`` that start every ``slide``."""
    g = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width, slide), "event_type")
    return g.agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def deduplicated(records: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """Records (ts, key, ...) without later ones of the same key; keys are kept only for ``late``."""
    return records.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def tagged(docs: DataFrame, aliases: DataFrame, sizes: list[int]) -> DataFrame:
    """Mentions of a document stream against a static alias table: a stream-static join without state."""
    return dictionary.tag_exact(docs, aliases, sizes=sizes)


def run_available(stream: DataFrame, mode: str) -> DataFrame:
    """All that is available now, through the stream's engine, as a table in shared storage.

    Output and the engine's checkpoint lie below spark.checkpoint.dir, which only a local master may leave out. With mode
    complete a batch replaces what earlier ones wrote, else it is added under its number, so a repeated batch is one.
    """
    spark = stream.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = f"{(base or '/tmp/checkpoints').rstrip('/')}/streams/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out" if mode == "complete" else f"{path}/out/batch={number}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(write)
    query: StreamingQuery = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def file_stream(table: DataFrame) -> DataFrame:
    """A stream of the files that a table was read from; a file stream reads a folder, also where the table is one file in it."""
    folder, name = table.inputFiles()[0].rsplit("/", 1)
    reader = table.sparkSession.readStream.schema(table.schema)
    return reader.parquet(folder) if folder.endswith(".parquet") else reader.option("pathGlobFilter", name).parquet(folder)
