"""Streaming twins of the journal and telemetry operators (T-3, T-4, T-10, T-12, A6)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..storage import new_path


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """All that is available now, run through to Parquet tables, each batch written once by its number.

    In complete mode a batch holds the whole result, so the last one is read; in append mode all are.
    """
    spark, schema = stream.sparkSession, stream.schema
    out, numbers = new_path(spark, "stream"), []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        numbers.append(number)

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", new_path(spark, "offsets")).trigger(availableNow=True).start()
    query.awaitTermination()
    if not numbers:
        return spark.createDataFrame([], schema)
    read = [max(numbers)] if mode == "complete" else sorted(set(numbers))
    return spark.read.schema(schema).parquet(*[f"{out}/batch={n}" for n in read])


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def hourly(events: DataFrame) -> DataFrame:
    """Tumbling hours with a watermark of a day; late rows within it still count."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")
    found = timed.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(F.date_format("w.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", "total")


def journal_fold(events: DataFrame) -> DataFrame:
    """T-4 as state by stream and entity: the last event decides."""
    last = F.max_by(F.struct("op", "event_id"), F.struct("ts", "event_id")).alias("l")
    return events.groupBy("stream", "entity").agg(last).select("stream", "entity", "l.op", "l.event_id")


def apply_batches(events: DataFrame) -> DataFrame:
    """T-3: (stream, sequence, status) of each event, with a cursor as each stream's state.

    The next number is applied and moves the cursor, one at or below it is a duplicate, a later one is a conflict.
    Needs (stream, sequence); rows of a batch are taken in order of sequence.
    """

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cursor = state.get[0] if state.exists else 0
        numbers = sorted(int(n) for part in rows for n in part.sequence)
        found = []
        for n in numbers:
            found.append("applied" if n == cursor + 1 else "duplicate" if n <= cursor else "conflict")
            cursor += n == cursor + 1
        state.update((cursor,))
        yield pd.DataFrame({"stream": key[0], "sequence": numbers, "status": found})

    return events.groupBy("stream").applyInPandasWithState(step, "stream long, sequence long, status string", "cursor long", "append", GroupStateTimeout.NoTimeout)
