"""Streams of events (event_id, ts, user_id, event_type, value): windows, sessions, late rows, duplicates, alerts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sextant.storage import shared_folder


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Event files as a stream, from a folder or one file. ts is stored without a zone, which watermarks don't take, so it
    becomes a timestamp."""
    schema = spark.read.parquet(path).schema
    # As a pattern, since a source that isn't one must be a folder.
    path = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all that is there now into a table of the shared folder, and reads that: the rows that append mode has
    given out. Its checkpoint lies beside the table."""
    folder = f"{shared_folder(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).format("parquet").start(f"{folder}/rows").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes", *keys: str) -> DataFrame:
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w, *keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.percentile("value", 0.95).alias("p95")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "mean", "p95")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    by = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return by.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def distinct_events(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def suppressed(candidates: DataFrame, minutes: int, key: str = "event_type") -> DataFrame:
    """(key, ts) of emitted alerts of a stream: the state of a key is the time of its last emitted alert."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for t in sorted(t for pdf in batches for t in pdf["ts"]):
            at = int(t.timestamp() * 1_000_000)
            if last is None or at > last + minutes * 60_000_000:
                out.append((k[0], t))
                last = at
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=[key, "ts"])

    kind = dict(candidates.dtypes)[key]
    return candidates.select(key, "ts").groupBy(key).applyInPandasWithState(run, f"{key} {kind}, ts timestamp", "last long", "append", GroupStateTimeout.NoTimeout)
