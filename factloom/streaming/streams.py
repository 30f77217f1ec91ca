"""Append-only stores as streams: windows, first deliveries, histories, sessions."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..runtime import path_exists, shared_dir


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table of root as a stream of its files."""
    schema = spark.read.parquet(f"{root}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(root)


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What the stream gives for all that is there now, as a table in the shared folder.

    In ``complete`` mode every batch replaces the table, so nothing waits for a watermark.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"
    w = stream.writeStream.option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True)
    if mode == "complete":
        q = w.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{base}/out")).start()
    else:
        q = w.format("parquet").option("path", f"{base}/out").start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def window_counts(events: DataFrame, at: str, key: str, value: str, width: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """(start, key, n, total) per tumbling window; in append mode windows close when the watermark passes them, in complete mode all are there."""
    w = events.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("window.start").alias("start"), key, "n", "total")


def first_deliveries(events: DataFrame, key: str, at: str, late: str = "30 days") -> DataFrame:
    """The first row of each key; redeliveries within the watermark are dropped."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, key: str, at: str, gap_seconds: int = 1800, late: str = "1 hour") -> DataFrame:
    """(key, started, ended, n) of runs of events without a longer gap, by custom state.

    A session ends when the watermark has passed its last event by the gap; events
    later than ``late`` are dropped by the stream.  open_sessions has those that have
    not ended.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            out.append((k[0], *state.get))
            state.remove()
        else:
            times = sorted(int(t) for b in batches for t in b["us"])
            held = list(state.get) if state.exists else None
            for t in times:
                if held is not None and t - held[1] > gap_seconds * 1_000_000:
                    out.append((k[0], *held))
                    held = None
                held = [t, t, 1] if held is None else [min(held[0], t), max(held[1], t), held[2] + 1]
            state.update(tuple(held))
            state.setTimeoutTimestamp(max(held[1] // 1000 + gap_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "started", "ended", "n"])

    d = events.withWatermark(at, late).select(F.col(key).cast("string").alias("key"), F.col(at), F.unix_micros(at).alias("us"))
    return d.groupBy("key").applyInPandasWithState(step, "key string, started long, ended long, n long", "started long, ended long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def open_sessions(events: DataFrame, closed: DataFrame, key: str, at: str, gap_seconds: int = 1800) -> DataFrame:
    """(key, started, ended, n) of the sessions of a table of events that the stream has not closed: the events after each key's last closed one."""
    last = closed.groupBy("key").agg(F.max("ended").alias("last"))
    e = events.select(F.col(key).cast("string").alias("key"), F.col(at).alias("at"), F.unix_micros(at).alias("us"))
    rest = e.join(last, "key", "left").filter("last is null or us > last")
    # Events exactly a gap apart are one session.
    g = rest.groupBy("key", F.session_window("at", f"{gap_seconds} seconds 1 microsecond"))
    return g.agg(F.min("us").alias("started"), F.max("us").alias("ended"), F.count("*").alias("n")).select("key", "started", "ended", "n")


def append_versions(stream: DataFrame, path: str, key: str) -> None:
    """Appends versions whose key the store lacks, batch by batch: a replayed batch changes nothing."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key])
        if path_exists(spark, path):
            new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
        new.write.mode("append").parquet(path)

    q = stream.writeStream.foreachBatch(add).option("checkpointLocation", path.rstrip("/") + ".state").trigger(availableNow=True).start()
    q.awaitTermination()
