"""Footfall: contract filter, deduplication, gaps and windows; the same functions serve batch and streams where Spark allows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "event_id string, sensor_id string, store_id string, site string, ts string, zone string, direction string, count int, dwell_seconds int, edge_seq long, quality string"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of JSON files of the form {"events": [...]}."""
    raw = spark.read.schema(f"events array<struct<{EVENT.replace(' ', ':').replace(',:', ',')}>>").json(path, multiLine=True)
    return raw.select(F.explode("events").alias("e")).select("e.*").withColumn("ts", F.to_timestamp("ts"))


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of newline-delimited event files that arrive in a folder."""
    return spark.readStream.schema(EVENT).json(path).withColumn("ts", F.to_timestamp("ts"))


def accepted(events: DataFrame) -> DataFrame:
    return events.where("count is not null and quality = 'ok'")


def rejected(events: DataFrame) -> DataFrame:
    return events.where("count is null or quality <> 'ok' or quality is null")


def with_reason(events: DataFrame) -> DataFrame:
    """events with the first reason to refuse each: no count, quality, or a number below one that its sensor sent before; else null.

    A repeated number is no break of the order: distinct_events leaves it out. Streams keep each sensor's highest number as state.
    """
    if events.isStreaming:
        return _numbered_stream(events)
    before = Window.partitionBy("sensor_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("_top", F.max("edge_seq").over(before)).withColumn("reason", _reason(F.col("edge_seq") < F.col("_top"))).drop("_top")


def _reason(behind: Column) -> Column:
    quality = F.coalesce(F.col("quality"), F.lit(""))
    return F.when(F.col("count").isNull(), "NULL_COUNT").when(quality != "ok", "QUALITY").when(behind, "NOT_MONOTONIC")


def _numbered_stream(events: DataFrame) -> DataFrame:
    schema = ", ".join(f"`{c}` {t}" for c, t in events.dtypes) + ", _behind boolean"

    def run(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        top = state.get[0] if state.exists else None
        own = pd.concat(batches).sort_values(["ts", "event_id"], kind="stable")
        behind = []
        for seq in own["edge_seq"].tolist():
            known = not pd.isna(seq)
            behind.append(bool(known and top is not None and seq < top))
            if known:
                top = int(seq) if top is None else max(top, int(seq))
        if top is not None:
            state.update((top,))
        yield own.assign(_behind=behind)

    marked = events.groupBy("sensor_id").applyInPandasWithState(run, schema, "top long", "append", GroupStateTimeout.NoTimeout)
    return marked.withColumn("reason", _reason(F.col("_behind"))).drop("_behind")


def route(events: DataFrame, kept: str, refused: str, checkpoint: str) -> StreamingQuery:
    """Write a stream of with_reason() to two folders, one per outcome; a batch that is repeated replaces its own files."""

    def both(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.where("reason is null").drop("reason").write.mode("overwrite").parquet(f"{kept}/batch={number}")
        batch.where("reason is not null").write.mode("overwrite").parquet(f"{refused}/batch={number}")
        batch.unpersist()

    query = events.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def distinct_events(events: DataFrame, late: str = "3 hours") -> DataFrame:
    """One event for each sensor and sequence number; a stream remembers them for `late`."""
    keys = ["sensor_id", "edge_seq"]
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("ts", "event_id"))
    return events.withColumn("_n", nth).where("_n = 1").drop("_n")


def windows(events: DataFrame, width: str = "15 minutes", late: str = "3 hours") -> DataFrame:
    """Footfall by store and window."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return (
        events.groupBy("store_id", F.window("ts", width).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.sum(F.when((F.col("zone") == "entrance") & (F.col("direction") == "in"), F.col("count")).otherwise(0)).alias("entered"),
            F.sum(F.when((F.col("zone") == "exit") & (F.col("direction") == "out"), F.col("count")).otherwise(0)).alias("left"),
            F.sum("count").alias("moves"),
            F.sum("dwell_seconds").alias("dwell_seconds"),
        )
        .select("store_id", F.col("w.start").alias("window_start"), "events", "entered", "left", "moves", "dwell_seconds")
    )


def gaps(events: DataFrame, key: str = "store_id", seq: str = "edge_seq") -> DataFrame:
    """Breaks of the sequence: last number before, first after, how many lack."""
    last = F.lag(seq).over(Window.partitionBy(key).orderBy(seq))
    return events.select(key, seq, last.alias("after_seq")).where(F.col(seq) > F.col("after_seq") + 1).select(key, "after_seq", F.col(seq).alias("next_seq"), (F.col(seq) - F.col("after_seq") - 1).alias("missing"))


def sliding_counts(events: DataFrame, key: str, ts: str, seconds: int) -> Column:
    """Events of the same key in the seconds up to each event, as a window expression; times are rounded to the nearest second, halves to even."""
    second = F.rint(F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).cast("bigint")
    return F.count(F.lit(1)).over(Window.partitionBy(key).orderBy(second).rangeBetween(-seconds, 0))


def on_hand(last_count: DataFrame, sales: DataFrame, receipts: DataFrame, key: str) -> DataFrame:
    """Stock after sales and receipts since the last count, never below zero."""
    moves = sales.select(key, (-F.col("quantity")).alias("d")).unionByName(receipts.select(key, F.col("quantity").alias("d"))).groupBy(key).agg(F.sum("d").alias("d"))
    return last_count.join(moves, key, "left").select(key, F.greatest(F.col("quantity") + F.coalesce("d", F.lit(0)), F.lit(0)).alias("on_hand"))


def shared_references(sales: DataFrame, hours: int = 24) -> DataFrame:
    """Payment references that more than one store used within some hours; in a stream the stores are counted approximately."""
    stores = F.approx_count_distinct("store_id") if sales.isStreaming else F.count_distinct("store_id")
    own = sales.withWatermark("ts", f"{hours} hours") if sales.isStreaming else sales
    return own.groupBy("payment_ref", F.window("ts", f"{hours} hours", "1 hour").alias("w")).agg(stores.alias("stores")).where("stores > 1").select("payment_ref", F.col("w.start").alias("window_start"), "stores")


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what has arrived into a table in memory, then stop."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
