"""Windowed aggregation that is the same plan over a table and over a stream, with watermarks, event deduplication and upserting sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import upsert


def windowed(df: DataFrame, ts: str, size: str, by: list[str], aggs: dict[str, Column], slide: str | None = None, lateness: str | None = None) -> DataFrame:
    """window_start, window_end, the keys and the aggregates for tumbling windows, or sliding ones with ``slide``. ``lateness`` sets the watermark of a stream."""
    df = df.withWatermark(ts, lateness) if lateness and df.isStreaming else df
    win = F.window(ts, size, slide) if slide else F.window(ts, size)
    return _flat(df.groupBy(win.alias("w"), *by).agg(*(a.alias(n) for n, a in aggs.items())), by, aggs)


def session_windows(df: DataFrame, ts: str, gap: str, by: list[str], aggs: dict[str, Column], lateness: str | None = None) -> DataFrame:
    """True sessions: a window ends ``gap`` after its last event."""
    df = df.withWatermark(ts, lateness) if lateness and df.isStreaming else df
    return _flat(df.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(*(a.alias(n) for n, a in aggs.items())), by, aggs)


def _flat(df, by, aggs):
    return df.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, *aggs)


def first_events(df: DataFrame, key: list[str], ts: str, lateness: str) -> DataFrame:
    """Each event once. On a stream the keys are kept for as long as events may be late."""
    return df.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(key) if df.isStreaming else df.dropDuplicates(key)


def alerts(results: DataFrame, value: str, op: str, threshold: float, identity: list[str], name: str) -> DataFrame:
    """The results that a comparison holds for, with the rule's name and a stable identity."""
    c, t = F.col(value), F.lit(float(threshold))
    hit = {"gt": c > t, "gte": c >= t, "lt": c < t, "lte": c <= t, "eq": c == t, "ne": c != t}[op]
    return results.where(hit).withColumns({"rule": F.lit(name), "identity": F.concat_ws(":", F.lit(name), *(F.coalesce(F.col(i).cast("string"), F.lit("null")) for i in identity))})


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Reads what there is, in bounded batches, appends it as Parquet and ends; started again it goes on where it was."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upsert_available(stream: DataFrame, spark: SparkSession, path: str, checkpoint: str, keys: list[str], order: list[str]) -> None:
    """Keeps one row for each key under ``path``: every batch is merged into the last version and written as the next one.

    A version is named by its batch, so a batch that is repeated after a failure writes the same version again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        new = batch
        if number:
            old = spark.read.schema(batch.schema).parquet(f"{path}/v{number - 1}")
            new = upsert(old, batch, keys, order=[F.col(o) for o in order])
        else:
            new = upsert(batch.limit(0), batch, keys, order=[F.col(o) for o in order])
        new.write.mode("overwrite").parquet(f"{path}/v{number}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
