"""Structured Streaming: running metrics, windowed counts, live query results, request slots and a cache with expiry.

Every stream can run to the end of what is available (``availableNow``), which is how batch callers and tests use it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..session import materialise, shared_folder


def source(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int = 100) -> DataFrame:
    """Stream over the parquet files at a path, with the schema of a batch frame."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_to_end(stream: DataFrame, mode: str, each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Run a stream over all available input and return its result as a batch frame.

    ``complete``: the last complete result; ``append``/``update``: the union of the batches' rows. Results and checkpoint
    lie in the shared folder; a batch that is repeated after a failure overwrites its own output.
    """
    spark = stream.sparkSession
    place = f"{shared_folder(spark)}/tallyard-stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        name = "result" if mode == "complete" else f"batch={number}"
        batch.write.mode("overwrite").parquet(f"{place}/out/{name}")
        if each:
            each(batch, number)

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True)
    query = writer.foreachBatch(write).start()
    query.awaitTermination()
    path = f"{place}/out/result" if mode == "complete" else f"{place}/out"
    found = spark.read.schema(stream.schema).parquet(path)
    return found.select(*stream.columns)


def counters(points: DataFrame, key: list[str], value: str) -> DataFrame:
    """Running totals by key; Spark keeps one partial aggregate a key."""
    return points.groupBy(*key).agg(F.round(F.sum(value), 4).alias("total"), F.count(F.lit(1)).alias("n"))


def windowed(points: DataFrame, ts: str, key: list[str], size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window; rows later than the watermark are dropped, closed windows leave the state."""
    w = F.window(ts, size)
    out = points.withWatermark(ts, late).groupBy(w, *key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("window_start"), *key, "n")


def requery(changes: DataFrame, query: Callable[[], DataFrame], publish: Callable[[DataFrame, int], None]):
    """Run a query again whenever something changed, and publish its whole result."""
    return changes.writeStream.foreachBatch(lambda batch, n: None if batch.isEmpty() else publish(query(), n))


def granted_slots(requests: DataFrame, key: str, at: str, order: str, gap_ms: int, span: Column) -> DataFrame:
    """When each request of a key may start if starts are ``gap_ms`` apart: ``granted_at`` and ``waited_ms``.

    With requests numbered i, the start is i * gap plus the running maximum of (time - k * gap) over k <= i. Numbers and
    maxima are first taken by span of time, so a key with very many requests is spread over its spans.
    """
    micros = F.unix_micros(at)
    rows = requests.withColumn("_t", micros).withColumn("_s", span)
    inside = W.Window.partitionBy(key, "_s").orderBy("_t", order)
    rows = materialise(rows.withColumn("_i", F.row_number().over(inside)))
    sizes = rows.groupBy(key, "_s").agg(F.count(F.lit(1)).alias("_n"))
    before = W.Window.partitionBy(key).orderBy("_s").rowsBetween(W.Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    rows = rows.join(sizes.drop("_n"), [key, "_s"]).withColumn("_i", F.col("_i") + F.col("_from"))
    rows = rows.withColumn("_slack", F.col("_t") - F.col("_i") * (gap_ms * 1000))
    most = rows.groupBy(key, "_s").agg(F.max("_slack").alias("_m")).withColumn("_before", F.max("_m").over(before)).drop("_m")
    running = F.max("_slack").over(inside.rowsBetween(W.Window.unboundedPreceding, 0))
    rows = rows.join(most, [key, "_s"]).withColumn("_max", F.greatest(running, F.coalesce("_before", F.lit(-(1 << 62)))))
    granted = F.col("_max") + F.col("_i") * (gap_ms * 1000)
    out = rows.withColumn("granted_at", F.timestamp_micros(granted)).withColumn("waited_ms", ((granted - F.col("_t")) / 1000).cast("long"))
    return out.drop("_t", "_s", "_i", "_from", "_slack", "_before", "_max")


def slots_stream(requests: DataFrame, key: str, ident: str, at: str, gap_ms: int) -> DataFrame:
    """The same over a stream: the state of a key is the last start granted."""

    def grant(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for frame in frames:
            out = []
            for i, t in sorted(zip(frame[ident], frame[at]), key=lambda x: (x[1], x[0])):
                start = t if last is None else max(t, pd.Timestamp(last, unit="us") + pd.Timedelta(milliseconds=gap_ms))
                last = int(start.value // 1000)
                out.append((k[0], i, start))
            yield pd.DataFrame(out, columns=[key, ident, "granted_at"])
        if last is not None:
            state.update((last,))

    kinds = dict(requests.dtypes)
    schema = f"{key} {kinds[key]}, {ident} {kinds[ident]}, granted_at timestamp"
    return requests.groupBy(key).applyInPandasWithState(grant, schema, "last long", "append", "NoTimeout")


def cached_reads(reads: DataFrame, key: str, ident: str, at: str, ttl_ms: int) -> DataFrame:
    """Which reads of a stream fetch anew: an entry lives ``ttl_ms`` from its fetch, whatever reads it meanwhile."""

    def serve(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        fetched = state.get[0] if state.exists else None
        for frame in frames:
            out = []
            for i, t in sorted(zip(frame[ident], frame[at]), key=lambda x: (x[1], x[0])):
                now = int(t.value // 1000)
                miss = fetched is None or now - fetched >= ttl_ms * 1000
                fetched = now if miss else fetched
                out.append((k[0], i, miss))
            yield pd.DataFrame(out, columns=[key, ident, "is_fetch"])
        if fetched is not None:
            state.update((fetched,))

    kinds = dict(reads.dtypes)
    schema = f"{key} {kinds[key]}, {ident} {kinds[ident]}, is_fetch boolean"
    return reads.groupBy(key).applyInPandasWithState(serve, schema, "fetched long", "append", "NoTimeout")
