"""Queue lifecycle: claiming, completing, failing, retrying and routing jobs. Each returns the whole changed table or its part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import query

# Queues by the handler of their jobs.
HANDLERS = {"queue.directory.parse": "fetch", "queue.website.resolve": "resolve", "queue.evidence.store": "store"}


def due(now: Column) -> Column:
    """Pending jobs without a time or whose time has come."""
    return (F.col("status") == "pending") & (F.col("scheduled_at").isNull() | (F.col("scheduled_at") <= now))


def claimed(jobs: DataFrame, worker: str, now: Column) -> DataFrame:
    """The next due job of each queue, marked as this worker's: highest priority, then oldest, then id.

    The choice is a top-1 per queue (partial before the shuffle), joined back by id.
    """
    order = [F.desc("priority"), F.asc("created_at"), F.asc("id")]
    chosen = query.top_per_group(jobs.filter(due(now)).select("queue_name", "priority", "created_at", "id"), ["queue_name"], order, 1)
    mine = chosen.select("id", F.lit(True).alias("_mine"))
    hit = F.col("_mine").isNotNull()
    out = jobs.join(mine, "id", "left")
    return out.withColumns(
        {
            "status": F.when(hit, "processing").otherwise(F.col("status")),
            "worker_id": F.when(hit, worker).otherwise(F.col("worker_id")),
            "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
        }
    ).select(*jobs.columns)


def completed(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs that were done: status and both times."""
    return jobs.withColumns({"status": F.lit("completed"), "completed_at": now, "updated_at": now})


def failed(jobs: DataFrame, message: Column, now: Column) -> DataFrame:
    """Jobs that failed once more: pending again after a doubled delay, or dead letters at their last attempt."""
    attempts = F.coalesce("attempts", F.lit(0)) + 1
    dead = attempts >= F.coalesce("max_attempts", F.lit(5))
    delay = F.timestamp_micros(F.unix_micros(now) + F.pow(F.lit(2.0), attempts - 1).cast("long") * 1_000_000)
    return jobs.withColumns(
        {
            "status": F.when(dead, "dead_letter").otherwise("pending"),
            "scheduled_at": F.when(dead, now).otherwise(delay),
            "attempts": attempts,
            "error_message": message,
            "updated_at": now,
        }
    )


def retried(jobs: DataFrame, now: Column, status: str = "failed", most: int = 1_000) -> DataFrame:
    """The newest ``most`` jobs of a status in each queue (a batch is the feature), reset to a first attempt."""
    chosen = query.top_per_group(jobs.filter(F.col("status") == status), ["queue_name"], [F.desc("created_at"), F.asc("id")], most)
    none = F.lit(None).cast("string")
    return chosen.withColumns({"status": F.lit("pending"), "attempts": F.lit(0), "error_message": none, "scheduled_at": now, "updated_at": now})


def routed(jobs: DataFrame) -> DataFrame:
    """``handler`` of each job and the ``error`` of those that no handler takes or that lack what theirs needs."""
    known = F.create_map(*(F.lit(x) for pair in HANDLERS.items() for x in pair))[F.col("queue_name")]
    missing = F.when(known.isin("fetch", "resolve") & text.blank(F.col("url")), F.lit("Job has no url"))
    error = F.when(known.isNull(), F.concat(F.lit('No processor configured for queue "'), F.col("queue_name"), F.lit('"'))).otherwise(missing)
    return jobs.withColumn("handler", known).withColumn("error", error)
