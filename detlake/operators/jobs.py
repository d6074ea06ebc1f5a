"""Reports over the job, outbox and object tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed limits of the job queue.
MAX_ATTEMPTS = 3
LEASE_SECONDS = 120
RETRY_SECONDS = 2


def claimable(now, backend: str | None = None) -> Column:
    """A queued job that is due, or one whose lease has run out."""
    now = now if isinstance(now, Column) else F.lit(float(now))
    due = (F.col("status") == "QUEUED") & (F.col("available_at") <= now)
    expired = (F.col("status") == "PROCESSING") & (F.col("lease_until") <= now)
    ready = F.coalesce(due | expired, F.lit(False))
    return ready if backend is None else ready & (F.col("queue_backend") == backend)


def outbox_pending(now) -> Column:
    now = now if isinstance(now, Column) else F.lit(float(now))
    free = F.col("lease_until").isNull() | (F.col("lease_until") <= now)
    return F.col("published_at").isNull() & (F.col("available_at") <= now) & free


def retry_at(now, attempts="attempts", delay: float = RETRY_SECONDS) -> Column:
    now = now if isinstance(now, Column) else F.lit(float(now))
    return now + F.lit(float(delay)) * F.pow(F.lit(2.0), F.col(attempts) - 1)


def outbox_retry_at(now, attempts="attempts") -> Column:
    now = now if isinstance(now, Column) else F.lit(float(now))
    wait = F.pow(F.lit(2.0), F.least(F.col(attempts), F.lit(8)).cast("double"))
    return now + F.least(F.lit(300.0), wait)


def backlog(jobs: DataFrame, now, limit: int = 1, backend: str | None = None) -> DataFrame:
    """The oldest claimable jobs."""
    return jobs.filter(claimable(now, backend)).orderBy("created_at", "id").limit(limit)


def exhausted(jobs: DataFrame, now, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Jobs that would be claimed again but have used up their attempts."""
    return jobs.filter(claimable(now) & (F.col("attempts") >= max_attempts)).withColumn(
        "error_code", F.lit("RETRY_LIMIT_EXCEEDED")
    )


def history(jobs: DataFrame, owner: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """One page of an owner's jobs, newest first."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must lie in 1..100 and offset must not be negative")
    return (
        jobs.filter(F.col("owner_id") == owner)
        .orderBy(F.desc("created_at"), F.desc("id"))
        .offset(offset)
        .limit(limit)
    )


def find(jobs: DataFrame, job_id: str, owner: str) -> DataFrame:
    return jobs.filter((F.col("id") == job_id) & (F.col("owner_id") == owner))


def message_jobs(messages: DataFrame, outbox: DataFrame, jobs: DataFrame) -> DataFrame:
    """Queue messages with the job they stand for; unknown ones fall away."""
    known = outbox.select(F.col("id").alias("event_id"), "inspection_id")
    return messages.join(known, ["event_id", "inspection_id"]).join(
        jobs.filter("queue_backend = 'sqs'").withColumnRenamed("id", "inspection_id"),
        "inspection_id",
    )


def orphans(objects: DataFrame, jobs: DataFrame, now, min_age: float = 86400.0) -> DataFrame:
    """Stored objects no job refers to, older than the grace period."""
    if not min_age > 0:
        raise ValueError("orphan audit needs a positive grace period")
    now = now if isinstance(now, Column) else F.lit(float(now))
    return objects.filter(F.col("modified_at") <= now - min_age).join(
        jobs.select("image_key"), "image_key", "left_anti"
    )


def reconcile(outbox: DataFrame, messages: DataFrame, jobs: DataFrame) -> DataFrame:
    """Outbox rows, delivered messages and jobs side by side, with what does not fit.

    ``messages``: event_id, inspection_id (repeats are normal: delivery is at least once).
    """
    sent = messages.groupBy("event_id").agg(F.count("*").alias("deliveries"))
    rows = outbox.select(
        F.col("id").alias("event_id"), "inspection_id", "published_at", F.lit(True).alias("_outbox")
    )
    states = jobs.select(F.col("id").alias("inspection_id"), "status")
    state = (
        F.when(F.col("_outbox").isNull(), "unknown_message")
        .when(F.col("status").isNull(), "outbox_without_job")
        .when(F.col("published_at").isNull() & F.col("deliveries").isNull(), "unpublished")
        .when(F.col("published_at").isNull(), "publish_not_recorded")
        .when(F.col("deliveries").isNull(), "published_not_delivered")
        .when(F.col("status") == "FAILED", "failed_needs_redrive")
        .when(F.col("status") == "COMPLETED", "settled")
        .otherwise("in_flight")
    )
    return (
        rows.join(sent, "event_id", "full_outer")
        .join(states, "inspection_id", "left")
        .select("event_id", "inspection_id", "status",
                F.coalesce("deliveries", F.lit(0)).alias("deliveries"), state.alias("state"))
    )


# The state each event leaves its job in.
STATE_AFTER = {
    "inspection_queued": "QUEUED",
    "inspection_processing": "PROCESSING",
    "inspection_completed": "COMPLETED",
    "inspection_failed": "FAILED",
    "inspection_retry_scheduled": "QUEUED",
    "inspection_redrive_requested": "QUEUED",
}


def state_after(event_type="event_type") -> Column:
    kinds = F.create_map(*[F.lit(v) for pair in STATE_AFTER.items() for v in pair])
    return F.try_element_at(kinds, F.col(event_type))


def job_states(events: DataFrame) -> DataFrame:
    """Current state of every job from its events: batch form of the state stream."""
    return (
        events.withColumn("state", state_after())
        .groupBy("inspection_id")
        .agg(
            F.max_by("state", F.struct("created_at", "id")).alias("state"),
            F.max("created_at").alias("since"),
            F.count("*").alias("events"),
            F.count_if(F.col("event_type") == "inspection_processing").alias("attempts"),
        )
    )
