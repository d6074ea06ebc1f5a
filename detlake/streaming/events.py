"""Structured Streaming over job events and queue messages."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from detlake.functions.text import message_issue
from detlake.operators.jobs import MAX_ATTEMPTS, state_after
from detlake.session import scratch_path


def read_stream(spark: SparkSession, path: str, schema, form: str = "parquet", glob: str | None = None,
                max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(form)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


#: State store that value states and timers of ``transformWithStateInPandas`` need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession, provider: str | None) -> Iterator[None]:
    """Streams that are started meanwhile keep their state with ``provider``."""
    before = spark.conf.get(_PROVIDER)
    if provider:
        spark.conf.set(_PROVIDER, provider)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def run_to_table(stream: DataFrame, label: str, mode: str = "append", provider: str | None = ROCKS) -> DataFrame:
    """Process everything available now and return what was written.

    State is kept by ``provider``, outside the heap by default. Update mode has no file sink; its batches are written one by one with their number.
    """
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    writer = stream.writeStream.option("checkpointLocation", f"{path}/_checkpoint").trigger(
        availableNow=True
    )
    with state_store(spark, provider):
        if mode == "append":
            query = writer.outputMode("append").format("parquet").start(f"{path}/data")
        else:
            def save(batch: DataFrame, number: int) -> None:
                batch.write.mode("overwrite").parquet(f"{path}/data/batch={number}")

            query = writer.outputMode(mode).foreachBatch(save).start()
        query.awaitTermination()
    fields = list(stream.schema.fields)
    if mode != "append":
        fields.append(StructField("batch", LongType()))
    return spark.read.schema(StructType(fields)).parquet(f"{path}/data")


def without_repeats(stream: DataFrame, delay: str = "1 hour", key: str = "event_id",
                    ts: str = "ts") -> DataFrame:
    """Drop redelivered events; state is kept only as long as the watermark needs it."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


#: Event time for which a finished job is remembered, to judge late events; then its state ends.
FINISHED_MS = 24 * 3600 * 1000
_JOB_STATE = "state string, since timestamp, events long, attempts long"
#: States in which a job has come to rest.
FINISHED = ("COMPLETED", "FAILED")


class _JobStates(StatefulProcessor):
    """State, last event, events and attempts of one job; kept until a while after it has finished."""

    def __init__(self, keep_ms: int, event_id: str):
        self.keep_ms, self.event_id = keep_ms, event_id

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState(
            "job", f"state string, micros long, event_id {self.event_id}, events long, attempts long"
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, micros, last, events, attempts = self.job.get() if self.job.exists() else (None, -1, None, 0, 0)
        for frame in rows:
            events += len(frame)
            attempts += int(frame["is_attempt"].sum())
            newest = frame.sort_values(["micros", "event_id"]).iloc[-1]
            if last is None or (newest["micros"], newest["event_id"]) > (micros, last):
                state, micros, last = newest["state"], int(newest["micros"]), newest["event_id"]
        last = last.item() if hasattr(last, "item") else last
        self.job.update((state, micros, last, events, attempts))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state in FINISHED:
            now = max(micros // 1000, timerValues.getCurrentWatermarkInMs())
            self.handle.registerTimer(now + self.keep_ms)
        yield pd.DataFrame(
            {"inspection_id": [key[0]], "state": [state], "since": [pd.Timestamp(micros, unit="us")],
             "events": [events], "attempts": [attempts]}
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.job.clear()
        return iter([])

    def close(self) -> None:
        pass


def job_state_stream(events: DataFrame, delay: str = "1 hour", keep_ms: int = FINISHED_MS) -> DataFrame:
    """Current state of every job touched, for update mode; needs the state store ``ROCKS``.

    Events later than ``delay`` are dropped. The state of a finished job ends ``keep_ms`` of event
    time after its last event; a job that is redriven later is counted anew.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    # A microsecond more, so that an event at the very first watermark, the epoch, isn't late.
    marked = events.withColumn("mark", F.col("ts") + F.expr("INTERVAL 1 MICROSECOND")).withWatermark("mark", delay)
    rows = marked.select(
        "inspection_id", "mark", "event_id", F.unix_micros("ts").alias("micros"), state_after().alias("state"),
        (F.col("event_type") == "inspection_processing").alias("is_attempt"),
    )
    return rows.groupBy("inspection_id").transformWithStateInPandas(
        _JobStates(keep_ms, kinds["event_id"]), f"inspection_id {kinds['inspection_id']}, {_JOB_STATE}", "Update", "EventTime"
    )


def latest_states(updates: DataFrame) -> DataFrame:
    """The last written row per job from the batches of an update stream."""
    rest = [c for c in updates.columns if c not in ("inspection_id", "batch")]
    return (
        updates.groupBy("inspection_id")
        .agg(F.max_by(F.struct(*rest), "batch").alias("r"))
        .select("inspection_id", "r.*")
    )


def windowed_metrics(events: DataFrame, size: str = "1 hour", slide: str | None = None,
                     delay: str = "1 hour", value: str = "value") -> DataFrame:
    """Events, largest value and first time per window and type; late rows beyond the delay drop."""
    frame = F.window("ts", size, slide) if slide else F.window("ts", size)
    return (
        events.withWatermark("ts", delay)
        .groupBy(frame.alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.max(value).alias("max_value"), F.min("ts").alias("first_ts"))
        .select(
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
            "event_type", "n", "max_value", "first_ts",
        )
    )


def queue_ages(outbox: DataFrame, publications: DataFrame, horizon: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """When each outbox row was published: event_id, inspection_id, created_at, published_at.

    Two streams with ``event_id`` and ``ts`` (``outbox`` with ``inspection_id``) are joined within
    ``horizon``; what has not been published by then comes out with a null once the watermark has
    passed it, and state of both sides ends there. A publication that is recorded again within
    the delay counts once.
    """
    rows = outbox.select("event_id", "inspection_id", F.col("ts").alias("created_at")).withWatermark("created_at", delay)
    sent = (
        publications.select(F.col("event_id").alias("sent_id"), F.col("ts").alias("published_at"))
        .withWatermark("published_at", delay)
        .dropDuplicatesWithinWatermark(["sent_id"])
    )
    within = (
        (F.col("event_id") == F.col("sent_id"))
        & (F.col("published_at") >= F.col("created_at"))
        & (F.col("published_at") <= F.col("created_at") + F.expr(f"INTERVAL {horizon}"))
    )
    return rows.join(sent, within, "left_outer").drop("sent_id")


def queue_metrics(ages: DataFrame, size: str = "1 hour") -> DataFrame:
    """Per window of creation: rows, unpublished ones, the oldest of them, queue age in seconds."""
    age = F.unix_micros("published_at") - F.unix_micros("created_at")
    waits = F.col("published_at").isNull()
    return (
        ages.groupBy(F.window("created_at", size).alias("w"))
        .agg(
            F.count("*").alias("n"),
            F.count_if(waits).alias("unpublished"),
            F.min(F.when(waits, F.col("created_at"))).alias("oldest_unpublished"),
            (F.max(age) / 1e6).alias("max_age"),
            (F.avg(age) / 1e6).alias("mean_age"),
        )
        .select(F.col("w.start").alias("window_start"), "n", "unpublished", "oldest_unpublished", "max_age", "mean_age")
    )


def retries_per_window(events: DataFrame, size: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Per window: scheduled retries, the jobs that had any, and the most of one job.

    Jobs are counted first, so a window with one very busy job is no crowded group.
    """
    retries = events.filter(F.col("event_type") == "inspection_retry_scheduled").withWatermark("ts", delay)
    by_job = retries.groupBy(F.window("ts", size).alias("w"), "inspection_id").agg(F.count("*").alias("n"))
    return (
        by_job.groupBy(F.window(F.window_time("w"), size).alias("v"))
        .agg(F.sum("n").alias("retries"), F.count("*").alias("jobs"), F.max("n").alias("most"))
        .select(F.col("v.start").alias("window_start"), "retries", "jobs", "most")
    )


LEASE_STATE = "token string, lease_until double, attempts int, status string"
LEASE_OUTPUT = "inspection_id string, event_id string, at double, outcome string"
NEW_LEASE = (None, 0.0, 0, "queued")


def follow_lease(lease: tuple, kind: str, token: str | None, at: float, lease_until: float) -> tuple:
    """(lease, verdict) after one command.

    A job is claimed while it is queued or its lease has ended; after too many attempts a
    claim fails it. Renewals, results and failures count only under the current lease.
    Only a failed job can be redriven.
    """
    held, until, attempts, status = lease
    live = status == "processing" and until > at
    mine = live and held == token
    if kind == "claim":
        if live or status in ("completed", "failed"):
            return lease, "claim_refused"
        if attempts >= MAX_ATTEMPTS:
            return (None, 0.0, attempts, "failed"), "retry_limit_exceeded"
        return (token, float(lease_until), attempts + 1, "processing"), "claimed"
    if kind == "redrive":
        return (NEW_LEASE, "redriven") if status == "failed" else (lease, "stale")
    if not mine:
        return lease, "stale"
    if kind == "renew":
        return (held, float(lease_until), attempts, status), "renewed"
    if kind == "fail":
        last = attempts >= MAX_ATTEMPTS
        return (None, 0.0, attempts, "failed" if last else "queued"), "failed" if last else "retry_scheduled"
    return (None, 0.0, attempts, "completed"), "accepted"


def _verdicts(job: str, lease: tuple, rows: pd.DataFrame) -> tuple[tuple, list[tuple]]:
    out = []
    for row in rows[["event_id", "kind", "token", "at", "lease_until"]].itertuples(index=False):
        lease, verdict = follow_lease(lease, row.kind, row.token, row.at, row.lease_until)
        out.append((job, row.event_id, row.at, verdict))
    return lease, out


_VERDICT_COLUMNS = ["inspection_id", "event_id", "at", "outcome"]


def _fence(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Follow one job's lease; yields a verdict for each command and for leases that ran out."""
    lease = state.get if state.exists else NEW_LEASE
    if state.hasTimedOut:
        token, until, attempts, status = lease
        if status in ("completed", "failed"):
            state.remove()
            return
        last = attempts >= MAX_ATTEMPTS
        lease = (None, 0.0, attempts, "failed" if last else "queued")
        rows = [(key[0], token, until, "retry_limit_exceeded" if last else "lease_expired")]
    else:
        # One trigger's commands of one job.
        lease, rows = _verdicts(key[0], lease, pd.concat(list(batches)).sort_values(["at", "event_id"], kind="stable"))
    state.update(lease)
    if lease[3] == "processing":
        # A lease that ended before the watermark is noticed at the next chance.
        state.setTimeoutTimestamp(max(int(lease[1] * 1000), state.getCurrentWatermarkMs() + 1))
    else:
        state.setTimeoutTimestamp(max(int(rows[-1][2] * 1000), state.getCurrentWatermarkMs()) + FINISHED_MS)
    yield pd.DataFrame(rows, columns=_VERDICT_COLUMNS)


def fenced_results(commands: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Accept a result only under the lease token that is current when it arrives.

    ``commands``: ts, inspection_id, event_id, kind (claim, renew, fail, result, redrive),
    token, at, lease_until (epoch seconds). Expired leases and used-up attempts come from
    timers; a job's state ends a day of event time after it has finished or come to rest.
    """
    return (
        commands.withWatermark("ts", delay)
        .groupBy("inspection_id")
        .applyInPandasWithState(
            _fence, LEASE_OUTPUT, LEASE_STATE, "append", GroupStateTimeout.EventTimeTimeout
        )
    )


def fenced_results_batch(commands: DataFrame) -> DataFrame:
    """The verdicts of ``fenced_results`` on a finished log, by the same rules.

    Commands are dealt by job and read in order, one lease at a time, so a job with very
    many commands is never gathered.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        job, lease = None, NEW_LEASE
        for frame in frames:
            out = []
            for name, rows in frame.groupby("inspection_id", sort=False):
                if name != job:
                    job, lease = name, NEW_LEASE
                lease, some = _verdicts(job, lease, rows)
                out += some
            yield pd.DataFrame(out, columns=_VERDICT_COLUMNS)

    columns = ["inspection_id", "event_id", "kind", "token", "at", "lease_until"]
    return (
        commands.select(*columns)
        .repartition("inspection_id")
        .sortWithinPartitions("inspection_id", "at", "event_id")
        .mapInPandas(run, LEASE_OUTPUT)
    )


def checked_messages(messages: DataFrame, body: str = "body") -> DataFrame:
    """Queue messages with their identities, or the issue that sends them to dead letters."""
    fields = F.from_json(body, "event_id string, inspection_id string")
    issue = message_issue(body)
    return messages.withColumn("issue", issue).withColumns(
        {
            "event_id": F.when(F.col("issue").isNull(), fields["event_id"]),
            "inspection_id": F.when(F.col("issue").isNull(), fields["inspection_id"]),
        }
    )


def known_messages(messages: DataFrame, outbox: DataFrame, jobs: DataFrame) -> DataFrame:
    """Stream-static form of the message lookup: outbox row, job and what to do next."""
    rows = outbox.select(F.col("id").alias("event_id"), F.col("inspection_id").alias("_job"))
    states = jobs.select(F.col("id").alias("inspection_id"), "status")
    joined = messages.join(rows, "event_id", "left").join(states, "inspection_id", "left")
    known = F.col("_job").eqNullSafe(F.col("inspection_id")) & F.col("status").isNotNull()
    action = (
        F.when(~known, "unknown")
        .when(F.col("status") == "COMPLETED", "acknowledge")
        .when(F.col("status") == "FAILED", "retain")
        .otherwise("process")
    )
    return joined.withColumn("action", action).drop("_job")


