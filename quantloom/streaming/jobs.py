"""Event streams: exactly-once inbox, dead letters, windows, and jobs with leases and retries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def file_stream(spark, schema, path: str, files_per_trigger: int = 20) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def inbox(events: DataFrame, delay: str = "1 day", key: str = "event_id", at: str = "ts") -> DataFrame:
    """Each event id once, within the watermark."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def inbox_batch(events: DataFrame, key: str = "event_id", order: str = "ts") -> DataFrame:
    from ..operators.store import latest

    return latest(events.withColumn("_o", -F.unix_micros(F.col(order).cast("timestamp"))), [key], ["_o"]).drop("_o")


def validated(events: DataFrame, schema: str, types: list[str]) -> tuple[DataFrame, DataFrame]:
    """Events whose payload parses and whose type is known, and the dead letters."""
    rows = events.withColumn("body", F.from_json("payload", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    good = F.coalesce(F.col("body").isNotNull() & F.col("body._bad").isNull() & F.col("type").isin(types), F.lit(False))
    return rows.filter(good).withColumn("body", F.col("body").dropFields("_bad")), rows.filter(~good).drop("body")


def windowed(events: DataFrame, size: str, slide: str | None = None, delay: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Counts and sums per window and type; late events within the delay count."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", delay).groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", by, "n", "total")


def sessions(events: DataFrame, gap: str, delay: str = "10 minutes", by: str = "user_id") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("n")).select("w.start", "w.end", by, "n")


JOB_STATE = "status string, attempts int, lease_until long, not_before long, created long"
JOB_OUT = "job_id long, status string, attempts int, not_before long"
LEASE_S, DEADLINE_S, ATTEMPTS, BACKOFF_S, RETAIN_S = 600, 3600, 3, 60, 86400
DONE = ("SUCCEEDED", "FAILED")


def next_state(state: tuple, event: str, at: int) -> tuple:
    """(status, attempts, lease_until, not_before, created) after an event at a second: claim, fail, done or tick.
    A claim needs a queued job whose wait is over, or a lease that has run out; each failure waits twice as
    long as the one before; the third ends the job. A job that is not done an hour after it was made fails
    with the first event from then on."""
    status, attempts, lease, wait, created = state
    if status in DONE:
        return state
    if at >= created + DEADLINE_S:
        return "FAILED", attempts, lease, wait, created
    if status == "RUNNING" and at >= lease and event in ("claim", "tick"):
        status, wait = ("FAILED", wait) if attempts >= ATTEMPTS else ("QUEUED", at)
    if event == "claim" and status == "QUEUED" and at >= wait:
        return "RUNNING", attempts + 1, at + LEASE_S, wait, created
    if event == "done" and status == "RUNNING" and at < lease:
        return "SUCCEEDED", attempts, lease, wait, created
    if event == "fail" and status == "RUNNING":
        return ("FAILED", attempts, lease, wait, created) if attempts >= ATTEMPTS else ("QUEUED", attempts, 0, at + BACKOFF_S * 2 ** (attempts - 1), created)
    return status, attempts, lease, wait, created


def _folded(state: tuple | None, rows: pd.DataFrame) -> tuple:
    rows = rows.sort_values(["ts", "event"])
    for event, at in zip(rows["event"], rows["ts"], strict=True):
        second = int(at.timestamp())
        state = next_state(state or ("QUEUED", 0, 0, 0, second), event, second)
    return state


def _out(job: int, state: tuple) -> pd.DataFrame:
    return pd.DataFrame({"job_id": [job], "status": [state[0]], "attempts": [state[1]], "not_before": [state[3]]})


def job_states(events: DataFrame) -> DataFrame:
    """Stream of (job_id, event, ts) to the state of each job after each batch. The deadline is an hour after
    the job's first event; a job that is not done when the watermark passes it fails. A finished job's state
    stays for a day more, so that later events do not begin it anew."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else None
        if state.hasTimedOut:
            if now[0] in DONE:
                state.remove()
                return
            now = ("FAILED", *now[1:])
        else:
            now = _folded(now, pd.concat(list(batches)))
        state.update(now)
        until = now[4] + DEADLINE_S + (RETAIN_S if now[0] in DONE else 0)
        state.setTimeoutTimestamp(max(until * 1000, state.getCurrentWatermarkMs() + 1))
        yield _out(key[0], now)

    return events.withWatermark("ts", "10 minutes").groupBy("job_id").applyInPandasWithState(run, JOB_OUT, JOB_STATE, "update", GroupStateTimeout.EventTimeTimeout)


def job_states_batch(events: DataFrame, until: int | None = None) -> DataFrame:
    """The same over a finished log, one fold per job; until: the second up to which deadlines have run out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        now = _folded(None, pdf)
        if until is not None and now[0] not in DONE and now[4] + DEADLINE_S <= until:
            now = ("FAILED", *now[1:])
        return _out(int(pdf["job_id"].iloc[0]), now)

    return events.groupBy("job_id").applyInPandas(run, JOB_OUT)


def claimed(jobs: DataFrame, now: str, most_attempts: int = 3, lease_s: int = 600) -> DataFrame:
    """One sweep over queues of jobs (queue, job_id, status, attempts, next_attempt_at, lease_until, created_at):
    jobs whose wait or lease is over and that have no attempt left fail; of the others in each queue the oldest
    is claimed, with a fence token that every claim of a job raises. (queue, job_id, status, attempts, fence,
    lease_until)"""
    at = F.lit(now).cast("timestamp")
    free = ((F.col("status") == "QUEUED") & (F.col("next_attempt_at") <= at)) | ((F.col("status") == "RUNNING") & (F.col("lease_until") <= at))
    rows = jobs.filter(free).withColumn("spent", F.col("attempts") >= most_attempts)
    first = F.row_number().over(Window.partitionBy("queue", "spent").orderBy("created_at", "job_id"))
    rows = rows.withColumn("_n", first).filter("spent or _n = 1")
    lease = F.when(~F.col("spent"), at + F.make_dt_interval(secs=F.lit(lease_s)))
    tries = F.col("attempts") + F.when(F.col("spent"), 0).otherwise(1)
    return rows.select("queue", "job_id", F.when(F.col("spent"), "FAILED").otherwise("RUNNING").alias("status"), tries.alias("attempts"), F.when(~F.col("spent"), tries).alias("fence"), lease.alias("lease_until"))


def backoff_seconds(attempts, first: int = 30, most: int = 3600):
    """Wait after the n-th failure: doubled each time, up to an hour."""
    return F.least(F.lit(most), F.lit(first) * F.pow(F.lit(2), F.col(attempts) - 1)).cast("bigint")


def expired(status: str, deadline: str, now: str):
    """A queued job whose deadline is over has failed."""
    return F.when((F.col(status) == "QUEUED") & (F.col(deadline) <= F.lit(now).cast("timestamp")), "FAILED").otherwise(F.col(status))


def schedule_tick(schedules: DataFrame, jobs: DataFrame, now: str, cap: int = 20, most_days: int = 3650) -> DataFrame:
    """Schedules (schedule_id, enabled, next_run_at, interval_minutes, first_day) that are due and have no live job
    (schedule_id, status, deadline): those whose history window has grown too long are switched off, the others
    get a job and their next run an interval from now, whatever ticks were missed. At most `cap`, oldest first."""
    at = F.lit(now).cast("timestamp")
    live = jobs.filter(F.col("status").isin("QUEUED", "RUNNING") & (F.col("deadline") > at)).select("schedule_id").distinct()
    due = schedules.filter(F.col("enabled") & (F.col("next_run_at") <= at)).join(live, "schedule_id", "left_anti").orderBy("next_run_at", "schedule_id").limit(cap)
    old = F.date_diff(at.cast("date"), F.col("first_day")) > most_days
    key = F.concat_ws(":", F.lit("tick"), F.date_format("next_run_at", "yyyy-MM-dd HH:mm:ss"))
    return due.select("schedule_id", F.when(old, "EXPIRED").otherwise("QUEUED").alias("action"), F.when(~old, key).alias("tick_key"), F.when(~old, at + F.make_dt_interval(mins=F.col("interval_minutes"))).alias("next_run_at"))


def correlated(results: DataFrame, jobs: DataFrame, now: str) -> DataFrame:
    """What each result (event_id, job_id, input_hash, version) does to its job (job_id, status, input_hash,
    version, deadline): only the first delivery counts, an unknown job or another input is refused, a finished
    job stays, a late or outdated result fails the job."""
    again = F.row_number().over(Window.partitionBy("event_id").orderBy("arrival")) > 1
    j = jobs.select("job_id", "status", F.col("input_hash").alias("wanted_hash"), F.col("version").alias("wanted_version"), "deadline")
    rows = results.withColumn("_again", again).join(j, "job_id", "left")
    code = (
        F.when(F.col("status").isNull() | (F.col("input_hash") != F.col("wanted_hash")), "UNMATCHED").when(F.col("_again"), "DUPLICATE").when(F.col("status") != "QUEUED", "TERMINAL")
        .when(F.col("deadline") <= F.lit(now).cast("timestamp"), "DEADLINE_EXCEEDED").when(F.col("version") != F.col("wanted_version"), "STALE_VERSION").otherwise("SUCCEEDED")
    )
    return rows.select("arrival", "job_id", code.alias("outcome"))


def outbox(rows: DataFrame, most: int = 20) -> DataFrame:
    """The oldest unpublished rows of an outbox."""
    return rows.filter("published_at is null").orderBy("created_at", "event_id").limit(most)


def write_once(rows: DataFrame, batch: int, path: str) -> None:
    """A batch under its own number: written again after a failure it takes the place of what was there."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def idempotent_sink(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, mode: str = "update") -> StreamingQuery:
    """foreachBatch; `write` gets the batch number as its idempotency key (write_once keeps to it)."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
