"""Streaming queries, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.operators.checkpoints import scratch_folder
from starloom.plans.registry import query, table
from starloom.streaming import jobs
from starloom.streaming import stateful as sf


CHUNKS = 4


def _arrivals(spark, d, folder: str, flush: bool, days: int = 400):
    """The events as folders that arrive one after another, in the order of time, written one at each step; ``flush`` adds one event ``days`` ahead, which closes every window before it.

    A folder is written by as many tasks as its rows are read by; its files hold overlapping times, so they have to be taken together.
    """
    t = table(spark, d, "events")
    cuts = t.agg(F.percentile_approx("ts", F.array(*[F.lit(i / CHUNKS) for i in range(1, CHUNKS)]), F.lit(1000))).first()[0] or []
    arrival = sum((F.when(F.col("ts") > F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
    for i in range(CHUNKS):
        yield t.where(arrival == i).write.parquet(f"{folder}/in{i}")
    if flush:
        last = t.orderBy(F.desc_nulls_last("ts")).limit(1)
        yield last.withColumn("ts", (F.col("ts") + F.expr(f"INTERVAL {days} DAYS")).cast(t.schema["ts"].dataType)).withColumn("event_type", F.lit(FLUSH)).withColumn("user_id", F.lit(-1).cast(t.schema["user_id"].dataType)).write.parquet(f"{folder}/in{CHUNKS}")


FLUSH = "(flush)"


def _drained(spark, d, make, mode, keys=None, flush=False, days=400, tasks=None):
    """The stream's rows after it was run, from its checkpoint, over every arrival as a batch of its own."""
    folder = scratch_folder(spark, "stream")
    for _ in _arrivals(spark, d, folder, flush, days):
        stream = make(jobs.events(spark, f"{folder}/in*", table(spark, d, "events").schema, None, "*.parquet"))
        out = jobs.drain(stream, folder, mode, keys, tasks)
    return out


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_window(spark, d):
    t = _drained(spark, d, jobs.tumbling, "append", flush=True).where(F.col("event_type") != FLUSH)
    return t.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT s AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL '1 hour', ts), time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour']) AS s FROM events) GROUP BY 1, 2")
def sliding_window(spark, d):
    t = _drained(spark, d, lambda s: jobs.tumbling(s, "2 hours", "10 minutes", "1 hour"), "append", flush=True).where(F.col("event_type") != FLUSH)
    return t.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL '30 minutes' THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k"""
)
def session_windows(spark, d):
    t = _drained(spark, d, jobs.sessions, "append", flush=True).where("user_id <> -1")
    return t.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "user_id", "n")


@query("SELECT event_id % 32 AS x, user_id % 8 AS y, round(sum(value * (1 + event_id % 3)) / sum(1 + event_id % 3), 6) AS v FROM events GROUP BY 1, 2")
def streaming_coadd(spark, d):
    pix = lambda s: jobs.incremental_coadd(s.select((F.col("event_id") % 32).alias("x"), (F.col("user_id") % 8).alias("y"), F.col("value").alias("v"), (1 + F.col("event_id") % 3).alias("w")))
    return jobs.snapshot(_drained(spark, d, pix, "update", ["x", "y"])).select("x", "y", F.round("v", 6).alias("v"))


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'error')")
def chunk_ingest(spark, d):
    """Rows taken in chunk by chunk as files arrive."""
    return _drained(spark, d, lambda s: s.where(F.col("event_type").isin("click", "error")).select("event_id", "event_type"), "append")


TONES = 6


def frames(s):
    """Events as frames over four of the six pixels of a tile."""
    value = lambda j: F.pmod(F.floor(F.col("value") * 1000) * (7 * j + 3) + F.col("user_id") * j, F.lit(101)) / 101.0
    at = F.array(*[((F.col("event_id") + j) % TONES).cast("int") for j in (0, 1, 3, 4)])
    return s.select((F.col("event_id") % 16).alias("tile"), F.col("event_id").alias("frame"), "ts", at.alias("at"), F.array(*[value(j) for j in range(4)]).alias("v"), (1 + F.col("user_id") % 3).alias("weight"))


@query()
def streaming_enhance(spark, d):
    """Consensus image of each tile by rank matching, frames blended in the order of their time."""
    rows = _drained(spark, d, lambda s: sf.enhance(frames(s.where("user_id >= 0")).unionByName(frames(s.where("user_id < 0")).withColumn("tile", F.lit(-1).cast("long"))), TONES), "append", flush=True).where("tile >= 0")
    last = rows.groupBy("tile").agg(F.max_by(F.struct("n", "tones", "weights"), "n").alias("b"))
    return last.select("tile", "b.n", F.transform("b.tones", lambda v: F.round(v, 6)).alias("tones"), F.transform("b.weights", lambda v: F.round(v, 3)).alias("weights"))


#: a job of four queues for each event; users are those of the events, the first of them anonymous
SLOTS = 8
#: tasks that hold the four queues and that of the last event, each in a task of its own as keys are hashed
TASKS = 10
FAILS = "({job} * 31 + {attempt} * 17) % 10 < 3"


def arrivals(s):
    return s.select((F.col("event_id") % 4).alias("queue"), F.col("event_id").alias("job"), (F.col("user_id") % 40).alias("user"), "ts")


def _starts(spark, d):
    flushed = lambda s: arrivals(s.where("user_id >= 0")).unionByName(arrivals(s.where("user_id < 0")).withColumn("queue", F.lit(-1).cast("long")))
    # the last event comes after the longest queue has had hours enough for all its starts
    bad = [FAILS.format(job="job", attempt=i) for i in range(2)]
    starts = arrivals(table(spark, d, "events")).groupBy("queue").agg(F.sum(F.expr(f"1 + CASE WHEN {bad[0]} THEN 1 + CASE WHEN {bad[1]} THEN 1 ELSE 0 END ELSE 0 END")).alias("n"))
    days = 400 + (starts.agg(F.max("n")).first()[0] or 0) // (SLOTS * 24)
    return _drained(spark, d, lambda s: sf.fair_queue(flushed(s), lambda job, attempt: not (job * 31 + attempt * 17) % 10 < 3, slots=SLOTS, tick="1 hour", wait="3 hours", retries=2), "append", flush=True, days=days, tasks=TASKS).where("queue >= 0")


@query()
def fair_queue(spark, d):
    """Jobs of several users started in turns, with a share for the anonymous and with retries."""
    return _starts(spark, d).select("queue", "started", "place", "job", "user", "attempt", "outcome")


@query(
    f"""WITH j AS (SELECT event_id AS job, event_id % 4 AS queue FROM events), a AS (SELECT queue, job, 0 AS attempt, {FAILS.format(job="job", attempt=0)} AS bad FROM j
UNION ALL SELECT queue, job, 1, {FAILS.format(job="job", attempt=1)} FROM j WHERE {FAILS.format(job="job", attempt=0)} UNION ALL SELECT queue, job, 2, {FAILS.format(job="job", attempt=2)} FROM j WHERE {FAILS.format(job="job", attempt=0)} AND {FAILS.format(job="job", attempt=1)})
SELECT queue, CAST(attempt AS INT) AS attempt, CASE WHEN NOT bad THEN 'done' WHEN attempt < 2 THEN 'retry' ELSE 'given up' END AS outcome, count(*) AS starts, count(DISTINCT job) AS jobs FROM a GROUP BY ALL"""
)
def fair_queue_outcomes(spark, d):
    """Starts by queue, attempt and outcome: none is lost or done twice."""
    return _starts(spark, d).groupBy("queue", "attempt", "outcome").agg(F.count("*").alias("starts"), F.count_distinct("job").alias("jobs"))
