"""Stateful streams against plain loops over the events in order, also across restarts."""

import datetime
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.plans import catalogue
from starloom.streaming import jobs
from starloom.streaming import stateful as sf

START = datetime.datetime(2024, 1, 1)
SCHEMA = "event_id long, user_id long, ts timestamp, value double"


def at_ms(ts):
    return int((ts - datetime.datetime(1970, 1, 1)).total_seconds() * 1000)


def slow_image(frames, pixels, start):
    """Tones and weights after all (order, at, values, weight), by the words of the rule."""
    place = lambda v: [sorted(range(len(v)), key=lambda j: (v[j], j)).index(i) for i in range(len(v))]
    tones, weights = [i / (pixels - 1) for i in range(pixels)], [start] * pixels
    for _, at, v, w in sorted(frames):
        own = [tones[i] for i in at]
        mean = [(a * weights[i] + b * w) / (weights[i] + w) for a, b, i in zip(place(own), place(v), at, strict=True)]
        for i, r in zip(at, place(mean), strict=True):
            tones[i] = sorted(own)[r]
            weights[i] += w
    return tones, weights


def slow_queue(queue, arrivals, work, slots, tick, wait, retries, anonymous, seed):
    """Ticks one after another over plain lists; ``arrivals`` are (ms, job, user)."""
    pending = [(ms, ms, job, user, 0) for ms, job, user in arrivals]
    out = []
    at = math.ceil(min(pending)[0] / tick) * tick if pending else 0
    while pending:
        ready = sorted(p for p in pending if p[0] <= at)
        rng = np.random.default_rng([seed, queue, at])
        for place in range(slots):
            if not ready:
                break
            users = sorted({p[3] for p in ready})
            own = sum(p[3] == anonymous for p in ready)
            users += [anonymous] * min(int(0.25 * (len(users) - 1)), own)
            user = users[int(rng.integers(len(users)))]
            chosen = min((p for p in ready if p[3] == user), key=lambda p: (p[1], p[2]))
            ready.remove(chosen)
            pending.remove(chosen)
            _, arrived, job, _, attempt = chosen
            outcome = "done" if work(job, attempt) else "retry" if attempt < retries else "given up"
            out.append((queue, at, place, job, user, attempt, outcome))
            if outcome == "retry":
                pending.append((at + wait, arrived, job, user, attempt + 1))
        at += tick
    return out


@pytest.fixture(scope="module")
def events():
    rng = np.random.default_rng(9)
    n = 300
    minutes = np.sort(rng.integers(0, 60 * 40, n))
    return [(i, int(rng.integers(0, 6)), START + datetime.timedelta(minutes=int(m)), float(rng.integers(0, 9))) for i, m in enumerate(minutes)]


def write(spark, rows, folder, parts):
    """The rows as ``parts`` arrivals, and one far ahead that ends the stream."""
    for k in range(parts):
        spark.createDataFrame(rows[k * len(rows) // parts : (k + 1) * len(rows) // parts], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in{k}")


def close(spark, folder):
    spark.createDataFrame([(10**6, -1, START + datetime.timedelta(days=900), 0.0)], SCHEMA).coalesce(1).write.parquet(f"{folder}/in99")


def source(spark, folder):
    return jobs.events(spark, f"{folder}/in*", spark.createDataFrame([], SCHEMA).schema, glob="*.parquet")


def frames_of(s):
    one = s.where("user_id >= 0")
    return one.select((F.col("user_id") % 3).alias("tile"), F.col("event_id").alias("frame"), "ts", F.array(*[((F.col("event_id") + j) % 5).cast("int") for j in (0, 2, 4)]).alias("at"), F.array("value", F.lit(4.0), F.col("event_id") % 7 * 1.0).alias("v"), (1 + F.col("user_id")).alias("weight")).unionByName(
        s.where("user_id < 0").select(F.lit(-1).cast("long").alias("tile"), F.col("event_id").alias("frame"), "ts", F.array(F.lit(0)).alias("at"), F.array(F.lit(1.0)).alias("v"), F.lit(1).cast("long").alias("weight"))
    )


@pytest.mark.parametrize("parts", [1, 4])
def test_consensus_images(spark, events, tmp_path, parts):
    rows = events + [(900, 1, START, 5.0), (899, 1, START, 2.0)]  # equal times, out of order
    rows.sort(key=lambda r: r[2])
    write(spark, rows, tmp_path, parts)
    close(spark, tmp_path)
    got = jobs.drain(sf.enhance(frames_of(source(spark, tmp_path)), 5, every="6 hours"), str(tmp_path / "run"), "append")
    last = {}
    for r in got.where("tile >= 0").collect():
        if r.n > last.get(r.tile, (0,))[0]:
            last[r.tile] = (r.n, r.tones, r.weights)
    per_tile = defaultdict(list)
    for e, u, ts, v in rows:
        per_tile[u % 3].append(((at_ms(ts), e), [(e + j) % 5 for j in (0, 2, 4)], [v, 4.0, float(e % 7)], 1.0 + u))
    assert set(last) == set(per_tile)
    for tile, frames in per_tile.items():
        tones, weights = slow_image(frames, 5, 1e-3)
        assert last[tile][0] == len(frames)
        assert last[tile][1] == tones and np.allclose(last[tile][2], weights)


def test_blending_keeps_the_tones():
    rng = np.random.default_rng(1)
    tones, weights = np.arange(50) / 49, np.full(50, 1e-3)
    true = rng.permutation(50)
    for _ in range(60):
        at = np.sort(rng.choice(50, 30, replace=False))
        sf.blend(tones, weights, at, true[at] + rng.normal(0, 3, 30), 1.0)
    assert np.allclose(np.sort(tones), np.arange(50) / 49)
    assert np.corrcoef(sf.ranks(tones), true)[0, 1] > 0.98


def flaky(job, attempt):
    return (job * 7 + attempt * 3) % 5 > 1 or attempt > 6


def hopeless(job, attempt):
    return job % 2 == 0


@pytest.mark.parametrize(("parts", "work", "slots", "retries"), [(1, flaky, 2, 20), (5, flaky, 2, 20), (3, hopeless, 4, 20), (3, hopeless, 1, 0)])
def test_queue_equals_a_plain_simulation(spark, events, tmp_path, parts, work, slots, retries):
    write(spark, events, tmp_path, parts)
    close(spark, tmp_path)
    queued = lambda s: s.select((F.when(F.col("user_id") < 0, -1).otherwise(F.col("event_id") % 2)).alias("queue"), F.col("event_id").alias("job"), F.col("user_id").alias("user"), "ts")
    stream = sf.fair_queue(queued(source(spark, tmp_path)), work, slots, "30 minutes", "2 hours", retries)
    got = sorted(tuple(r) for r in jobs.drain(stream, str(tmp_path / "run"), "append").where("queue >= 0").select("queue", "started", "place", "job", "user", "attempt", "outcome").collect())
    want = []
    for q in (0, 1):
        want += slow_queue(q, [(at_ms(ts), e, u) for e, u, ts, _ in events if e % 2 == q], work, slots, 1_800_000, 7_200_000, retries, 0, 17)
    assert got == sorted(want)
    ends = defaultdict(list)
    for _, _, _, job, _, attempt, outcome in got:
        ends[job].append((attempt, outcome))
    assert all([a for a, _ in sorted(v)] == list(range(len(v))) and sorted(v)[-1][1] != "retry" and len(v) <= retries + 1 for v in ends.values())
    if work is hopeless and retries:
        assert max(len(v) for v in ends.values()) == 21


def test_a_restart_keeps_the_retries(spark, events, tmp_path):
    """The stream ends after each arrival and starts again from its progress."""
    queued = lambda s: s.select((F.when(F.col("user_id") < 0, -1).otherwise(0)).alias("queue"), F.col("event_id").alias("job"), F.col("user_id").alias("user"), "ts")
    some = events[:120]
    for k in range(3):
        spark.createDataFrame(some[40 * k : 40 * k + 40], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in{k}")
        jobs.drain(sf.fair_queue(queued(source(spark, tmp_path)), flaky, 2, "30 minutes", "5 hours"), str(tmp_path / "run"), "append")
    close(spark, tmp_path)
    rows = jobs.drain(sf.fair_queue(queued(source(spark, tmp_path)), flaky, 2, "30 minutes", "5 hours"), str(tmp_path / "run"), "append")
    got = sorted(tuple(r) for r in rows.where("queue = 0").select("queue", "started", "place", "job", "user", "attempt", "outcome").collect())
    assert got == sorted(slow_queue(0, [(at_ms(ts), e, u) for e, u, ts, _ in some], flaky, 2, 1_800_000, 18_000_000, 20, 0, 17))
    assert any(r[5] > 0 for r in got)


def test_tickets():
    turns = sf.Turns(anonymous=0)
    for user in range(9):
        for j in range(3):
            turns.add(user, j, 10 * user + j, 0)
    rng = np.random.default_rng(0)
    drawn = []
    for _ in range(3000):
        user, arrived, job, attempt = turns.draw(rng)
        drawn.append(user)
        turns.add(user, arrived, job, attempt)
    share = drawn.count(0) / len(drawn)
    assert abs(share - 3 / 11) < 0.03 and all(abs(drawn.count(u) / len(drawn) - 1 / 11) < 0.03 for u in range(1, 9))


def test_registered_queries(spark, sf_dir="/root/testdata/sf0.001"):
    rows = [(r.event_id, r.user_id, r.ts.replace(tzinfo=None), r.value) for r in spark.read.parquet(f"{sf_dir}/events.parquet").collect()]
    want = []
    for q in range(4):
        want += slow_queue(q, [(at_ms(ts), e, u % 40) for e, u, ts, _ in rows if e % 4 == q], lambda job, attempt: not (job * 31 + attempt * 17) % 10 < 3, 8, 3_600_000, 10_800_000, 2, 0, 17)
    got = catalogue.QUERIES["fair_queue"](spark, sf_dir)
    assert sorted(map(tuple, got.collect())) == sorted(want)


class _Store:
    """States of one key in memory, which count their messages."""

    def __init__(self):
        self.rows, self.reads, self.appends, self.timers = [], 0, 0, []

    def getListState(self, name, schema):
        return self

    def getValueState(self, name, schema):
        held = []
        return type("Value", (), {"exists": lambda s: bool(held), "get": lambda s: held[0], "update": lambda s, v: held.__setitem__(slice(None), [v])})()

    def appendValue(self, row):
        self.appends += 1
        self.rows.append(row)

    def get(self):
        self.reads += 1
        return iter(list(self.rows))

    def put(self, rows):
        self.rows = list(rows)

    def clear(self):
        self.rows = []

    def registerTimer(self, ms):
        self.timers.append(ms)


def test_states_are_read_once_a_batch_and_kept_in_blocks():
    import pandas as pd

    n, day = 3000, 86_400_000
    ts = pd.Series(pd.to_datetime(np.arange(n) * (30 * day // n), unit="ms"))
    frames = pd.DataFrame({"ts": ts, "frame": range(n), "at": [[0, 1]] * n, "v": [[0.1, 0.2]] * n, "weight": 1.0})
    jobs_ = pd.DataFrame({"ts": ts, "job": range(n), "user": 1})
    clock = type("Clock", (), {"getCurrentWatermarkInMs": lambda s: 40 * day})()
    for processor, rows, results in ((sf._Enhancer(4, 1e-3, day), frames, 30), (sf._Queue(lambda job, attempt: True, 3, day // 24, day, 2, 0, 17), jobs_, 40 * 24)):
        store = _Store()
        processor.init(store)
        list(processor.handleInputRows((1,), iter([rows]), clock))
        out = [pdf for ms in sorted(set(store.timers)) for pdf in processor.handleExpiredTimer((1,), clock, type("Timer", (), {"getExpiryTimeInMs": lambda s, ms=ms: ms})())]
        assert store.appends == 1 and store.reads == 1
        assert 0 < sum(map(len, out)) <= max(results, n)


def test_a_long_backlog_is_started_whole(spark, tmp_path):
    """More starts than 400 days have room for, as at six times the table of scale 0.1."""
    n = 62_000
    t = spark.range(n).select((F.col("id") * 4).alias("event_id"), (F.col("id") % 7).alias("user_id"), F.timestamp_seconds(1_704_067_200 + F.col("id") * 40).cast("timestamp_ntz").alias("ts"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"))
    t.write.parquet(f"{tmp_path}/events.parquet")
    got = catalogue.QUERIES["fair_queue_outcomes"](spark, str(tmp_path)).agg(F.sum(F.when(F.col("attempt") == 0, F.col("jobs")))).first()[0]
    assert got == n


def test_draws_are_those_of_numpy():
    for seed, tick in (([17, 0], 3_600_000), ([17, 5], 1), ([1 << 40, 3], 7), ([0, 1 << 33, 9], 1_800_000)):
        ticks = sf.Ticks(seed, tick, most=64)
        for at in [*range(0, 40 * tick, tick), (1 << 32) - tick, 1 << 32, *range(1_704_067_200_000, 1_704_067_200_000 + 300 * tick, tick), 3]:
            rng, draws = np.random.default_rng([*seed, at]), ticks.at(at)
            for n in (1, 2, 7, 41, 1, 1_000_003, 3_000_000_000, 3_000_000_000, 5):
                assert draws.integers(n) == int(rng.integers(n))


def test_narrow_columns():
    rng = np.random.default_rng(0)
    for n in (1, 1000):
        columns = [rng.integers(low, high, n) for low, high in ((0, 1), (-(1 << 62), 1 << 62), (1 << 40, (1 << 40) + 70_000), (-5, 5), (0, 1 << 33))]
        data = sf._narrow(columns)
        assert all((a == b).all() for a, b in zip(columns, sf._widened(data, 5), strict=True))
        assert len(data) <= 88 + n * (1 + 8 + 4 + 1 + 8)


def test_half_a_million_waiting_jobs_take_seconds():
    """One queue whose jobs all wait, at once and in five parts of time, starts the same jobs at the same time."""
    import time

    import pandas as pd

    n, hour = 500_000, 3_600_000
    ms = np.sort(np.random.default_rng(2).integers(0, 30 * 24 * hour, n))
    jobs_ = pd.DataFrame({"ts": pd.to_datetime(ms, unit="ms"), "job": np.arange(n), "user": np.arange(n) * 7 % 40})
    results = []
    for parts in (1, 5):
        store, done, began = _Store(), [], time.process_time()
        processor = sf._Queue(lambda job, attempt: (job + attempt) % 4 > 0, 8, hour, 3 * hour, 2, 0, 17)
        processor.init(store)
        for some in np.array_split(np.arange(n), parts):
            end = int(ms[some[-1]]) + 1 if some[-1] < n - 1 else 20 * n * hour
            clock = type("Clock", (), {"getCurrentWatermarkInMs": lambda s, end=end: end})()
            list(processor.handleInputRows((1,), iter([jobs_.iloc[some]]), clock))
            done += list(processor.handleExpiredTimer((1,), clock, None))
        results.append(pd.concat([d for d in done if len(d)], ignore_index=True))
        assert time.process_time() - began < 10
        assert not store.rows and set(results[-1]["job"]) == set(range(n))
    assert results[0].equals(results[1])


def test_states_of_few_keys_are_dealt_to_few_tasks(spark, events, tmp_path):
    write(spark, events[:60], tmp_path, 1)
    close(spark, tmp_path)
    queued = lambda s: s.select((F.when(F.col("user_id") < 0, -1).otherwise(0)).alias("queue"), F.col("event_id").alias("job"), F.col("user_id").alias("user"), "ts")
    rows = jobs.drain(sf.fair_queue(queued(source(spark, tmp_path)), flaky, 2, "30 minutes", "5 hours"), str(tmp_path / "run"), "append", tasks=2)
    assert rows.where("queue = 0 AND outcome = 'done'").count() == 60
    held = [p.name for p in (tmp_path / "run/progress/state/0").iterdir() if p.name.isdigit()]
    assert sorted(held) == ["0", "1"] and spark.conf.get("spark.sql.shuffle.partitions") == "4"
