"""Stateful streams with timers: consensus images by rank matching, and a fair queue with retries.

Both act in event time. What arrives waits in the state until the watermark has passed it, so the results are those of
the events in order, however they are dealt to files, batches and restarts.
"""

from __future__ import annotations

import heapq
import itertools
import sys
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# a stream is set up by a Python process that does not see the files sent to the workers, so the processors travel whole
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: timers and several states a key need a store that keeps them apart
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_timers(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _millis(ts: pd.Series) -> np.ndarray:
    """Milliseconds since the epoch of a column of timestamps."""
    return ts.to_numpy("datetime64[ms]").astype(np.int64)


#: rows of a block: lists of a state are kept in blocks of columns, as every element costs a message of its own
BLOCK = 10_000


def _packed(columns: list[list]) -> Iterator[tuple]:
    """Columns of equal length as blocks for a list state."""
    for i in range(0, len(columns[0]), BLOCK):
        yield tuple(c[i : i + BLOCK] for c in columns)


def _unpacked(state) -> Iterator[tuple]:
    """The rows of a list state of blocks."""
    for block in state.get():
        yield from zip(*block, strict=True)


# --- consensus images -------------------------------------------------------------------------------------------


def ranks(v: np.ndarray) -> np.ndarray:
    """Rank from 0 of each value; equal values in the order of their places."""
    out = np.empty(len(v), np.int64)
    out[np.argsort(v, kind="stable")] = np.arange(len(v))
    return out


def blend(values: np.ndarray, weights: np.ndarray, at: np.ndarray, frame: np.ndarray, weight: float) -> None:
    """One frame over the pixels ``at`` blended into a consensus image, in place.

    The image's own tones are kept and dealt out anew: its pixels under the frame are ranked, the frame is ranked, the
    weighted means of the two ranks are ranked in turn, and every pixel gets the tone of its new rank.
    """
    own, w = values[at], weights[at]
    consensus = ranks((ranks(own) * w + ranks(frame) * weight) / (w + weight))
    values[at] = np.sort(own)[consensus]
    weights[at] += weight


class _Enhancer(StatefulProcessor):
    """State of a tile: tones and weights of its pixels, and the frames that the watermark has not passed."""

    def __init__(self, pixels: int, start: float, every_ms: int):
        self.pixels, self.start, self.every = pixels, start, every_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.image = handle.getValueState("image", "tones array<double>, weights array<double>, n int")
        self.frames = handle.getListState("frames", "ms array<bigint>, frame array<bigint>, at array<array<int>>, v array<array<double>>, weight array<double>")
        self.done = handle.getValueState("done", "ms long")

    def _end(self, ms: int) -> int:
        return (ms // self.every + 1) * self.every

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due = set()
        for pdf in rows:
            ms = _millis(pdf["ts"]).tolist()
            columns = [ms, pdf["frame"].tolist(), [[int(i) for i in at] for at in pdf["at"]], [[float(x) for x in v] for v in pdf["v"]], pdf["weight"].astype(float).tolist()]
            for block in _packed(columns):
                self.frames.appendValue(block)
            due |= {self._end(m) for m in ms}
        for ms in due:
            self.handle.registerTimer(ms)
        yield pd.DataFrame(columns=["tile", "n", "tones", "weights"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # every period that ends before the watermark, so that the frames are read once a batch
        until = timerValues.getCurrentWatermarkInMs()
        if self.done.exists() and self.done.get()[0] == until:
            return  # another timer of this batch has done it
        self.done.update((until,))
        until = max(until, expiredTimerInfo.getExpiryTimeInMs() + 1)
        now, later = [], []
        for f in _unpacked(self.frames):
            (now if self._end(f[0]) < until else later).append(f)
        if not now:
            return
        if later:
            self.frames.put(list(_packed([list(c) for c in zip(*later, strict=True)])))
        else:
            self.frames.clear()
        if self.image.exists():
            tones, weights, n = self.image.get()
            tones, weights = np.array(tones, float), np.array(weights, float)
        else:
            tones, weights, n = np.arange(self.pixels) / max(1, self.pixels - 1), np.full(self.pixels, self.start), 0
        n, out = int(n), []
        for _, period in itertools.groupby(sorted(now, key=lambda f: f[:2]), key=lambda f: self._end(f[0])):
            for _, _, at, v, weight in period:
                blend(tones, weights, np.array(at), np.array(v), weight)
                n += 1
            out.append({"tile": key[0], "n": n, "tones": tones.tolist(), "weights": weights.tolist()})
        self.image.update((tones.tolist(), weights.tolist(), n))
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def enhance(frames: DataFrame, pixels: int, every: str = "1 day", late: str = "10 minutes", start: float = 1e-3) -> DataFrame:
    """Consensus image of every tile as a stream of (tile, n, tones, weights), ``n`` frames blended in event order.

    ``frames`` has tile, frame, ts, at (pixel numbers), v (their values) and weight; frames of one time go by ``frame``.
    Frames are blended once the watermark has passed the end of their ``every``; a new image is an even ramp of tones
    with weight ``start``.
    """
    spark = frames.sparkSession
    use_timers(spark)
    every_ms = int(spark.sql(f"SELECT unix_millis(timestamp'1970-01-02 00:00:00' + INTERVAL {every}) - unix_millis(timestamp'1970-01-02 00:00:00')").first()[0])
    one = frames.select(F.col("tile").cast("long").alias("tile"), F.col("frame").cast("long").alias("frame"), "ts", F.col("at").cast("array<int>").alias("at"), F.col("v").cast("array<double>").alias("v"), F.col("weight").cast("double").alias("weight"))
    return one.withWatermark("ts", late).groupBy("tile").transformWithStateInPandas(_Enhancer(pixels, start, every_ms), "tile long, n int, tones array<double>, weights array<double>", "Append", "EventTime")


# --- a fair queue -----------------------------------------------------------------------------------------------

Work = Callable[[int, int], bool]


class Line:
    """The jobs of one user that were not started yet, in the order of their arrival; read piece by piece."""

    def __init__(self, arrived: np.ndarray, job: np.ndarray):
        self.arrived, self.job, self.started = arrived, job, 0
        self._rest = self._read()
        self.head: tuple[int, int] | None = next(self._rest, None)

    def _read(self, piece: int = 4096) -> Iterator[tuple[int, int]]:
        for k in range(0, len(self.job), piece):
            yield from zip(self.arrived[k : k + piece].tolist(), self.job[k : k + piece].tolist(), strict=True)

    def start(self) -> tuple[int, int]:
        """(arrived, job) of the first."""
        first, self.head = self.head, next(self._rest, None)
        self.started += 1
        return first


class Turns:
    """The waiting jobs of one queue, and who is next.

    Every user with a waiting job has one ticket, however many jobs wait; the anonymous user, behind whom many people
    stand, has a quarter of the other users' tickets more, but no more than it has jobs. A drawn user's oldest job starts.
    Jobs that arrive are given as a ``Line`` a user, of which those wait that have arrived at ``now``; others are added.
    """

    SHARE = 0.25

    def __init__(self, anonymous: int, lines: dict[int, Line] | None = None):
        self.anonymous, self.lines, self.at = anonymous, lines or {}, 0
        self.none = Line(np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.jobs: dict[int, list[tuple[int, int, int]]] = {}
        self.users: list[int] = []
        self.here: set[int] = set()
        #: users without a waiting job, by the arrival of their next
        self.away = [(line.head[0], user) for user, line in self.lines.items() if line.head]
        heapq.heapify(self.away)

    def _enter(self, user: int) -> None:
        if user not in self.here:
            self.here.add(user)
            insort(self.users, user)

    def add(self, user: int, arrived: int, job: int, attempt: int) -> None:
        heapq.heappush(self.jobs.setdefault(user, []), (arrived, job, attempt))
        self._enter(user)

    def now(self, at: int) -> None:
        self.at = at
        while self.away and self.away[0][0] <= at:
            user = heapq.heappop(self.away)[1]
            head = self.lines[user].head
            if head and head[0] <= at:
                self._enter(user)

    def next_arrival(self) -> int | None:
        """Of the users without a waiting job."""
        return self.away[0][0] if self.away else None

    def _extra(self) -> int:
        if self.anonymous not in self.here:
            return 0
        most, line = int(self.SHARE * (len(self.users) - 1)), self.lines.get(self.anonymous, self.none)
        short = most - len(self.jobs.get(self.anonymous, ()))
        if short <= 0:
            return most
        return most - short + int(np.searchsorted(line.arrived[line.started : line.started + short], self.at, "right"))

    def draw(self, rng) -> tuple[int, int, int, int]:
        """(user, arrived, job, attempt) of the job that starts."""
        users = self.users
        ticket = int(rng.integers(len(users) + self._extra()))
        user = users[ticket] if ticket < len(users) else self.anonymous
        again, line = self.jobs.get(user), self.lines.get(user, self.none)
        head = line.head if line.head and line.head[0] <= self.at else None
        if again and (head is None or again[0] < (*head, 0)):
            arrived, job, attempt = heapq.heappop(again)
        else:
            (arrived, job), attempt = line.start(), 0
        if not again and not (line.head and line.head[0] <= self.at):
            self.here.remove(user)
            del users[bisect_left(users, user)]
            if line.head:
                heapq.heappush(self.away, (line.head[0], user))
        return user, arrived, job, attempt


def seeds(entropy: np.ndarray) -> np.ndarray:
    """What ``np.random.SeedSequence`` makes of each row of 32-bit words for a PCG64: four 64-bit words a row."""
    words = entropy.astype(np.uint32).T
    const = 0x43B0D7E5

    def hashed(v: np.ndarray, times: int = 0x931E8875) -> np.ndarray:
        nonlocal const
        v = v ^ np.uint32(const)
        const = const * times & 0xFFFFFFFF
        v = v * np.uint32(const)
        return v ^ (v >> np.uint32(16))

    def mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        v = np.uint32(0xCA01F9DD) * x - np.uint32(0x4973F715) * y
        return v ^ (v >> np.uint32(16))

    pool = [hashed(words[i] if i < len(words) else np.zeros_like(words[0])) for i in range(4)]
    for i, j in itertools.permutations(range(4), 2):
        pool[j] = mixed(pool[j], hashed(pool[i]))
    for w in words[4:]:
        pool = [mixed(v, hashed(w)) for v in pool]
    const = 0x8B51F9DD
    out = np.stack([hashed(pool[i % 4], 0x58F38DED) for i in range(8)], axis=1).astype(np.uint64)
    return out[:, ::2] | out[:, 1::2] << np.uint64(32)


class Draws:
    """The integers that ``np.random.default_rng`` gives for the same seed, without the cost of a generator for a few of them."""

    TIMES, M64, M128 = 0x2360ED051FC65DA44385DF649FCCF645, (1 << 64) - 1, (1 << 128) - 1

    def __init__(self, words: list[int]):
        self.add = ((words[2] << 64 | words[3]) << 1 | 1) & self.M128
        self.state = ((self.add + (words[0] << 64 | words[1])) * self.TIMES + self.add) & self.M128
        self.half: int | None = None

    def _bits(self) -> int:
        if self.half is not None:
            v, self.half = self.half, None
            return v
        self.state = (self.state * self.TIMES + self.add) & self.M128
        high = self.state >> 64
        v, turn = (high ^ self.state) & self.M64, high >> 58
        v = (v >> turn | v << (64 - turn)) & self.M64
        self.half = v >> 32
        return v & 0xFFFFFFFF

    def integers(self, n: int) -> int:
        """From 0 to n - 1; n is below 2 ** 32."""
        if n == 1:
            return 0
        v = self._bits() * n
        if v & 0xFFFFFFFF < n:
            while v & 0xFFFFFFFF < ((1 << 32) - n) % n:
                v = self._bits() * n
        return v >> 32


def _words(v: int) -> list[int]:
    """The 32-bit words of a number, the lowest first."""
    return [v & 0xFFFFFFFF, *(_words(v >> 32) if v >> 32 else [])]


class Ticks:
    """``Draws`` seeded by some numbers and a tick's time, made for many ticks ahead."""

    def __init__(self, seed: list[int], tick: int, most: int = 4096):
        self.seed, self.tick, self.most = [w for v in seed for w in _words(v)], tick, most
        self.first, self.made, self.n = 0, [], 8

    def at(self, ms: int) -> Draws:
        k, off = divmod(ms - self.first, self.tick)
        if off or not 0 <= k < len(self.made):
            self.n = min(self.most, 2 * self.n) if k == len(self.made) else 16
            times = [ms + i * self.tick for i in range(self.n)]
            size = len(_words(ms))
            rows = [self.seed + w for w in map(_words, times) if len(w) == size]
            self.first, self.made, k = ms, seeds(np.array(rows, np.uint64)).tolist(), 0
        return Draws(self.made[k])


#: columns of a waiting job, and rows of a block of them at most
COLUMNS, ROWS = ("ready", "arrived", "job", "user", "attempt"), 1 << 18


def _narrow(columns: list[np.ndarray]) -> bytes:
    """Columns of whole numbers of equal length as bytes: each less its smallest, in as few bytes as that takes."""
    head, body = [len(columns[0])], []
    for c in columns:
        low = int(c.min())
        kind = np.min_scalar_type(int(c.max()) - low)
        head += [low, kind.itemsize]
        body.append((c - low).astype(kind).tobytes())
    return b"".join([np.array(head, np.int64).tobytes(), *body])


def _widened(data: bytes, n: int) -> list[np.ndarray]:
    """The ``n`` columns that ``_narrow`` made bytes."""
    head = np.frombuffer(data, np.int64, 1 + 2 * n).tolist()
    out, at = [], 8 * len(head)
    for low, size in zip(head[1::2], head[2::2], strict=True):
        out.append(np.frombuffer(data, f"u{size}", head[0], at).astype(np.int64) + low)
        at += size * head[0]
    return out


def _cut(columns: list[np.ndarray]) -> Iterator[tuple[bytes]]:
    for k in range(0, len(columns[0]), ROWS):
        yield (_narrow([c[k : k + ROWS] for c in columns]),)


class _Queue(StatefulProcessor):
    """State of a queue: jobs that wait, with the time from which they may start; the last watermark and the first tick that are not done.

    Jobs are kept as blocks of narrow columns, and those that were not started yet stay columns while the queue runs.
    """

    def __init__(self, work: Work, slots: int, tick_ms: int, wait_ms: int, retries: int, anonymous: int, seed: int):
        self.work, self.slots, self.tick, self.wait, self.retries, self.anonymous, self.seed = work, slots, tick_ms, wait_ms, retries, anonymous, seed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "block binary")
        self.done = handle.getValueState("done", "ms long, next long")

    def _next(self, ms: int) -> int:
        return -(-ms // self.tick) * self.tick

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = [(_millis(pdf["ts"]), pdf["job"].to_numpy(np.int64), pdf["user"].to_numpy(np.int64)) for pdf in rows if len(pdf)]
        if came:
            ms, job, user = (np.concatenate(c) for c in zip(*came, strict=True))
            for block in _cut([ms, ms, job, user, np.zeros(len(ms), np.int64)]):
                self.waiting.appendValue(block)
            self.handle.registerTimer(self._next(int(ms.min())))
        yield pd.DataFrame(columns=["queue", "started", "place", "job", "user", "attempt", "outcome"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # every tick before the watermark, as all that arrived up to it is here
        until = timerValues.getCurrentWatermarkInMs()
        done = self.done.get() if self.done.exists() else None
        if done and done[0] == until:
            return  # another timer of this batch has done it
        self.done.update((until, done[1] if done else 0))
        blocks = [_widened(b[0], len(COLUMNS)) for b in self.waiting.get()]
        if not blocks:
            yield pd.DataFrame(columns=["queue", "started", "place", "job", "user", "attempt", "outcome"])
            return
        ready, arrived, job, user, attempt = (np.concatenate(c) for c in zip(*blocks, strict=True))
        del blocks
        at = self._next(int(ready.min()))
        at = max(at, done[1]) if done else at
        # those that failed come back in the order in which they are ready; the others wait in a line a user
        failed = np.flatnonzero(attempt > 0)
        failed = failed[np.lexsort((attempt[failed], user[failed], job[failed], arrived[failed], ready[failed]))]
        back = deque(zip(*(c[failed].tolist() for c in (ready, arrived, job, user, attempt)), strict=True))
        fresh = np.flatnonzero(attempt == 0)
        fresh = fresh[np.lexsort((job[fresh], arrived[fresh], user[fresh]))]
        arrived, job, user = arrived[fresh], job[fresh], user[fresh]
        del ready, attempt, fresh
        ends = [0, *(np.flatnonzero(np.diff(user)) + 1).tolist(), len(user)]
        lines = {int(user[a]): Line(arrived[a:b], job[a:b]) for a, b in itertools.pairwise(ends) if a < b}
        turns, ticks = Turns(self.anonymous, lines), Ticks([self.seed, abs(int(key[0]))], self.tick)
        out: list[list] = [[] for _ in range(6)]
        add = [column.append for column in out]
        work, draw, slots, retries, wait = self.work, turns.draw, self.slots, self.retries, self.wait
        later = at >= until
        while at < until:
            turns.now(at)
            while back and back[0][0] <= at:
                _, came, again, whose, tried = back.popleft()
                turns.add(whose, came, again, tried)
            if turns.users:
                rng = ticks.at(at)
                for place in range(slots):
                    if not turns.users:
                        break
                    whose, came, one, tried = draw(rng)
                    if work(one, tried):
                        outcome = "done"
                    elif tried < retries:
                        outcome = "retry"
                        back.append((at + wait, came, one, whose, tried + 1))
                    else:
                        outcome = "given up"
                    add[0](at), add[1](place), add[2](one), add[3](whose), add[4](tried), add[5](outcome)
                if len(out[0]) >= BLOCK:
                    yield self._told(key, out)
                    for column in out:
                        column.clear()
            if turns.users:
                at += self.tick
            else:
                soon = [t for t in (turns.next_arrival(), back[0][0] if back else None) if t is not None]
                if not soon:
                    at += self.tick
                    break
                at = self._next(max(min(soon), at + 1))
        # those whose turn has not come wait for the next tick
        left = [(np.concatenate([getattr(line, n)[line.started :] for line in lines.values()]) if lines else np.zeros(0, np.int64)) for n in ("arrived", "job")]
        whose = np.repeat(np.array(list(lines), np.int64), [len(line.job) - line.started for line in lines.values()])
        rest = [*back, *((at, came, one, who, tried) for who, jobs in turns.jobs.items() for came, one, tried in jobs)]
        rest = np.array(rest, np.int64).reshape(-1, len(COLUMNS)).T
        columns = [np.concatenate([a, b]) for a, b in zip((left[0], left[0], left[1], whose, np.zeros(len(whose), np.int64)), rest, strict=True)]
        if len(columns[0]):
            self.waiting.put(list(_cut(columns)))
            self.handle.registerTimer(max(at, self._next(until + 1)))
        else:
            self.waiting.clear()
        self.done.update((until, at if later or turns.users else 0))
        yield self._told(key, out)

    def _told(self, key, out: list[list]) -> pd.DataFrame:
        numbers = {name: np.array(v, np.int64) for name, v in zip(("started", "place", "job", "user", "attempt"), out, strict=False)}
        return pd.DataFrame({"queue": np.full(len(out[0]), key[0], np.int64), **numbers, "outcome": np.array(out[5], object)})

    def close(self) -> None:
        pass


def fair_queue(jobs: DataFrame, work: Work, slots: int = 3, tick: str = "5 minutes", wait: str = "1 hour", retries: int = 20, anonymous: int = 0, late: str = "10 minutes", seed: int = 17) -> DataFrame:
    """A stream of starts (queue, started in ms, place, job, user, attempt, outcome) from arrivals (queue, job, user, ts).

    At every tick up to ``slots`` jobs of a queue start, drawn by ``Turns``; ``work(job, attempt)`` tells whether one
    succeeds. A job that fails is ready again after ``wait``, up to ``retries`` times. The draws are seeded by queue and
    tick, so the same arrivals start in the same order whatever the batches are.
    """
    spark = jobs.sparkSession
    use_timers(spark)
    span = lambda text: int(spark.sql(f"SELECT unix_millis(timestamp'1970-01-02 00:00:00' + INTERVAL {text}) - unix_millis(timestamp'1970-01-02 00:00:00')").first()[0])
    one = jobs.select(*[F.col(c).cast("long").alias(c) for c in ("queue", "job", "user")], "ts")
    return one.withWatermark("ts", late).groupBy("queue").transformWithStateInPandas(
        _Queue(work, slots, span(tick), span(wait), retries, anonymous, seed), "queue long, started long, place int, job long, user long, attempt int, outcome string", "Append", "EventTime"
    )
