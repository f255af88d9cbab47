"""Event-time ordered stream rules: triggers in any order give what the batch rules give."""

import datetime as dt
import os
import random
import time
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from branchlight.operators import monitor
from branchlight.streaming import concurrency, ordered
from branchlight.streaming.run import drain, drain_to_the_end, shared_folder

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def triggers(spark, schema, parts):
    """A stream that meets each of ``parts`` in a trigger of its own, in this order."""
    folder = shared_folder(spark, "input")
    spark.createDataFrame([], schema).write.parquet(folder)
    now = time.time() - 1000
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}-{n}")
        local = f"{folder}-{n}".removeprefix("file:")
        (name,) = [f for f in os.listdir(local) if f.endswith(".parquet") and not f.startswith(".")]
        os.utime(f"{local}/{name}", (now + n, now + n))
        os.rename(f"{local}/{name}", f"{folder.removeprefix('file:')}/part-{n}.parquet")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def plain(t):
    return t.replace(tzinfo=None)


def test_suppression_by_event_time(spark):
    """A trigger whose alerts are all suppressed, and triggers in swapped order."""
    shape = "alert_type string, ts timestamp"
    quiet = [[("a", at(0))], [("a", at(60))], [("a", at(420))], [("a", at(421)), ("a", at(421)), (None, at(400)), ("a", None)]]
    rnd = random.Random(3)
    busy = [[(k, at(600 + rnd.randint(0, 500) + rnd.random())) for k in "ab" for _ in range(40)] for _ in range(3)]
    swapped = [quiet[0], quiet[2], quiet[1], busy[2], quiet[3], busy[0], busy[1]]
    rows = [r for part in swapped for r in part]
    want = {(r.alert_type, r.emitted_at) for r in monitor.suppress_repeat_alerts(spark.createDataFrame(rows, shape), 300).collect()}
    got = drain_to_the_end(triggers(spark, shape, swapped), lambda s: ordered.stream_suppress_repeats(s, 300), "ts").collect()
    assert len(got) == len(want) and {(r.alert_type, plain(r.emitted_at)) for r in got} == want
    assert ("a", at(0)) in want and ("a", at(60)) not in want and ("a", at(420)) in want


def test_trailing_rate_by_event_time(spark):
    """Twelve requests in 21 seconds, on both sides of a minute, in shuffled triggers; equal times; a request just outside."""
    shape = "username string, ts timestamp"
    times = [50 + s for s in range(10)] + [65, 71, 125, 125, 125.5, 131]
    rows = [("u", at(t)) for t in times] + [("v", at(10 * t)) for t in range(20)] + [("w", at(30))] * 12 + [(None, at(5))]
    random.Random(5).shuffle(rows)
    stream = triggers(spark, shape, [rows[:9], rows[9:20], rows[20:]])
    got = drain_to_the_end(stream, lambda s: ordered.stream_rate_violations(s, 10, 60), "ts").collect()
    want = monitor.rate_violations(spark.createDataFrame(rows, shape), 10, 60).collect()
    assert Counter((r.username, plain(r.ts), r.requests) for r in got) == Counter((r.username, plain(r.ts), r.requests) for r in want)
    assert {(r.username, plain(r.ts), r.requests) for r in got if r.username == "u"} == {("u", at(65), 11), ("u", at(71), 12)}
    assert Counter(r.requests for r in got if r.username == "w") == Counter({12: 12})


def test_keys_expire_by_event_time(spark):
    """Without a new row of the key; a renewed key later; a late row not at all.

    Spark discards by the watermark that the trigger before worked with."""
    shape = "key long, ts timestamp"
    stream = triggers(spark, shape, [
        [(1, at(0)), (2, at(0)), (2, at(100))], [(3, at(4_000)), (2, at(50))], [(4, at(20_000)), (6, None)],
        [(5, at(3_000)), (4, at(20_500))], [(7, at(40_000)), (None, at(19_000)), (None, at(19_500))]])
    got = drain(ordered.stream_expirations(stream, ["key"], 1_000))
    assert got.schema["key"].dataType.simpleString() == "bigint"
    assert {(r.key, plain(r.ts), plain(r.expired_at)) for r in got.collect()} == {
        (1, at(0), at(1_000)), (2, at(100), at(1_100)), (3, at(4_000), at(5_000)), (4, at(20_500), at(21_500)),
        (None, at(19_500), at(20_500))}


def test_concurrency_over_many_triggers(spark):
    rnd = random.Random(8)
    ops = [(float(s), float(s + rnd.randint(1, 900))) for s in (rnd.randint(0, 4_000) for _ in range(60))] + [(0.0, 4_900.0)] * 2
    edges = sorted([(at(s), 1) for s, _ in ops] + [(at(f), -1) for _, f in ops])
    parts = [edges[i:i + 31] for i in range(0, len(edges), 31)]
    assert len(parts) == 4
    stream = triggers(spark, "at timestamp, step int", parts)
    target = shared_folder(spark, "peaks")

    def run(rows, folder):
        concurrency.stream_concurrency_peaks(rows, target, f"{folder}/state", 5).awaitTermination()
        return concurrency.read_peaks(spark, target)

    got = drain_to_the_end(stream, lambda r: r, "at", run=run).collect()
    stored = spark.createDataFrame([(at(s), at(f)) for s, f in ops], "started timestamp, finished timestamp")
    want = monitor.concurrency_peaks(stored, 5).collect()
    assert want and sorted((plain(r.moment), r.active) for r in got) == sorted((plain(r.moment), r.active) for r in want)


def test_edges(spark):
    rows = spark.createDataFrame([("start", at(0)), ("finish", at(1)), ("other", at(2))], "phase string, ts timestamp")
    assert [r.step for r in concurrency.operation_edges(rows).orderBy("at").collect()] == [1, -1, None]
    assert concurrency.operation_edges(rows).filter(F.col("step").isNull()).count() == 1


class Handle:
    """The state of one key in memory, and how often it is used."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)

    def getMapState(self, *_):
        return State(self)

    getValueState = getMapState


class State:
    def __init__(self, handle):
        self.handle, self.kept = handle, {}

    def _use(self, value=None):
        self.handle.calls += 1
        return value

    def exists(self):
        return self._use("value" in self.kept)

    def get(self):
        return self._use(self.kept["value"])

    def update(self, value):
        self._use(self.kept.update(value=value))

    def clear(self):
        self._use(self.kept.pop("value", None))

    def containsKey(self, key):
        return self._use(key in self.kept)

    def getValue(self, key):
        return self._use(self.kept[key])

    def updateValue(self, key, value):
        self._use(self.kept.update({key: value}))

    def removeKey(self, key):
        self._use(self.kept.pop(key, None))

    def keys(self):
        return self._use(iter([*self.kept]))

    def iterator(self):
        return self._use(iter([*self.kept.items()]))


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getExpiryTimeInMs(self):
        return self.ms

    getCurrentWatermarkInMs = getExpiryTimeInMs


def replay(rule, steps):
    """Rows a key's rule gives; a step is (frames of microseconds, watermark in ms after them)."""
    handle, out = Handle(), []
    rule.init(handle)
    for frames, mark in steps:
        if frames:
            list(rule.handleInputRows(("k",), iter([pd.DataFrame({"event_us": pd.Series(f, dtype="Int64")}) for f in frames]), Clock(mark)))
        for ms in sorted(x for x in handle.timers if x <= mark):
            handle.timers.discard(ms)

            class Both(Clock):
                def getCurrentWatermarkInMs(self):
                    return mark

            for frame in rule.handleExpiredTimer(("k",), Both(ms), Clock(ms)):
                out += frame.to_dict("records")
    return out, handle


def test_counts_of_a_key_in_pages(monkeypatch):
    """Pages of four times, equal times over several pages' length, triggers within the watermark's delay; no state stays."""
    monkeypatch.setattr(ordered, "PAGE", 4)
    rnd = random.Random(8)
    for seed in range(20):
        parts = [[rnd.choice([rnd.randrange(a * 10 ** 7, a * 10 ** 7 + 25 * 10 ** 6), a * 10 ** 7 + 5_000_000]) for _ in range(rnd.randint(0, 40))]
                 for a in range(1, 8)]
        steps = [([p[: len(p) // 2], [*p[len(p) // 2:], None]], a * 10 ** 4 + 10 ** 4 - 1) for a, p in enumerate(parts, 1)] + [([], 10 ** 8)]
        got, handle = replay(ordered._TrailingCounts("u", 3, 6_000_000, 2_000), steps)
        times = [t for p in parts for t in p]
        want = [(t, n) for t in times if (n := sum(t - 6_000_000 < x <= t for x in times)) > 3]
        assert Counter((r["us"], r["requests"]) for r in got) == Counter(want)
        assert not handle.timers


def test_a_quiet_user_costs_few_state_calls():
    """Seventy requests, hours apart, in one trigger and then decided."""
    hours = [h * 3_600_000_000 * 10 for h in range(1, 71)]
    for rule, many in ((ordered._TrailingCounts("u", 2, 3_600_000_000, 60_000), 0), (ordered._Expire(["u"], 21_600_000_000), 70)):
        got, handle = replay(rule, [([hours], 0), ([], 10 ** 10)])
        assert len(got) == many and handle.calls < 20


def test_runs_of_a_key_in_any_order():
    """A version renews the one before whichever is read first, also one that was itself renewed already."""
    rnd = random.Random(4)
    for _ in range(50):
        times = [rnd.randrange(0, 400) * 1_000 for _ in range(30)]
        cuts = sorted(rnd.sample(range(31), 3))
        frames = [times[a:b] for a, b in zip([0, *cuts], [*cuts, 30])]
        got, handle = replay(ordered._Expire(["u"], 10_000), [([f], 0) for f in frames if f] + [([], 10 ** 6)])
        assert [r["us"] for r in got] == [t for t in sorted(set(times)) if not any(t < x <= t + 10_000 for x in times)]
        assert not handle.timers
