"""Event-time ordered rules on streams: repeat suppression, trailing request counts and expiry.

What these rules decide about a row depends on all rows before it in event time, so a row waits, in keyed state, until the
watermark has passed it; then it is decided in order. Rows that come after the watermark are discarded by the operator.
The result is that of the batch rule, whatever the triggers were and in whichever order rows came within the watermark's delay.

Waiting times of repeat suppression lie in slots of event time. A slot has one timer, set to its end: when it fires no further row
of the slot can be accepted, and all slots before it have been decided, because timers fire in time order. Request counts lie in
pages of so many times instead, as most users have few, and one timer decides all slots that the watermark has passed. A busy key
never holds more than one slot's or page's times in memory; the rest stays in the state store (RocksDB, which these rules need).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .run import use_rocksdb

WATERMARK = "10 minutes"


class EventTimeBuffer:
    """A key's undecided times (microseconds) by slot, in map state, with a timer at each slot's end."""

    def __init__(self, handle: StatefulProcessorHandle, slot_ms: int, distinct: bool):
        self.handle, self.slot_ms, self.distinct = handle, slot_ms, distinct
        self.waiting = handle.getMapState("waiting", "slot long", "times array<long>")

    def add(self, times: pd.Series) -> None:
        us = np.sort(times.dropna().to_numpy(np.int64))
        slots = us // (self.slot_ms * 1000)
        for slot in np.unique(slots).tolist():
            new = us[slots == slot].tolist()
            if self.waiting.containsKey((slot,)):
                new += self.waiting.getValue((slot,))[0]
            else:
                self.handle.registerTimer((slot + 1) * self.slot_ms)
            self.waiting.updateValue((slot,), (sorted(set(new) if self.distinct else new),))

    def take(self, timer_ms: int) -> list[int]:
        """The times of the slot that ends at ``timer_ms``, in order; they leave the buffer."""
        slot = timer_ms // self.slot_ms - 1
        if not self.waiting.containsKey((slot,)):
            return []
        times = list(self.waiting.getValue((slot,))[0])
        self.waiting.removeKey((slot,))
        return times

    def timer_after(self, us: int) -> None:
        """A timer at the first slot end at or after ``us``."""
        self.handle.registerTimer(-(-us // (self.slot_ms * 1000)) * self.slot_ms)


class _Suppress(StatefulProcessor):
    def __init__(self, quiet_us: int, slot_ms: int):
        self.quiet_us, self.slot_ms = quiet_us, slot_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buffer = EventTimeBuffer(handle, self.slot_ms, distinct=True)
        self.last = handle.getValueState("last", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            if key[0] is not None:
                self.buffer.add(frame["event_us"])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        last, out = self.last.get()[0] if self.last.exists() else None, []
        for us in self.buffer.take(now):
            if last is None or us >= last + self.quiet_us:
                out.append(us)
                last = us
        if out:
            self.last.update((last,))
            self.buffer.timer_after(last + self.quiet_us)
            yield pd.DataFrame({"alert_type": key[0], "us": out})
        elif last is not None and last + self.quiet_us <= now * 1000:
            self.last.clear()  # it can suppress nothing that is still to come


def stream_suppress_repeats(alerts: DataFrame, quiet_seconds: int = 300, ts: str = "ts", kind: str = "alert_type",
                            watermark: str = WATERMARK, slot_seconds: int = 10) -> DataFrame:
    """(alert_type, emitted_at): an alert only when the last *emitted* one of its type is at least the quiet time old.

    Alerts are decided in event-time order once the watermark has passed their slot of ``slot_seconds``, so triggers in any
    order within the watermark's delay give the result of ``suppress_repeat_alerts``. Equal times of one type count once;
    null types and times are left out. Of a type that stays silent no state is left."""
    use_rocksdb(alerts.sparkSession)
    at = F.col(ts).cast("timestamp")
    rows = (alerts.select(F.col(kind).alias("alert_type"), at.alias("event_at")).withWatermark("event_at", watermark)
            .withColumn("event_us", F.unix_micros("event_at")))
    out = rows.groupBy("alert_type").transformWithStateInPandas(
        _Suppress(quiet_seconds * 1_000_000, slot_seconds * 1000), "alert_type string, us long", "Append", "EventTime")
    return out.select("alert_type", F.timestamp_micros("us").alias("emitted_at"))


#: Times of a page of ``PagedTimes``, about.
PAGE = 10_000


class PagedTimes:
    """A key's times (microseconds) in order, in pages of map state under a directory (each page's name, first time and size).

    A key of few times is one page, read and written at once; of a busy key one page at a time is in memory. Equal times
    share a page. ``decided`` times lie below it; ``due`` is the timer that is set for the first of the others."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.pages = handle.getMapState("pages", "page long", "times array<long>")
        self.kept = handle.getValueState("directory", "names array<long>, lows array<long>, sizes array<long>, decided long, due long")

    def load(self) -> None:
        if self.kept.exists():
            names, lows, sizes, self.decided, self.due = self.kept.get()
            self.names, self.lows, self.sizes = list(names), list(lows), list(sizes)
        else:
            self.names, self.lows, self.sizes, self.decided, self.due = [], [], [], -(1 << 62), -1

    def save(self) -> None:
        if self.names:
            self.kept.update((self.names, self.lows, self.sizes, self.decided, self.due))
        elif self.kept.exists():
            self.kept.clear()

    def page(self, at: int) -> np.ndarray:
        return np.array(self.pages.getValue((self.names[at],))[0], np.int64)

    def add(self, times: np.ndarray) -> None:
        """Sorted times enter the pages in whose range they lie; a page grown to twice PAGE is cut."""
        if not self.names:
            self._put(0, 0, times)
            return
        place = np.maximum(np.searchsorted(self.lows, times, "right") - 1, 0)
        for at in np.unique(place)[::-1].tolist():  # from the last, so that the places before stay
            self._put(at, at + 1, np.sort(np.concatenate([self.page(at), times[place == at]])))

    def _put(self, start: int, stop: int, times: np.ndarray) -> None:
        """The page at ``start`` (none if ``stop`` is the same) becomes the pages of ``times``."""
        cuts = [0]
        while len(times) - cuts[-1] > 2 * PAGE:
            at = int(np.searchsorted(times, times[cuts[-1] + PAGE], "left"))
            if at == cuts[-1]:
                at = int(np.searchsorted(times, times[at], "right"))
            if at == len(times):
                break
            cuts.append(at)
        new = max(self.names, default=-1) + 1
        names = [*self.names[start:stop], *range(new, new + len(cuts))][:len(cuts)]
        parts = [times[a:b] for a, b in zip(cuts, [*cuts[1:], len(times)])]
        for name, part in zip(names, parts):
            self.pages.updateValue((name,), (part.tolist(),))
        self.names[start:stop] = names
        self.lows[start:stop] = [int(p[0]) for p in parts]
        self.sizes[start:stop] = [len(p) for p in parts]

    def drop_before(self, us: int) -> None:
        """Forget the pages whose times all lie below ``us``."""
        while self.names and (self.lows[1] <= us if len(self.names) > 1 else self.page(0)[-1] < us):
            self.pages.removeKey((self.names[0],))
            del self.names[0], self.lows[0], self.sizes[0]


class _TrailingCounts(StatefulProcessor):
    """Times stay for the length of the window after their decision; a timer decides all that the watermark has passed, and one
    is set for the next slot's end."""

    def __init__(self, user: str, most: int, length_us: int, slot_ms: int):
        self.user, self.most, self.length_us, self.slot_ms = user, most, length_us, slot_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.times = handle, PagedTimes(handle)

    def _timer(self, us: int, first: bool = False) -> None:
        """The timer at the end of the slot of ``us``; with ``first``, if it comes before the one that is set."""
        due = (us // (self.slot_ms * 1000) + 1) * self.slot_ms
        if not first or self.times.due < 0 or due < self.times.due:
            self.handle.registerTimer(due)
            self.times.due = due

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.times.load()
        held, many = [], 0
        for frame in rows:
            held.append(frame["event_us"].dropna().to_numpy(np.int64))
            many += len(held[-1])
            if many >= 100 * PAGE:
                self._add(held)
                held, many = [], 0
        if many:
            self._add(held)
        self.times.save()
        return iter(())

    def _add(self, held: list[np.ndarray]) -> None:
        us = np.sort(np.concatenate(held))
        self.times.add(us)
        self._timer(int(us[0]), first=True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        t = self.times
        t.load()
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        upto = now // self.slot_ms * self.slot_ms * 1000  # the slots that end until now
        before = np.cumsum([0, *t.sizes])
        held, end, rest = {}, None, None  # the pages at the spans' starts, the last decided and the first undecided time
        for at in range(len(t.names)):
            if at + 1 < len(t.names) and t.lows[at + 1] < t.decided:
                continue
            if t.lows[at] >= upto:
                rest = t.lows[at]
                break
            page = t.page(at)
            due = page[np.searchsorted(page, t.decided): np.searchsorted(page, upto)]
            if len(due):
                low = due - self.length_us
                place = np.maximum(np.searchsorted(t.lows, low, "right") - 1, 0)
                counts = before[at] + np.searchsorted(page, due, "right")
                for p in np.unique(place).tolist():
                    if p not in held:
                        held = {p: page if p == at else t.page(p)}
                    of = place == p
                    counts[of] -= before[p] + np.searchsorted(held[p], low[of], "right")
                end = int(due[-1])
                over = counts > self.most
                if over.any():
                    yield pd.DataFrame({self.user: key[0], "us": due[over], "requests": counts[over]})
            if len(page) and page[-1] >= upto:
                rest = int(page[np.searchsorted(page, upto)])
                break
        t.decided = max(t.decided, upto)
        t.drop_before(t.decided - self.length_us)
        t.due = -1
        if rest is not None:
            self._timer(rest)
        elif t.names:  # when the last time leaves every window
            self._timer((end if end is not None else t.decided) + self.length_us)
        t.save()


def stream_rate_violations(requests: DataFrame, most: int = 10, seconds: int = 60, ts: str = "ts", user: str = "username",
                           watermark: str = WATERMARK, slot_seconds: int = 1) -> DataFrame:
    """(user, ts, requests): requests whose user made more than ``most`` in the ``seconds`` up to them.

    The exact trailing rule of ``rate_violations``: the span is open at its start, and a request is counted once the watermark
    has passed its slot, so triggers in any order within the watermark's delay give the same rows. ``slot_seconds`` divides
    ``seconds``. Null times are left out; null users are one user."""
    if seconds % slot_seconds:
        raise ValueError("slot_seconds must divide seconds")
    use_rocksdb(requests.sparkSession)
    # Keys travel as text: numbers would become doubles beside nulls.
    rows = (requests.select(F.col(user).cast("string").alias(user), F.col(ts).cast("timestamp").alias("event_at")).withWatermark("event_at", watermark)
            .withColumn("event_us", F.unix_micros("event_at")))
    out = rows.groupBy(user).transformWithStateInPandas(
        _TrailingCounts(user, most, seconds * 1_000_000, slot_seconds * 1000),
        f"`{user}` string, us long, requests long", "Append", "EventTime")
    return out.select(F.col(user).cast(requests.schema[user].dataType).alias(user), F.timestamp_micros("us").alias(ts), "requests")


class _Expire(StatefulProcessor):
    """A key's versions as runs (first, last) in which each renews the one before; runs are further apart than the lifetime, so
    there are few however many the versions. One timer is set, for the run that ends first."""

    def __init__(self, keys: Sequence[str], ttl_us: int):
        self.keys, self.ttl_us = list(keys), ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getValueState("runs", "firsts array<long>, lasts array<long>")

    def _load(self) -> tuple[np.ndarray, np.ndarray]:
        firsts, lasts = self.runs.get() if self.runs.exists() else ([], [])
        return np.array(firsts, np.int64), np.array(lasts, np.int64)

    def _due(self, last: int) -> int:
        return (int(last) + self.ttl_us) // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        firsts, lasts = self._load()
        set_for = self._due(lasts[0]) if len(lasts) else None
        for frame in rows:
            us = np.unique(frame["event_us"].dropna().to_numpy(np.int64))
            firsts, lasts = np.concatenate([firsts, us]), np.concatenate([lasts, us])
            order = np.argsort(firsts, kind="stable")
            firsts, lasts = firsts[order], np.maximum.accumulate(lasts[order])
            begins = np.flatnonzero(np.append(True, firsts[1:] > lasts[:-1] + self.ttl_us))[:len(firsts)]
            firsts, lasts = firsts[begins], lasts[np.append(begins[1:] - 1, len(lasts) - 1)[:len(begins)]]
        if len(lasts):
            self.runs.update((firsts.tolist(), lasts.tolist()))
            if set_for != self._due(lasts[0]):
                self.handle.registerTimer(self._due(lasts[0]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        firsts, lasts = self._load()
        over = int(np.searchsorted(lasts, now * 1000 - self.ttl_us))  # their ends lie before now
        if over == len(lasts):
            self.runs.clear()
        else:
            if over:
                self.runs.update((firsts[over:].tolist(), lasts[over:].tolist()))
            # Also when none is over: the run this timer was set for may have grown.
            self.handle.registerTimer(self._due(lasts[over]))
        if over:
            yield pd.DataFrame({**dict(zip(self.keys, key)), "us": lasts[:over]})


def stream_expirations(records: DataFrame, keys: Sequence[str], ttl_seconds: int, ts: str = "ts",
                       watermark: str = WATERMARK) -> DataFrame:
    """(keys, ts, expired_at): every time a key's newest record outlives ``ttl_seconds`` without a newer one renewing it.

    A key expires by event time: when the watermark passes the end of its lifetime, also if no further row of it ever
    comes. A record at the very end of a lifetime still renews the key. Rows older than the watermark are discarded; null times
    are left out. State holds the spans of records that renew each other, and goes with the expiry."""
    use_rocksdb(records.sparkSession)
    rows = (records.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col(ts).cast("timestamp").alias("event_at")).withWatermark("event_at", watermark)
            .withColumn("event_us", F.unix_micros("event_at")))
    kinds = "".join(f"`{k}` string, " for k in keys)
    out = rows.groupBy(*keys).transformWithStateInPandas(
        _Expire(keys, ttl_seconds * 1_000_000), f"{kinds}us long", "Append", "EventTime")
    named = [F.col(k).cast(records.schema[k].dataType).alias(k) for k in keys]
    return out.select(*named, F.timestamp_micros("us").alias(ts),
                      F.timestamp_micros(F.col("us") + ttl_seconds * 1_000_000).alias("expired_at"))
