"""Streams: counts by the hour, a sliding-window limiter, and notifications sent once."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def hourly_counts(events: DataFrame, time: str, *keys: str, late: str | None = None) -> DataFrame:
    """(start, keys, n) by hour; for a stream, with a watermark of `late`."""
    timed = events.withWatermark(time, late) if late else events
    return timed.groupBy(F.window(time, "1 hour").alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def window_loads(events: DataFrame, key: str, time: str, seconds: int) -> DataFrame:
    """events with load, how many of the key's events fell into the window that ends with each: what a limiter would see if it refused none."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    window = Window.partitionBy(key).orderBy(at).rangeBetween(-seconds * 1_000_000 + 1, Window.currentRow)
    return events.withColumn("load", F.count("*").over(window))


def admit(times: list[int], accepted: list[int], limit: int, span: int) -> tuple[list[tuple[bool, int]], list[int]]:
    """For times in order: whether each is let through and, if not, for how long to wait; and the accepted times still in the window. What is refused uses no quota."""
    recent, out = deque(accepted), []
    for now in times:
        while recent and recent[0] <= now - span:
            recent.popleft()
        if len(recent) < limit:
            recent.append(now)
            out.append((True, 0))
        else:
            out.append((False, recent[0] + span - now))
    return out, list(recent)


LIMITED = "key string, at long, allowed boolean, retry_after long"


def limited(events: DataFrame, key: str, time: str, limit: int, seconds: int) -> DataFrame:
    """(key, at, allowed, retry_after) in microseconds. Each key's events pass in order through a state of at most `limit` times, batch by batch, so a busy key needs no memory of its own; a key is one sequence by its meaning. On a stream the state of a key goes when it has been silent for two windows."""
    source = events.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(time).cast("timestamp")).alias("at"))
    if not events.isStreaming:
        ordered = source.repartition("key").sortWithinPartitions("key", "at")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now, recent = None, []
            for batch in batches:
                for k, part in batch.groupby("key", sort=False):
                    if k != now:
                        now, recent = k, []
                    verdicts, recent = admit(part["at"].tolist(), recent, limit, seconds * 1_000_000)
                    yield pd.DataFrame({"key": k, "at": part["at"].to_numpy(), "allowed": [v[0] for v in verdicts], "retry_after": [v[1] for v in verdicts]})

        return ordered.filter("key IS NOT NULL").mapInPandas(run, LIMITED)

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        times = sorted(t for part in parts for t in part["at"].tolist())
        verdicts, recent = admit(times, recent, limit, seconds * 1_000_000)
        state.update((recent,))
        state.setTimeoutDuration(2000 * seconds)
        yield pd.DataFrame({"key": group[0], "at": times, "allowed": [v[0] for v in verdicts], "retry_after": [v[1] for v in verdicts]})

    return source.groupBy("key").applyInPandasWithState(step, LIMITED, "recent array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def sent_once(notes: DataFrame, recipient: str, key: str, time: str, muted: DataFrame, late: str = "1 day") -> DataFrame:
    """Notifications that are not muted, the first of each (recipient, key); on a stream those within `late` of each other."""
    heard = notes.join(muted, [recipient], "left_anti")
    if notes.isStreaming:
        return heard.withWatermark(time, late).dropDuplicatesWithinWatermark([recipient, key])
    first = F.row_number().over(Window.partitionBy(recipient, key).orderBy(time))
    return heard.withColumn("_n", first).filter("_n = 1").drop("_n")


#: Events let through in a minute and in a day.
MINUTE, DAY = (3, 60), (50, 86_400)
DECIDED = "key string, at timestamp, allowed boolean"


def decide(times: list[int], accepted: list[int], windows: tuple[tuple[int, int], ...]) -> tuple[list[bool], list[int]]:
    """For times (microseconds) in order, whether each is let through: if every window (limit, seconds) that ends with it, its start included, holds fewer accepted ones. What is refused uses no quota. And the accepted times that the longest window may still hold."""
    longest, out = max(s for _, s in windows) * 1_000_000, []
    accepted = list(accepted)
    for now in times:
        accepted = [t for t in accepted if t >= now - longest]
        allowed = all(sum(t >= now - seconds * 1_000_000 for t in accepted) < limit for limit, seconds in windows)
        if allowed:
            accepted.append(now)
        out.append(allowed)
    return out, accepted


class TwoWindows(StatefulProcessor):
    """Each key's events in the order of their own time, whatever order they come in: they wait until the watermark has passed them, a timer on event time decides them, and only accepted times stay, at most the day's limit. Events later than the watermark are dropped by Spark before they come here."""

    def __init__(self, windows: tuple[tuple[int, int], ...]):
        self.windows = windows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long")
        self.accepted = handle.getListState("accepted", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        times = [(int(t),) for part in rows for t in part["at"]]
        self.waiting.appendList(times)
        for at in {t // 1000 for (t,) in times}:
            self.handle.registerTimer(at)  # fires once the watermark is beyond
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until = expiredTimerInfo.getExpiryTimeInMs()
        every = sorted(t for (t,) in self.waiting.get()) if self.waiting.exists() else []
        due, later = [t for t in every if t // 1000 <= until], [(t,) for t in every if t // 1000 > until]
        if due:
            allowed, accepted = decide(due, [t for (t,) in self.accepted.get()] if self.accepted.exists() else [], self.windows)
            self.waiting.put(later) if later else self.waiting.clear()
            self.accepted.put([(t,) for t in accepted]) if accepted else self.accepted.clear()
            yield pd.DataFrame({"key": key[0], "at": pd.to_datetime(due, unit="us"), "allowed": allowed})

    def close(self) -> None:
        pass


def limited_by_windows(events: DataFrame, key: str, time: str, late: str = "1 minute", windows: tuple[tuple[int, int], ...] = (MINUTE, DAY)) -> DataFrame:
    """(key, at, allowed) of events under several limits at once (by default three a minute and fifty a day), by event time. Null keys and times are left out.

    A batch passes each key's events in order through the accepted times, at most the largest limit of them. A stream gives the same rows for events that come out of order by at most `late`; those beyond it are dropped. An event is decided once the watermark has passed it. A stream needs the RocksDB state store.
    """
    source = events.select(F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("time"), F.unix_micros(F.col(time).cast("timestamp")).alias("at")).filter("key IS NOT NULL AND at IS NOT NULL")
    if events.isStreaming:
        held = source.withWatermark("time", late).groupBy("key")
        return held.transformWithStateInPandas(TwoWindows(windows), DECIDED, "append", "eventTime")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, accepted = None, []
        for batch in batches:
            for k, part in batch.groupby("key", sort=False):
                if k != now:
                    now, accepted = k, []
                allowed, accepted = decide(part["at"].tolist(), accepted, windows)
                yield pd.DataFrame({"key": k, "at": pd.to_datetime(part["at"].to_numpy(), unit="us"), "allowed": allowed})

    return source.select("key", "at").repartition("key").sortWithinPartitions("key", "at").mapInPandas(run, DECIDED)
