"""The task stream: progress, terminal states, deadlines and sessions, in batch form and as Structured Streaming state.

A task's events count in order of (ts, event_id). Its first terminal event is final; what comes later changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

c = F.col
TERMINAL = ("completed", "failed")


def in_order() -> WindowSpec:
    return Window.partitionBy("task_id").orderBy("ts", "event_id")


def progress(events: DataFrame) -> DataFrame:
    """Every event with its index, the task's total, and a progress that stays under 100 until a terminal event has come."""
    index, total = F.row_number().over(in_order()), F.count("*").over(Window.partitionBy("task_id"))
    done = F.max(c("task_status").isin(*TERMINAL).cast("int")).over(in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)) == 1
    rows = events.select("task_id", "event_id", "task_status", index.alias("index"), total.alias("total"), done.alias("done"))
    return rows.withColumn("progress", F.when(c("done"), 100).otherwise(F.least(F.lit(99), F.bround(c("index") / c("total") * 100, 0).cast("int"))))


def requested(requests: DataFrame, events: DataFrame, alias: str = "default") -> DataFrame:
    """The events that each request (request_id, asked) is to be shown: those of the task asked for, and for the alias those of the task that started last.

    A request for an unknown task gets two events, and the second ends its stream.
    """
    last = events.groupBy("task_id").agg(F.min("ts").alias("started_at")).agg(F.max_by("task_id", F.struct("started_at", "task_id")).alias("last")).withColumn("alias", F.lit(alias))
    named = requests.join(F.broadcast(last), c("asked") == c("alias"), "left")  # one row
    named = named.select("request_id", "asked", F.when(c("alias").isNotNull(), c("last")).otherwise(c("asked").try_cast("long")).alias("task_id"))
    found = named.join(progress(events), "task_id", "left")
    event = lambda index, total, done: F.struct(index.cast("int").alias("index"), total.cast("long").alias("total"), done.alias("done"))
    missing = F.array(*[event(F.lit(i), F.lit(2), F.lit(i == 2)) for i in (1, 2)])
    shown = F.explode(F.when(c("event_id").isNull(), missing).otherwise(F.array(event(c("index"), c("total"), c("done"))))).alias("e")
    return found.select("request_id", F.when(c("event_id").isNotNull(), c("task_id")).alias("task_id"), shown).select("request_id", "task_id", "e.index", "e.total", "e.done")


def terminal_state(events: DataFrame) -> DataFrame:
    """One row a task: its status (the first terminal one, else the latest), when it ended, and how many events came after."""
    order = F.struct("ts", "event_id")
    end = F.min(F.when(c("task_status").isin(*TERMINAL), F.struct("ts", "event_id", "task_status")))
    found = events.groupBy("task_id").agg(end.alias("end"), F.max_by("task_status", order).alias("latest"), F.min("ts").alias("started_at"), F.count("*").alias("n_events"))
    ends = found.where("end IS NOT NULL").select("task_id", "end")
    late = events.join(ends, "task_id").where((c("ts") > c("end.ts")) | ((c("ts") == c("end.ts")) & (c("event_id") > c("end.event_id")))).groupBy("task_id").agg(F.count("*").alias("late"))
    return found.join(late, "task_id", "left").select(
        "task_id", F.coalesce("end.task_status", "latest").alias("task_status"), "started_at", c("end.ts").alias("ended_at"), "n_events", F.coalesce("late", F.lit(0)).alias("n_ignored")
    )


def timeouts(events: DataFrame, seconds: int = 180) -> DataFrame:
    """Tasks against a deadline after their start: failed with 'timeout' unless a terminal event came in time."""
    state = terminal_state(events)
    deadline = c("started_at") + F.make_dt_interval(secs=F.lit(seconds))
    over = c("ended_at").isNull() | (c("ended_at") > deadline)
    return state.select("task_id", F.when(over, "failed").otherwise(c("task_status")).alias("task_status"), F.when(over, "timeout").alias("error"))


def sessions(events: DataFrame, gap_seconds: int = 86_400) -> DataFrame:
    """Runs of a task's events without a longer gap: an extension of the task model."""
    gap = c("ts").cast("timestamp") - F.lag("ts").over(in_order()) > F.make_dt_interval(secs=F.lit(gap_seconds))
    numbered = events.withColumn("new", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("session", F.sum("new").over(in_order()))
    return numbered.groupBy("task_id", "session").agg(F.count("*").alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


INFO = "started_ms long, shown int, ended boolean"
WAITING = "at_ms long, event_id long, task_status string"
LIVE = "task_id long, kind string, index int, total int, event_id long, at timestamp, task_status string, progress int, error string"


class TaskLine(StatefulProcessor):
    """One task's events in order of event time: they wait until the watermark has passed them, so no earlier one can come any more.

    State is a row of marks and the events that wait. What is left of a task that has ended is one row, by which later events are known
    and dropped; a timer removes it.
    """

    def __init__(self, seconds: int, total: int, keep_seconds: int) -> None:
        self.deadline_ms, self.total, self.keep_ms = 1000 * seconds, total, 1000 * keep_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.info = handle.getValueState("info", INFO)
        self.waiting = handle.getListState("waiting", WAITING)

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        came = [(int(ts.timestamp() * 1000), int(event), status) for part in rows for ts, event, status in zip(part["ts"], part["event_id"], part["task_status"], strict=True)]
        started, shown, ended = self.info.get() if self.info.exists() else (None, 0, False)
        if not ended:
            self.waiting.appendList(came)
            self.info.update((started, shown, ended))
            self._wake(min(at for at, *_ in came) + 1, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out: list[tuple] = []
        if self.info.exists():
            started, shown, ended = self.info.get()
            now = timerValues.getCurrentWatermarkInMs()
            if ended:
                self.info.clear()
            else:
                self._advance(int(key[0]), started, shown, now, out)
        yield pd.DataFrame(out, columns=["task_id", "kind", "index", "total", "event_id", "at", "task_status", "progress", "error"]).astype({"index": "Int32", "event_id": "Int64"}) if out else pd.DataFrame()

    def _advance(self, task: int, started: int | None, shown: int, now: int, out: list[tuple]) -> None:
        events = sorted(self.waiting.get())
        ready, later = [e for e in events if e[0] < now], [e for e in events if e[0] >= now]
        if started is None and ready:
            started = ready[0][0]
        deadline = started + self.deadline_ms if started is not None else None
        end = None
        for at, event, status in ready:
            if at > deadline:
                break
            shown += 1
            last = status in TERMINAL
            progress = 100 if last else min(99, round(shown / self.total * 100))
            out.append((task, "event", shown, self.total, event, pd.Timestamp(at, unit="ms"), status, progress, None))
            if last:
                end = (at, event, status, None)
                break
        if end is None and deadline is not None and deadline < now:
            end = (deadline, None, "failed", "timeout")
        if end is not None:
            at, event, status, error = end
            for kind in ("result", "done"):
                out.append((task, kind, shown, self.total, event, pd.Timestamp(at, unit="ms"), status, 100, error))
            self.waiting.clear()
            self.info.update((started, shown, True))
            self._wake(now + self.keep_ms, now)
            return
        self.waiting.put(later) if later else self.waiting.clear()
        self.info.update((started, shown, False))
        self._wake(min([at + 1 for at, *_ in later[:1]] + ([deadline + 1] if deadline is not None else [])), now)

    def _wake(self, at_ms: int, now: int) -> None:
        """One timer a task that is still to come: the earliest. Those up to now are expiring."""
        coming = [t for t in self.handle.listTimers() if t > now]
        if not coming or min(coming) > at_ms:
            for old in coming:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(at_ms)


def live_tasks(events: DataFrame, seconds: int = 180, lateness: str = "10 minutes", total: int = 14, keep_seconds: int = 3600) -> DataFrame:
    """A stream of tasks as their watchers see it, from a stream (task_id, event_id, ts, task_status): rows of kind event, in order of (ts, event_id) with index and progress, then result and done.

    An event counts once, whatever comes twice within the lateness; what comes later than that is dropped. The first terminal event is
    final and is the last event shown; a task without one fails with 'timeout' once event time has passed its deadline. progress stays
    under 100 until then. A task that has ended is remembered for keep_seconds of event time and then leaves the state.
    Times are kept in milliseconds. The session needs the RocksDB state store: spark.sql.streaming.stateStore.providerClass.
    """
    once = events.select("task_id", "event_id", "ts", "task_status").withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["task_id", "event_id"])
    return once.groupBy("task_id").transformWithStateInPandas(TaskLine(seconds, total, keep_seconds), LIVE, "Append", "EventTime")


def stream_windows(events: DataFrame, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Counts by status in event-time windows, for batch tables and for streams."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", window), "task_status").agg(F.count("*").alias("n")).select(c("window.start").alias("window_start"), "task_status", "n")
