"""Streams that keep a state for each key: the export of an account step by step, and stories told once.

Both are functions of event time alone: rows of a batch are taken by their time, and what a timer does has the time that
the timer was set for, so batches may be cut anywhere and a run may go on from its checkpoint. They need the RocksDB
state store: `use_state_store` sets it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerwell.streaming.events import LATE

HOUR = 3_600_000
#: An export that isn't listed is lost after so long; states of a report that end it; asked for so often.
LOST_HOURS, ENDED, FINISHED, CADENCE_HOURS = 6, ("Failed", "Canceled"), "Finished", 24
STEPS = "account_id string, at timestamp, action string"


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _millis(times: pd.Series) -> list[int]:
    return (times.astype("datetime64[us]").astype("int64") // 1000).tolist()


class ExportSteps(StatefulProcessor):
    """At each step one thing happens: a pending report is collected, or a new one is asked for when one is due.

    A report that no step has found listed is lost LOST_HOURS after it was asked for, at that moment. A later step that
    no longer finds a report that was listed calls it failed too once it is older than that.
    """

    def __init__(self, cadence_hours: int = CADENCE_HOURS, lost_hours: int = LOST_HOURS):
        self.cadence, self.lost = cadence_hours * HOUR, lost_hours * HOUR

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.export = handle.getValueState("export", "requested long, pending boolean, listed boolean")

    def _step(self, state: tuple | None, at: int, status: str | None, link: bool) -> tuple[tuple, str]:
        if state is not None and state[1]:
            requested, _, listed = state
            if status is None:
                return ((requested, False, listed), "failed") if at - requested > self.lost else (state, "waiting")
            if status in ENDED:
                return (requested, False, True), "failed"
            if status != FINISHED or not link:
                return (requested, True, True), "waiting"
            return (requested, False, True), "downloaded"
        if state is not None and at - state[0] < self.cadence:
            return state, "up_to_date"
        return (at, True, False), "requested"

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows))
        steps = sorted(zip(_millis(table["at"]), [None if pd.isna(s) else s for s in table["status"]], table["has_link"].fillna(False).tolist(), strict=True), key=lambda s: (s[0], s[1] or "", s[2]))
        before = state = self.export.get() if self.export.exists() else None
        out = []
        for at, status, link in steps:
            if state is not None and state[1] and not state[2] and at > state[0] + self.lost:
                out.append((state[0] + self.lost, "lost"))
                state = (state[0], False, False)
            state, action = self._step(state, at, status, link)
            out.append((at, action))
        if before is not None and before[1]:
            self.handle.deleteTimer(before[0] + self.lost + 1)
        if state[1] and not state[2]:
            self.handle.registerTimer(state[0] + self.lost + 1)
        self.export.update(state)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.export.get() if self.export.exists() else None
        if state is None or not state[1] or state[2]:
            return
        self.export.update((state[0], False, False))
        yield self._rows(key, [(state[0] + self.lost, "lost")])

    @staticmethod
    def _rows(key, out: list[tuple[int, str]]) -> pd.DataFrame:
        return pd.DataFrame({"account_id": [key[0]] * len(out), "at": pd.to_datetime([a for a, _ in out], unit="ms"), "action": [a for _, a in out]})

    def close(self) -> None:
        pass


def export_steps(steps: DataFrame, late: str = LATE, **how: int) -> DataFrame:
    """(account_id, at, action) of a stream of steps(account_id, at, status, has_link).

    `status` is how the provider lists the account's pending report at that moment, null if it doesn't; actions are
    requested, waiting, downloaded, failed, lost and up_to_date.
    """
    use_state_store(steps.sparkSession)
    rows = steps.select(F.col("account_id").cast("string").alias("account_id"), "at", "status", F.coalesce("has_link", F.lit(False)).alias("has_link")).withWatermark("at", late)
    return rows.groupBy("account_id").transformWithStateInPandas(ExportSteps(**how), STEPS, "Append", "EventTime")


STORY = "item_id long, title string, ts timestamp, fetched_at timestamp"


class StoriesOnce(StatefulProcessor):
    """Of items with one title within the window the first passes; an undated one is in conflict with all still known.

    What is known of a title ends once the watermark is beyond the window of its last item.
    """

    def __init__(self, window_hours: int = 48):
        self.window = window_hours * HOUR

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "times array<long>, undated long, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows))
        at, dated = _millis(table["at"]), table["ts"].notna().tolist()
        order = sorted(range(len(at)), key=lambda i: (at[i], int(table["item_id"].iloc[i])))
        times, undated, timer = self.known.get() if self.known.exists() else ([], None, None)
        times, kept = list(times), []
        for i in order:
            if key[0] != "":
                if undated is not None or (times and not dated[i]) or any(abs(t - at[i]) <= self.window for t in times):
                    continue
                if dated[i]:
                    times.append(at[i])
                else:
                    undated = at[i]
            kept.append(i)
        if times or undated is not None:
            ends = max([*times, *([] if undated is None else [undated])]) + self.window + 1
            if timer != ends:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(ends)
            mark = timerValues.getCurrentWatermarkInMs()
            self.known.update(([t for t in times if t + self.window >= mark], undated, ends))
        yield table.iloc[kept][["item_id", "title", "ts", "fetched_at"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.known.clear()
        return
        yield

    def close(self) -> None:
        pass


def stories_once(items: DataFrame, late: str = LATE, window_hours: int = 48) -> DataFrame:
    """(item_id, title, ts, fetched_at) of a stream of items(item_id, canonical, title, ts, fetched_at), each story once.

    Addresses are told apart for as long as the watermark allows, titles within the window. An item without a time
    counts at the time it was fetched; a null or blank title is in conflict with none.
    """
    use_state_store(items.sparkSession)
    at = items.withColumn("at", F.coalesce("ts", "fetched_at")).withColumn("canonical", F.coalesce("canonical", F.concat(F.lit("#"), F.col("item_id").cast("string")))).withColumn("title", F.coalesce("title", F.lit("")))
    once = at.withWatermark("at", late).dropDuplicatesWithinWatermark(["canonical"])
    return once.groupBy("title").transformWithStateInPandas(StoriesOnce(window_hours), STORY, "Append", "EventTime")
