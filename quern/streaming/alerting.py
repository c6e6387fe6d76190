"""Alerts to notifications: groups that wait, settle at intervals, repeat and resolve.

The rule is one function over a group's state and the changes up to a time; a stream keeps
that state and is woken by event-time timers, a table is settled at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Seconds before a group's first notification, between later ones, and until
#: an unchanged group is told again (critical alerts sooner).
GROUP_WAIT, GROUP_INTERVAL, REPEAT, REPEAT_CRITICAL = 10, 60, 14_400, 3_600
NOTIFICATION = "route string, alertname string, told_at timestamp, status string, firing array<string>, resolved array<string>"


@dataclass
class Group:
    """One group: what fires, what the last notification said fires, the place of its grid of
    intervals (None while nothing is active), when it was last told, and changes to come."""

    firing: set = field(default_factory=set)
    gone: set = field(default_factory=set)
    told: set = field(default_factory=set)
    grid: int | None = None
    last: int | None = None
    coming: list = field(default_factory=list)  # (second, instance, fires)

    def due(self, repeat: int) -> int | None:
        """The second at which the group has next something to say or to look at."""
        first = min(self.coming)[0] if self.coming else None
        if self.grid is None:
            return None if first is None else first + GROUP_WAIT
        at = [first] if first is not None else []
        if self.told and self.last is not None:
            at.append(self.last + repeat)
        if not at:
            return None
        return self.grid + -(-max(0, min(at) - self.grid) // GROUP_INTERVAL) * GROUP_INTERVAL

    def settle(self, upto: int, repeat: int) -> Iterator[tuple[int, list[str], list[str]]]:
        """(second, firing, resolved) of the notifications up to a second."""
        while (now := self.due(repeat)) is not None and now <= upto:
            ripe = sorted(c for c in self.coming if c[0] <= now)
            self.coming = [c for c in self.coming if c[0] > now]
            for _, instance, fires in ripe:
                if fires:
                    self.firing.add(instance)
                    self.gone.discard(instance)
                elif instance in self.firing:
                    self.firing.discard(instance)
                    self.gone.add(instance)
            resolved = self.gone & self.told
            again = bool(self.firing) and self.last is not None and now - self.last >= repeat and bool(self.told)
            self.grid, self.gone = now, set()
            if self.firing - self.told or resolved or again:
                yield now, sorted(self.firing), sorted(resolved)
                self.told, self.last = set(self.firing), now
            if not self.firing:
                self.grid, self.last, self.told = None, None, set()


class _Grouping(StatefulProcessor):
    def __init__(self, repeats: dict[str, int]):
        self.repeats = repeats

    def init(self, handle) -> None:
        self.handle = handle
        self.alerts = handle.getMapState("alerts", "instance string", "firing boolean, told boolean, gone boolean")
        self.times = handle.getValueState("times", "grid long, last long")
        self.coming = handle.getListState("coming", "at long, instance string, firing boolean")

    def _group(self) -> Group:
        group = Group()
        if self.times.exists():
            group.grid, group.last = self.times.get()
        for (name,), (firing, told, gone) in self.alerts.iterator() if self.alerts.exists() else ():
            for held, into in ((firing, group.firing), (told, group.told), (gone, group.gone)):
                if held:
                    into.add(name)
        group.coming = [tuple(c) for c in self.coming.get()] if self.coming.exists() else []
        return group

    def _settled(self, key, group: Group, now_ms: int) -> Iterator[pd.DataFrame]:
        repeat = self.repeats.get(key[0], REPEAT)
        rows = [(key[0], key[1], pd.Timestamp(at, unit="s"), "firing" if firing else "resolved", firing, resolved) for at, firing, resolved in group.settle(now_ms // 1000, repeat)]
        self.times.update((group.grid, group.last))
        self.alerts.clear()
        for name in group.firing | group.told | group.gone:
            self.alerts.updateValue((name,), (name in group.firing, name in group.told, name in group.gone))
        if group.coming:
            self.coming.put(group.coming)
        elif self.coming.exists():
            self.coming.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due = group.due(repeat)
        if due is not None:
            self.handle.registerTimer(1000 * due)
        if rows:
            yield pd.DataFrame(rows, columns=["route", "alertname", "told_at", "status", "firing", "resolved"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        group = self._group()
        for batch in rows:
            for r in batch[batch["instance"].notna()].itertuples():
                group.coming.append((int(r.ts.timestamp()), r.instance, bool(r.firing)))
        yield from self._settled(key, group, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settled(key, self._group(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def _routed(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("route", F.when(F.col("severity") == "critical", "critical").otherwise("default")).select("route", "alertname", "instance", (F.col("status") == "firing").alias("firing"), "ts")


def notifications(alerts: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Notifications of a stream of alerts (alertname, severity, instance, status, ts).

    Alerts of one name and route (critical or not) are a group.  The first is told GROUP_WAIT
    seconds later with what came meanwhile; changes are told at the next GROUP_INTERVAL, new
    and resolved alerts alike; an unchanged group that fires is told again after its repeat
    interval.  A group with nothing left to fire ends.  What fires and resolves before it is
    told is never told.  Alerts may come in any order within `late`; event time alone counts,
    so rows without an instance serve to tell the time.
    """
    timed = _routed(alerts).withWatermark("ts", late)
    return timed.groupBy("route", "alertname").transformWithStateInPandas(_Grouping({"critical": REPEAT_CRITICAL}), NOTIFICATION, "Append", "EventTime")


def settled(alerts: DataFrame, upto) -> DataFrame:
    """notifications() of a table up to a time (a timestamp column expression), a group a task."""
    end = alerts.select(upto.cast("timestamp").alias("upto")).limit(1)
    routed = _routed(alerts).filter("instance IS NOT NULL").join(end, F.lit(True))

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        group = Group(coming=[(int(t.timestamp()), i, bool(f)) for t, i, f in zip(rows["ts"], rows["instance"], rows["firing"], strict=True)])
        told = group.settle(int(rows["upto"].iloc[0].timestamp()), REPEAT_CRITICAL if key[0] == "critical" else REPEAT)
        out = [(*key, pd.Timestamp(at, unit="s"), "firing" if firing else "resolved", firing, resolved) for at, firing, resolved in told]
        return pd.DataFrame(out, columns=["route", "alertname", "told_at", "status", "firing", "resolved"])

    return routed.groupBy("route", "alertname").applyInPandas(one, NOTIFICATION)
