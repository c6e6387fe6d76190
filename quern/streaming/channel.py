"""The ordered event channel of streamed answers.

Pieces of many answers arrive in any order and in any micro-batch.  Per request, state holds
the number of the next piece, the text that redaction still needs, its timer and, in one value,
the pieces that came too early; a timer ends requests that have fallen silent.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from quern.streaming.redaction import released

#: What a piece has: its number from 0, its text, whether it is the last or the generator
#: failed at it, and, with the last, the sources and the entities found in the question.
PIECE = "request_id string, seq long, piece string, is_last boolean, failed boolean, sources array<string>, entities array<string>, ts timestamp"
EVENT = "request_id string, n long, type string, text string, event string"
#: Seconds without a piece after which a request is ended.
IDLE_SECONDS = 120
FAILED, TIMED_OUT = "generation failed", "generation timed out"
_JSON = json.JSONEncoder(ensure_ascii=False).encode


def _together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for the pieces of a request and time that lie together, as JSON: the channel's
    cost is by rows, not by text.  Rows without seq have no piece."""
    names = lambda x: "[]" if x is None else json.dumps([str(v) for v in x])
    for batch in batches:
        groups: dict[tuple, list] = {}
        for request, seq, piece, last, failed, sources, entities, ts in zip(*(batch[c].tolist() for c in batch.columns), strict=True):
            group = groups.setdefault((request, ts), [])
            if not pd.isna(seq):
                group.append((int(seq), piece or "", bool(last), bool(failed), names(sources), names(entities)))
        yield pd.DataFrame([(request, json.dumps(group), ts) for (request, ts), group in groups.items()], columns=["request_id", "pieces", "ts"])


class _Channel(StatefulProcessor):
    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next long, sent long, held string, told int, entities string, ended boolean, timer long, early string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came, latest = {}, None
        for batch in rows:
            came.update((seq, rest) for told in batch["pieces"] for seq, *rest in json.loads(told))
            latest = batch["ts"].max() if latest is None else max(latest, batch["ts"].max())
        if not came:
            return
        next_, sent, held, told, found, ended, timer, early = self.place.get() or (0, 0, "", 0, "[]", False, None, "[]")
        timer = self._wait(timer, max(int(latest.timestamp() * 1000), timerValues.getCurrentWatermarkInMs()))
        if ended:
            self.place.update((next_, sent, "", 0, found, True, timer, "[]"))
            return
        waiting = {seq: rest for seq, *rest in json.loads(early)}
        waiting.update((seq, rest) for seq, rest in came.items() if seq >= next_)
        out, entities = [], set(json.loads(found))
        while next_ in waiting and not ended:
            piece, last, failed, sources, asked = waiting.pop(next_)
            next_ += 1
            if failed:
                out.append({"type": "error", "message": FAILED})
                ended = True
                break
            text, more, held, told = released(held, told, piece, last)
            entities.update(more)
            if text:
                out.append(text)
            if last:
                out.append({"type": "done", "sources": json.loads(sources), "pii_redacted": sorted(entities | {*json.loads(asked)})})
                ended = True
        kept = [] if ended else [(seq, *rest) for seq, rest in sorted(waiting.items())]
        self.place.update((next_, sent + len(out), "" if ended else held, 0 if ended else told, json.dumps(sorted(entities)), ended, timer, json.dumps(kept)))
        yield self._events(key, sent, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, sent, held, told, _, ended, _, _ = self.place.get()
        self.place.clear()
        if not ended:
            text = released(held, told, "", True)[0]
            yield self._events(key, sent, [text] * bool(text) + [{"type": "error", "message": TIMED_OUT}])

    def _wait(self, timer: int | None, now_ms: int) -> int:
        """The timer of the request, which there is one of, set anew."""
        if timer != now_ms + self.idle_ms:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(now_ms + self.idle_ms)
        return now_ms + self.idle_ms

    def _events(self, key, sent: int, out: list[str | dict]) -> pd.DataFrame:
        """Rows of texts, which are tokens, and of other events."""
        told = [("token", e, f'{{"type": "token", "text": {_JSON(e)}}}') if isinstance(e, str) else (e["type"], None, _JSON(e)) for e in out]
        rows = [(key[0], sent + i, *e) for i, e in enumerate(told)]
        return pd.DataFrame(rows, columns=["request_id", "n", "type", "text", "event"])

    def close(self) -> None:
        pass


def answer_channel(pieces: DataFrame, idle_seconds: int = IDLE_SECONDS, late: str = "0 seconds") -> DataFrame:
    """request_id, n, type, text, event: the events of every request, numbered from 0.

    pieces is a stream as PIECE says.  Pieces are taken in order of seq, whatever micro-batch
    they come in; one that comes twice counts once.  Text is redacted as it goes out (see
    released()).  The last piece ends a request with its sources and with the entities of
    question and answer, a failed one with an error, and none of the held text.  After
    idle_seconds of event time without a piece, what is in order is told to its end and an
    error follows; pieces behind a gap are not told.  What comes after the end is dropped
    while the end is remembered, which is idle_seconds more.  Rows without seq only tell
    the time.
    """
    held = pieces.select("request_id", "seq", "piece", "is_last", "failed", "sources", "entities", F.unix_micros("ts").alias("ts"))
    held = held.mapInPandas(_together, "request_id string, pieces string, ts long").withColumn("ts", F.timestamp_micros("ts"))
    return held.withWatermark("ts", late).groupBy("request_id").transformWithStateInPandas(_Channel(1000 * idle_seconds), EVENT, "Append", "EventTime")


def sse(events: DataFrame) -> DataFrame:
    """The events as lines of a text/event-stream."""
    return events.select("request_id", "n", F.concat(F.lit("data: "), F.col("event"), F.lit("\n\n")).alias("line"))
