"""Streams of answer pieces: redaction with held-back text, events, time to first text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.functions import pii
from quern.functions.text import ARABIC_DIGITS, DIGITS, PERSIAN_DIGITS

#: Fixed value: characters always held back, more than any realistic value has.
HOLD_BACK = 64
_OUT = "request_id string, seq long, text string, entities array<string>, is_last boolean"


def _finders() -> list[tuple[str, re.Pattern]]:
    return [(entity, re.compile(pattern.replace("(?iU)", "(?i)").replace("(?U)", ""))) for entity, pattern in pii.PATTERNS.items()]


_FINDERS = _finders()
#: No pattern fits a text without any of these.
_MAY = re.compile(r"[@\d]")
_WESTERN = str.maketrans(ARABIC_DIGITS + PERSIAN_DIGITS, DIGITS * 2)


def _luhn(number: str) -> bool:
    digits = [int(c) for c in reversed(number) if c.isdigit()]
    return sum(digits[::2] + [sum(divmod(2 * d, 10)) for d in digits[1::2]]) % 10 == 0


def found_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, entity) of pii.spans() for a text that is not in a column."""
    if not _MAY.search(text):
        return []
    plain, taken = text.translate(_WESTERN), []
    for entity, finder in _FINDERS:
        for m in finder.finditer(plain):
            clash = any(m.start() < end and start < m.end() for start, end, _ in taken)
            if not clash and (entity != "CREDIT_CARD" or _luhn(m[0])):
                taken.append((m.start(), m.end(), entity))
    return sorted(taken)


def released(held: str, told: int, piece: str, last: bool) -> tuple[str, list[str], str, int]:
    """(text to send, its entities, held, told) after one more piece of an answer.

    held is the raw text still needed, of which the first `told` characters are out already
    and only tell what stands before the rest.  The last HOLD_BACK characters wait for the
    end; a span across that place waits whole.  Values longer than HOLD_BACK can be seen in
    part, as in any bounded look-back.
    """
    text = held + piece
    spans = [s for s in found_spans(text) if s[0] >= told]
    stop = len(text) if last else max(told, len(text) - HOLD_BACK)
    stop = next((start for start, end, _ in spans if start < stop < end), stop)
    out, at, entities = "", told, set()
    for start, end, entity in spans:
        if end <= stop:
            out, at = out + text[at:start] + f"[{entity}]", end
            entities.add(entity)
    first = max(0, stop - HOLD_BACK)
    return out + text[at:stop], sorted(entities), text[first:], stop - first


def redact_stream(pieces: DataFrame) -> DataFrame:
    """Redacted text per piece of a stream (request_id, seq, piece, is_last).

    State per request is the text released() holds.  Pieces are put in order of seq within a
    micro-batch; across batches they must arrive in order (see channel.py where they do not).
    is_last releases the rest and ends the request.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, told = state.get if state.exists else ("", 0)
        rows, ended = [], False
        for r in pd.concat(list(frames)).sort_values("seq").itertuples():
            text, entities, held, told = released(held, told, r.piece or "", ended := bool(r.is_last))
            rows.append((key[0], int(r.seq), text, entities, ended))
        if ended:
            state.remove()
        else:
            state.update((held, told))
        yield pd.DataFrame(rows, columns=["request_id", "seq", "text", "entities", "is_last"])

    return pieces.groupBy("request_id").applyInPandasWithState(step, _OUT, "held string, told int", "append", GroupStateTimeout.NoTimeout)


def events(redacted: DataFrame) -> DataFrame:
    """request_id, seq and the event as JSON: token while there is text, then done."""
    token = F.when(F.col("text") != "", F.to_json(F.struct(F.lit("token").alias("type"), F.col("text"))))
    done = F.when(F.col("is_last"), F.to_json(F.struct(F.lit("done").alias("type"), F.col("entities"))))
    return redacted.select("request_id", "seq", F.explode(F.array_compact(F.array(token, done))).alias("event"))


def first_text(emitted: DataFrame, started: DataFrame) -> DataFrame:
    """Seconds from a request's start to its first text that is not empty (request_id, ts)."""
    first = emitted.filter("text <> ''").groupBy("request_id").agg(F.min("ts").alias("first"))
    return started.join(first, "request_id").select("request_id", (F.col("first").cast("double") - F.col("ts").cast("double")).alias("seconds"))
