"""Streamed answers restored as they arrive: one stateful stream for each session.

A session's rows are its issued placeholders, pieces of its channels, snapshots of a channel and
the end. Everything that must be remembered is keyed state: the session's mapping, the text that
each channel holds back because a placeholder may still be growing there, and rows that came
before an earlier one. The end goes to all channels; a timer ends sessions that fell silent.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .channels import CAP, Waiting, release

#: Rows of a session's stream, in the order of seq (0, 1, …).
INPUT = "sid string, seq long, kind string, channel string, delta string, token string, value string, ts timestamp"
OUTPUT = "sid string, seq long, channel string, text string, final boolean"
ISSUE, DELTA, SNAPSHOT, FINAL, END = "issue", "delta", "snapshot", "final", "end"
PLACEHOLDER = re.compile("\\{\\{[A-Z0-9一-鿿]{1,12}_(?:[0-9a-f]{6}|[bcdfghjkmnpqrstvwxz]{6})\\}\\}")
#: Names of the settings that keep the state; the default store of Spark cannot hold several states for a key.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


_OUT = Row("sid", "seq", "channel", "text", "final")
#: What a row is about: it goes to Python as one column, each of which costs more than the row's handling.
_ABOUT = ("kind", "channel", "delta", "token", "value")


class Restoration(StatefulProcessor):
    """State of a session: known (token -> value), held (channel -> text), waiting (rows in blocks), at (next seq, timer, what waits, whether text is held)."""

    def __init__(self, cap: int, idle_ms: int | None, ttl_ms: int | None, event_time: bool):
        self.cap, self.idle_ms, self.ttl_ms, self.event_time = cap, idle_ms, ttl_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getMapState("known", "token string", "value string", self.ttl_ms)
        self.held = handle.getMapState("held", "channel string", "text string", self.ttl_ms)
        self.waiting = handle.getMapState("waiting", "block long", "rows string", self.ttl_ms)
        self.at = handle.getValueState("at", "following long, timer long, blocks array<long>, near string, holds boolean", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        following, timer, blocks, near, holds = self.at.get() or (0, None, (), "", False)
        arrived: dict[int, str] = {}
        latest = 0
        for _, seq, about, *time in rows:
            if seq >= following:
                arrived.setdefault(seq, about)
            if time and time[0] is not None and time[0] > latest:
                latest = time[0]
        session = _Session(self, key[0], holds)
        waiting = Waiting(self.waiting, blocks, near)
        ended = False
        while not ended:
            row = arrived.pop(following, None) or waiting.get(following)
            if row is None:
                break
            ended = session.take(following, *json.loads(row))
            following += 1
        self._timer(timer, None)
        if ended:
            self._clear()
        else:
            blocks, near = waiting.store(arrived, following)  # an earlier row is still missing
            holds = session.store()
            now = latest if self.event_time else timerValues.getCurrentProcessingTimeInMs()
            timer = now + self.idle_ms if self.idle_ms else None
            self._timer(None, timer)
            self.at.update((following, timer, blocks, near, holds))
        yield from session.out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """The session was silent for too long: rows that wait go on in their order, then all channels end."""
        following, _, blocks, near, holds = self.at.get() or (0, None, (), "", False)
        session = _Session(self, key[0], holds)
        for seq, row in Waiting(self.waiting, blocks, near).rows():
            if seq < following:  # came once more after it was handled
                continue
            following = seq + 1
            if session.take(seq, *json.loads(row)):
                break
        else:
            session.end(following)
        self._clear()
        yield from session.out

    def _timer(self, old: int | None, new: int | None) -> None:
        if old is not None:
            self.handle.deleteTimer(old)
        if new is not None:
            self.handle.registerTimer(new)

    def _clear(self) -> None:
        for state in (self.known, self.held, self.waiting, self.at):
            state.clear()

    def close(self) -> None:
        pass


class _Session:
    """What one call does with a session: its state is read when first needed and written back once."""

    def __init__(self, of: Restoration, sid: str, holds: bool):
        self.of, self.sid, self.holds = of, sid, holds
        self.values: dict[str, str | None] = {}
        self.texts: dict[str, str] = {}
        self.kept: dict[str, str] | None = None
        self.out: list[Row] = []

    def _held(self) -> dict[str, str]:
        if self.kept is None:
            self.kept = {k[0]: v[0] for k, v in self.of.held.iterator()} if self.holds else {}
            self.texts = dict(self.kept)
        return self.texts

    def _value(self, token: str) -> str:
        if token not in self.values:
            found = self.of.known.getValue((token,))
            self.values[token] = found[0] if found else None
        found = self.values[token]
        return token if found is None else found

    def _restored(self, text: str) -> str:
        return PLACEHOLDER.sub(lambda m: self._value(m.group()), text)

    def take(self, seq: int, kind: str, channel: str | None, delta: str | None, token: str | None, value: str | None) -> bool:
        """Handles one row; whether it was the session's end."""
        if kind == ISSUE:
            if token is not None and value is not None:
                self.of.known.updateValue((token,), (value,))
                self.values[token] = value
            return False
        if kind == END:
            self.end(seq)
            return True
        held, channel = self._held(), channel or ""
        if kind == SNAPSHOT:  # the channel's whole text once more: what it held back is in it
            held.pop(channel, None)
            self.out.append(_OUT(self.sid, seq, channel, self._restored(delta or ""), False))
            return False
        text, rest = release(held.pop(channel, ""), delta or "", kind == FINAL, self.of.cap)
        if rest:
            held[channel] = rest
        if text or kind == FINAL:
            self.out.append(_OUT(self.sid, seq, channel, self._restored(text), kind == FINAL))
        return False

    def end(self, seq: int) -> None:
        """What channels still hold goes on as it is."""
        held = self._held()
        self.out += [_OUT(self.sid, seq, channel, self._restored(held[channel]), True) for channel in sorted(held)]
        held.clear()

    def store(self) -> bool:
        """Whether any channel holds text."""
        if self.kept is None:
            return self.holds
        for channel in self.kept.keys() - self.texts.keys():
            self.of.held.removeKey((channel,))
        for channel, text in self.texts.items():
            if self.kept.get(channel) != text:
                self.of.held.updateValue((channel,), (text,))
        return bool(self.texts)


def restored(rows: DataFrame, cap: int = CAP, idle_seconds: int | None = None, ttl_seconds: int | None = None, late: str | None = None) -> DataFrame:
    """Stream (sid, seq, channel, text, final) of restored pieces, from a stream of INPUT rows.

    Rows of a session are handled in the order of seq (0, 1, …), whenever they arrive; repeated
    ones count once. kinds: issue (token and value are known from here on), delta and final (a
    channel's next and last piece), snapshot (a channel's whole text again, which clears only
    what that channel holds) and end (all channels end, the state goes). A channel holds back
    what may be the beginning of a placeholder, at most `cap` characters, and nothing at its end.
    idle_seconds: sessions silent for so long end as they are, with their gaps; the time is that
    of ts if `late` (a watermark's delay) is given, else the clock. ttl_seconds: also without a
    timer nothing stays longer than this after its last change (by the clock only, as Spark has it).
    Null deltas are empty; rows with a null sid are one session.
    """
    if late is not None and ttl_seconds is not None:
        raise ValueError("a time to live needs the clock; with event time use idle_seconds")
    rows.sparkSession.conf.set(PROVIDER, ROCKS)
    given = rows.withWatermark("ts", late) if late is not None else rows
    given = given.select("sid", "seq", F.to_json(F.array(*_ABOUT)).alias("about"), *([F.unix_millis("ts").alias("ms"), "ts"] if late is not None else []))
    mode = "eventTime" if late is not None else "processingTime" if idle_seconds or ttl_seconds else "none"
    processor = Restoration(cap, idle_seconds and idle_seconds * 1000, ttl_seconds and ttl_seconds * 1000, late is not None)
    return given.groupBy("sid").transformWithState(processor, OUTPUT, "append", mode)


def chunked(text: Column, size: Column) -> Column:
    """array<string>: the text cut into pieces of `size` characters."""
    some = F.regexp_extract_all(text, F.concat(F.lit("(?s).{1,"), size.cast("string"), F.lit("}")), F.lit(0))  # substr() would go through the text again for each piece
    return F.coalesce(some, F.array().cast("array<string>"))


def session_rows(answers: DataFrame, size: Column) -> DataFrame:
    """INPUT rows of sessions, from (sid, ts, channels array<struct<channel, text>>, issued array<struct<token, value>>).

    First the mapping, then the channels' pieces of `size` characters dealt in turn, then the end,
    which is the only thing that ends a channel.
    """
    none = lambda c: F.lit(None).cast("string").alias(c)
    issue = F.transform("issued", lambda x: F.struct(F.lit(-1).alias("n"), F.lit("").alias("channel"), F.lit(ISSUE).alias("kind"), none("delta"), x["token"].alias("token"), x["value"].alias("value")))
    pieces = F.flatten(F.transform("channels", lambda c: F.transform(
        chunked(c["text"], size),
        lambda p, i: F.struct(i.alias("n"), c["channel"].alias("channel"), F.lit(DELTA).alias("kind"), p.alias("delta"), none("token"), none("value")),
    )))
    end = F.array(F.struct(F.lit(2**31 - 1).alias("n"), F.lit("").alias("channel"), F.lit(END).alias("kind"), none("delta"), none("token"), none("value")))
    each = answers.select("sid", "ts", F.posexplode(F.array_sort(F.concat(issue, pieces, end))).alias("seq", "r"))
    return each.select("sid", F.col("seq").cast("long").alias("seq"), "r.kind", "r.channel", "r.delta", "r.token", "r.value", "ts")
