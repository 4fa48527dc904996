"""Streamed answers: chunks per session and channel, put in order and cut only where no placeholder is split."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A possible beginning of a placeholder at the end of what has arrived.
PARTIAL = re.compile(r"\{(?:\{(?:[A-Z0-9\u4e00-\u9fff]{0,12}(?:_[0-9a-z]{0,6}\}?)?)?)?\Z")
#: Characters that a channel may hold back before it lets them go as they are.
CAP = 64


def release(pending: str, delta: str, final: bool, cap: int = CAP) -> tuple[str, str]:
    """(text that may go on, text to hold): nothing is held at the end, and never more than cap."""
    text = pending + delta
    held = None if final else PARTIAL.search(text)
    if held is None or len(text) - held.start() > cap:
        return text, ""
    return text[: held.start()], text[held.start() :]


def release_lines(pending: str, delta: str, final: bool, cap: int = 65_536) -> tuple[str, str]:
    """Whole lines may go on; a line longer than cap goes as it is."""
    text = pending + delta
    at = len(text) if final or len(text) - text.rfind("\n") - 1 > cap else text.rfind("\n") + 1
    return text[:at], text[at:]


def release_behind(pending: str, delta: str, final: bool, cap: int = CAP) -> tuple[str, str]:
    """The last cap characters wait, so that a command that is still being written is seen whole before it goes on."""
    text = pending + delta
    at = len(text) if final else max(0, len(text) - cap)
    return text[:at], text[at:]


#: Numbers whose rows wait in one entry, and rows that wait without one.
BLOCK = 128
Row = str | list | tuple


class Waiting:
    """Rows of a stream that came before an earlier one: seq -> row.

    A call to a state takes far longer than a row. So up to BLOCK rows stand as JSON in `near`, a
    text that the caller keeps with its own state; more of them in a map state (block long -> rows
    string), an entry for the rows of BLOCK numbers. `blocks` are those that have one.
    """

    def __init__(self, state, blocks: Iterable[int] = (), near: str = ""):
        self.state, self.stored = state, set(blocks)
        self.read: dict[int, dict[int, Row]] = {}
        for seq, row in json.loads(near) if near else ():
            self.read.setdefault(seq // BLOCK, {})[seq] = row

    def _rows(self, block: int) -> dict[int, Row]:
        if block not in self.read:
            found = self.state.getValue((block,)) if block in self.stored else None
            self.read[block] = dict(json.loads(found[0])) if found else {}
        return self.read[block]

    def get(self, seq: int) -> Row | None:
        block = seq // BLOCK
        return self._rows(block).get(seq) if block in self.read or block in self.stored else None

    def rows(self) -> list[tuple[int, Row]]:
        """All that wait, by number."""
        return sorted(r for b in self.stored | self.read.keys() for r in self._rows(b).items())

    def store(self, arrived: dict[int, Row], following: int) -> tuple[list[int], str]:
        """Keeps what has arrived and forgets what is before `following`; blocks and near from now on."""
        for seq, row in arrived.items():
            self._rows(seq // BLOCK)[seq] = row
        for block in [b for b in self.stored if b < following // BLOCK]:
            self.read[block] = {}
        left = {b: sorted(r for r in rows.items() if r[0] >= following) for b, rows in self.read.items()}
        if not self.stored and sum(map(len, left.values())) <= BLOCK:
            near = sorted(r for rows in left.values() for r in rows)
            return [], json.dumps(near, ensure_ascii=False) if near else ""
        for block, rows in left.items():
            if rows:
                self.state.updateValue((block,), (json.dumps(rows, ensure_ascii=False),))
                self.stored.add(block)
            elif block in self.stored:
                self.state.removeKey((block,))
                self.stored.discard(block)
        return sorted(self.stored), ""


def _handler(cut: Callable[[str, str, bool], tuple[str, str]], idle_seconds: int | None):
    def ordered(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Chunks in order of seq: later ones wait until the missing one has come, or until the channel is idle for too long."""
        following, pending, waiting = state.get if state.exists else (0, "", [])
        held = {int(s): (d, f) for s, d, f in waiting}
        out = []
        if state.hasTimedOut:  # a gap that is never filled: what has come goes on, in its order
            for seq in sorted(held):
                text, pending = cut(pending, held[seq][0], False)
                out.append((*key, seq, text, False))
            out.append((*key, following + len(held), pending, True))
            state.remove()
            yield pd.DataFrame(out, columns=["sid", "channel", "seq", "text", "final"])
            return
        for part in parts:
            for row in part.itertuples():
                if row.seq >= following:
                    held.setdefault(int(row.seq), (row.delta or "", bool(row.final)))
        done = False
        while following in held:
            delta, final = held.pop(following)
            text, pending = cut(pending, delta, final)
            out.append((*key, following, text, final))
            following, done = following + 1, done or final
        if done:
            state.remove()
        else:
            state.update((following, pending, [(s, d, f) for s, (d, f) in sorted(held.items())]))
            if idle_seconds:
                state.setTimeoutDuration(idle_seconds * 1000)
        yield pd.DataFrame(out, columns=["sid", "channel", "seq", "text", "final"])

    return ordered


def reassembled(chunks: DataFrame, cut: Callable[[str, str, bool], tuple[str, str]] = release, idle_seconds: int | None = None) -> DataFrame:
    """Stream (sid, channel, seq, text, final) of pieces that split no placeholder, from (sid, channel, seq, delta, final).

    cut: release, release_lines or release_behind. The state of a channel goes with its last piece.
    With idle_seconds (for streams that run on; a run to the end of what is there never ends with
    it) also when the channel was idle for so long: then what waits goes on as its end.
    """
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_seconds else GroupStateTimeout.NoTimeout
    return chunks.groupBy("sid", "channel").applyInPandasWithState(
        _handler(cut, idle_seconds), "sid string, channel string, seq long, text string, final boolean",
        "following long, pending string, waiting array<struct<seq:long,delta:string,final:boolean>>", "append", timeout,
    )


_CHOICES = "choices array<struct<index:int,finish_reason:string,delta:struct<content:string,reasoning_content:string,tool_calls:array<struct<index:int,function:struct<arguments:string>>>>>>"


def channel_deltas(events: DataFrame) -> DataFrame:
    """(sid, n, channel, delta, final) of frames (sid, n, data): one channel for each choice's text, its reasoning and each of its tool calls.

    [DONE] ends all channels of an answer: it gives one row of channel '*' with final set. Data that
    are no JSON object give no rows.
    """
    done = events.where(F.trim("data") == "[DONE]").select("sid", "n", F.lit("*").alias("channel"), F.lit("").alias("delta"), F.lit(True).alias("final"))
    parsed = events.where(F.trim("data") != "[DONE]").select("sid", "n", F.explode(F.from_json("data", _CHOICES)["choices"]).alias("c"))
    name = lambda kind: F.concat(F.coalesce("c.index", F.lit(0)).cast("string"), F.lit(f":{kind}"))
    tools = F.transform("c.delta.tool_calls", lambda t: F.struct(F.concat(name("tool"), t["index"].cast("string")).alias("channel"), t["function"]["arguments"].alias("delta")))
    made = F.concat(
        F.array(F.struct(name("text").alias("channel"), F.col("c.delta.content").alias("delta")), F.struct(name("reason").alias("channel"), F.col("c.delta.reasoning_content").alias("delta"))),
        F.coalesce(tools, F.array().cast("array<struct<channel:string,delta:string>>")),
    )
    rows = parsed.select("sid", "n", F.col("c.finish_reason").isNotNull().alias("final"), F.explode(made).alias("m")).where("m.delta IS NOT NULL")
    return rows.select("sid", "n", "m.channel", "m.delta", "final").unionByName(done)


def restored_batch(pieces: DataFrame, known: DataFrame) -> DataFrame:
    """Pieces of a micro-batch with the placeholders of the mapping replaced (for foreachBatch)."""
    from ..operators.tokens import restore

    return restore(pieces, known)


def whole(chunks: DataFrame) -> DataFrame:
    """The batch equivalent: each channel's text in one piece."""
    per = chunks.groupBy("sid", "channel").agg(F.array_sort(F.collect_list(F.struct("seq", "delta"))).alias("c"))
    return per.select("sid", "channel", F.array_join(F.transform("c", lambda x: F.coalesce(x["delta"], F.lit(""))), "").alias("text"))


def frames(lines: DataFrame, text: str = "value") -> DataFrame:
    """Server-sent events of whole bodies: (n, event, data) per blank-line separated frame; lines over 64 KiB are dropped."""
    blocks = F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n\n+")
    rest = [c for c in lines.columns if c != text]
    each = lines.select(*rest, F.posexplode(blocks).alias("n", "block")).where("block <> ''")
    rows = F.filter(F.split("block", "\n"), lambda x: F.length(x) <= 65536)
    field = lambda name: F.transform(F.filter(rows, lambda x: x.startswith(name + ":")), lambda x: F.regexp_replace(x, f"^{name}: ?", ""))
    return each.select(*rest, "n", F.get(field("event"), F.lit(0)).alias("event"), F.array_join(field("data"), "\n").alias("data"))

