"""Streams of text cut anywhere, put together as records: lines, server-sent events, text with commands.

What a channel must remember is only the unfinished record or match, besides pieces that came
before an earlier one. A cutter takes (rest, text, final) and gives (records, rest); it never
sees what has gone on already, but for one character that word edges may need.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.audit import COMMANDS, NOTICE
from .channels import Waiting
from .restoration import PROVIDER, ROCKS

#: Rows of a channel's stream, in the order of seq (0, 1, …); what a cutter makes of them.
INPUT = "sid string, channel string, seq long, delta string, final boolean"
OUTPUT = "sid string, channel string, n long, kind string, text string"
#: Characters of an unfinished record or match that are kept; beyond them it goes on as it is (records as kind `oversize`).
CAP = 65_536
Cut = tuple[list[tuple[str, str]], str]


def lines(rest: str, text: str, final: bool, channel: str = "", cap: int = CAP) -> Cut:
    """Lines of NDJSON without their ends; empty ones are left out. A line feed ends a line, a carriage return before it belongs to it."""
    parts = (rest + text).split("\n")
    rest = "" if final else parts.pop()
    out = [("line", p.removesuffix("\r")) for p in parts]
    if len(rest) > cap:
        out, rest = [*out, ("oversize", rest)], ""
    return [r for r in out if r[1]], rest


def events(rest: str, text: str, final: bool, channel: str = "", cap: int = CAP) -> Cut:
    """Server-sent events as `name\\ndata` (kind event): data lines joined by newlines, comments left out; line ends may be any of three."""
    whole = rest + text
    held = ""
    if whole.endswith("\r") and not final:  # its line feed may follow
        whole, held = whole[:-1], "\r"
    whole = whole.replace("\r\n", "\n").replace("\r", "\n")
    blocks = whole.split("\n\n")
    rest = "" if final else blocks.pop()
    out = []
    for block in blocks:
        name, data = "", []
        for line in block.strip("\n").split("\n"):
            field, _, value = line.partition(":")
            value = value.removeprefix(" ")
            if field == "event":
                name = value
            elif field == "data":
                data.append(value)
        if data:
            out.append(("event", f"{name}\n" + "\n".join(data)))
    if len(rest) > cap:
        return [*out, ("oversize", rest)], held
    return out, rest + held


def commands(rest: str, text: str, final: bool, channel: str = "", cap: int = CAP, rules: tuple = COMMANDS, allow: tuple[str, ...] = ()) -> Cut:
    """Text with the commands of its channel's rules: rewritten to a notice, observed, or blocked, with nothing after them.

    Kinds: text, observe (the command, besides its text), rewrite and block (the notice). Only the beginning of
    a possible match is held back. The state's first character is a mark: `B` once the channel is
    blocked, else what follows it is the character before and the unfinished match.
    """
    import regex

    mark, before, held = rest[:1], rest[1:2], rest[2:]
    if mark == "B":
        return [], rest
    own = [(regex.compile(p), action) for where, p, action in rules if where == channel.partition(":")[2].rstrip("0123456789") or where == channel]
    free = [regex.compile(p) for p in allow]
    whole, at, out = before + held + text, len(before), []
    while own:
        found = [(m, action) for p, action in own for m in p.finditer(whole, at, partial=not final)]
        if not found:
            break
        m, action = min(found, key=lambda f: (f[0].start(), f[0].partial, -f[0].end()))
        open_ = m.partial or (m.end() == len(whole) and not final)
        if open_ and len(whole) - m.start() <= cap:
            if m.start() > at:
                out.append(("text", whole[at : m.start()]))
            return out, "T" + (whole[m.start() - 1 : m.start()] or "\0") + whole[m.start() :]
        if open_:  # too long to wait for
            break
        if m.start() > at:
            out.append(("text", whole[at : m.start()]))
        hit = m.group()
        if any(p.search(hit) for p in free):
            out.append(("text", hit))
        elif action == "observe":
            out += [("observe", hit), ("text", hit)]
        else:
            out.append((action, NOTICE))
            if action == "block":
                return out, "B"
        at = max(m.end(), at + 1)
    if at < len(whole):
        out.append(("text", whole[at:]))
    return out, "T" + (whole[-1:] or "\0")


_OUT = Row("sid", "channel", "n", "kind", "text")


class Assembled(StatefulProcessor):
    """State of a channel: at (next seq, next record, rest, what waits) and waiting (pieces in blocks)."""

    def __init__(self, cut: Callable[..., Cut], cap: int):
        self.cut, self.cap = cut, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "following long, n long, rest string, blocks array<long>, near string")
        self.waiting = handle.getMapState("waiting", "block long", "rows string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.at.get()
        following, n, rest, blocks, near = known or (0, 0, "", (), "")
        arrived: dict[int, tuple[str, bool]] = {}
        for _, _, seq, delta, final in rows:
            if seq >= following:
                arrived.setdefault(seq, (delta, final))
        waiting = Waiting(self.waiting, blocks, near)
        ended = False
        while not ended:
            piece = arrived.pop(following, None) or waiting.get(following)
            if piece is None:
                break
            delta, ended = piece
            records, rest = self.cut(rest, delta, ended, key[1] or "", self.cap)
            for kind, text in records:
                yield _OUT(*key, n, kind, text)
                n += 1
            following += 1
        if not ended:
            self.at.update((following, n, rest, *waiting.store(arrived, following)))
            return
        if known:
            self.at.clear()
        if blocks:
            self.waiting.clear()

    def close(self) -> None:
        pass


def assembled(pieces: DataFrame, cut: Callable[..., Cut] = lines, cap: int = CAP) -> DataFrame:
    """Stream (sid, channel, n, kind, text) of records from a stream of INPUT rows, numbered by channel.

    Pieces may arrive in any order and more than once; null deltas are empty. The channel's
    state goes with its final piece.
    """
    pieces.sparkSession.conf.set(PROVIDER, ROCKS)
    pieces = pieces.select("sid", "channel", "seq", F.coalesce("delta", F.lit("")).alias("delta"), F.coalesce("final", F.lit(False)).alias("final"))
    return pieces.groupBy("sid", "channel").transformWithState(Assembled(cut, cap), OUTPUT, "append", "none")


def whole(text: str, cut: Callable[..., Cut], channel: str = "") -> list[tuple[str, str]]:
    """The records of a whole text, as the batch form."""
    return cut("", text, True, channel)[0]
