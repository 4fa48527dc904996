"""Known values wherever they stand, in the middle of a run of Chinese characters too.

A value's key is made of its length and the rolling hashes of its first and last L characters,
L being the largest power of two that fits, so that the two cover it. Texts yield the keys of
their windows of every length that a value has; a bit array of all values' keys, of bounded size,
lets through what may be one. The keys are then joined with the values, and each place is
compared with the value itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .automaton import points_of

#: Bits for each value in the array, and the most bits (32 MB); fuller arrays let more windows through to the join.
BITS_EACH, MOST_BITS = 1024, 1 << 28
SEGMENT_BITS = 1 << 23
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_EDGES: list[np.ndarray] = []


def identifier(points: np.ndarray) -> np.ndarray:
    """Letters, digits and underscore of scripts that put something between words."""
    if not _EDGES:
        table = np.array([chr(c).isalnum() or c == 95 for c in range(0x10000)])
        for lo, hi in ((0x2E80, 0x3100), (0x31F0, 0x3200), (0x3400, 0xA000), (0xF900, 0xFB00)):
            table[lo:hi] = False
        _EDGES.append(table)
    small = points < 0x10000
    return small & _EDGES[0][np.where(small, points, 0)]


class Windows:
    """Hashes of all windows of a stretch whose length is a power of two, each made of two of half the length."""

    def __init__(self, points: np.ndarray):
        self.levels, self.powers = [points.astype(np.uint64) + np.uint64(1)], [_BASE]

    def _level(self, k: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            while len(self.levels) <= k:
                h, half = self.levels[-1], 1 << (len(self.levels) - 1)
                self.levels.append(h[:-half] * self.powers[-1] + h[half:] if len(h) > half else h[:0])
                self.powers.append(self.powers[-1] * self.powers[-1])
        return self.levels[k]

    def keys(self, n: int) -> np.ndarray:
        """Keys of the windows of n characters, by their start."""
        k = n.bit_length() - 1
        h = self._level(k)
        count = len(h) - (n - (1 << k))
        if count <= 0:
            return h[:0]
        with np.errstate(over="ignore"):
            x = (h[:count] * _MIX + h[n - (1 << k) : n - (1 << k) + count]) ^ np.uint64(n)
            x = (x ^ (x >> np.uint64(31))) * _BASE
            return x ^ (x >> np.uint64(29))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def keyed(values: DataFrame) -> DataFrame:
    """values (value, token) with n and key."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [points_of(v) for v in batch.column(0).to_pylist()]
            keys = np.array([Windows(p).keys(len(p))[0] for p in each], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(p) for p in each], pa.int32()), _signed(keys)], ["value", "token", "n", "key"])

    return values.select("value", "token").where("value <> ''").mapInArrow(work, "value string, token string, n int, key long")


def bit_array(keys: DataFrame) -> tuple[bytes, int]:
    """Bits by the leading bits of the keys, and log2 of their number, at most that of MOST_BITS."""
    n = keys.count()
    bits = 1 << 16
    while bits < min(n * BITS_EACH, MOST_BITS):
        bits *= 2
    width, segment = bits.bit_length() - 1, min(bits, SEGMENT_BITS)
    place = F.shiftrightunsigned("key", 64 - width)

    def joined(key: tuple, found: pa.Table) -> pa.Table:
        on = np.zeros(segment, bool)
        on[found.column("at").to_numpy() % segment] = True
        return pa.table({"s": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())})

    out = bytearray(bits // 8)
    at = keys.select(place.alias("at")).distinct().withColumn("s", F.floor(F.col("at") / segment).cast("long"))
    for row in at.groupBy("s").applyInArrow(joined, "s long, bits binary").toLocalIterator():
        out[row.s * segment // 8 : (row.s + 1) * segment // 8] = row.bits
    return bytes(out), width


def places(texts: DataFrame, lengths: list[int], bits: bytes, width: int) -> DataFrame:
    """(id, n, key, at array): windows of texts (id, text) between edges whose key may be that of a value."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def found(points: np.ndarray, on: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        windows = Windows(points)
        inside = identifier(points)
        before, after = np.append(False, inside[:-1]) & inside, np.append(inside[1:], False) & inside
        for n in lengths:
            if n > len(points):
                break
            key = windows.keys(n)
            place = key >> np.uint64(64 - width)
            hit = on[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1 == 1
            at = np.flatnonzero(hit & ~before[: len(key)] & ~after[n - 1 :])
            if len(at):
                yield n, key[at], at

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for n, key, at in found(points_of(text), on) if text else ():
                    order = np.argsort(key, kind="stable")
                    edges = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
                    rows += [(i, n, int(key[order[a]].astype(np.int64)), part) for a, part in zip(edges.tolist(), np.split(at[order], edges[1:]))]
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int32())))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "key", "at"])

    return texts.mapInArrow(work, "id string, n int, key long, at array<int>")


def longest_first(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Of spans (start, stop, token) in order those that remain: longer ones first, of equal ones the earlier; none over another."""
    import bisect

    starts: list[int] = []
    kept: dict[int, tuple[int, int, str]] = {}
    for s in sorted(spans, key=lambda s: (s[0] - s[1], s[0])):
        i = bisect.bisect_right(starts, s[0])
        if (i == 0 or kept[starts[i - 1]][1] <= s[0]) and (i == len(starts) or s[1] <= starts[i]):
            starts.insert(i, s[0])
            kept[s[0]] = s
    return [kept[s] for s in starts]


def replaced(df: DataFrame, values: DataFrame, text: str = "text") -> DataFrame:
    """df with every one of the values (value, token) in text replaced by its token, longest first.

    A value that begins or ends with a letter, digit or underscore must not touch another one
    there, unless the script writes words without gaps. Equal texts are searched once. A null
    text stays null; texts and values of any length are looked at whole.
    """
    from ..session import written

    given = written(keyed(values).dropDuplicates(["value"]), "known")
    lengths = [r.n for r in given.select("n").distinct().orderBy("n").collect()]  # one small number for each length that occurs
    if not lengths:
        return df
    bits, width = bit_array(given.select("key"))
    column = F.col(text)
    texts = df.select(F.sha2(column, 256).alias("id"), column.alias("text")).where(F.length("text") >= lengths[0]).dropDuplicates(["id"])
    met = places(texts, lengths, bits, width).join(given, ["n", "key"]).groupBy("id").agg(F.collect_list(F.struct("value", "token", "at")).alias("_met"))
    both = df.withColumn("_id", F.sha2(column, 256)).join(met.withColumnRenamed("id", "_id"), "_id", "left")
    return both.withColumn(text, F.when(F.col("_met").isNull(), column).otherwise(_spliced(F.when(F.col("_met").isNotNull(), column), F.col("_met")))).drop("_id", "_met")


def held(df: DataFrame, values: DataFrame, text: str = "text") -> DataFrame:
    """(value, n): in how many rows of df each of the values stands, anywhere in the text, inside words too; values that stand nowhere have no row.

    Equal texts are searched once. Only the windows that may be a value leave the texts.
    """
    from ..session import written

    given = written(keyed(values.select("value", F.lit("").alias("token"))).dropDuplicates(["value"]), "known")
    lengths = [r.n for r in given.select("n").distinct().orderBy("n").collect()]  # one small number for each length that occurs
    if not lengths:
        return given.select("value", F.lit(0).cast("long").alias("n"))
    bits, width = bit_array(given.select("key"))
    column = F.col(text)
    known = df.where(column.isNotNull()).select(F.sha2(column, 256).alias("id"), column.alias("text"))
    copies = known.groupBy("id").agg(F.count("*").alias("copies"))
    met = windows(known.where(F.length("text") >= lengths[0]), lengths, bits, width).distinct().join(given, ["n", "key"]).where("piece = value").select("id", "value")
    return met.join(copies, "id").groupBy("value").agg(F.sum("copies").alias("n"))


def windows(texts: DataFrame, lengths: list[int], bits: bytes, width: int) -> DataFrame:
    """(id, n, key, piece): the different windows of texts (id, text), between edges or not, whose key may be that of a value."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hashes = Windows(points_of(text))
                for n in lengths:
                    if n > len(text):
                        break
                    key = hashes.keys(n)
                    place = key >> np.uint64(64 - width)
                    at = np.flatnonzero(on[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1)
                    rows += {(i, n, k, text[a : a + n]) for a, k in zip(at.tolist(), key[at].view(np.int64).tolist())}
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "key", "piece"])

    return texts.mapInArrow(work, "id string, n int, key long, piece string")


@F.arrow_udf(StringType())
def _spliced(texts: pa.Array, met: pa.Array) -> pa.Array:
    out = []
    for text, found in zip(texts.to_pylist(), met.to_pylist()):
        if text is None or found is None:
            out.append(text)
            continue
        spans = [(a, a + len(m["value"]), m["token"]) for m in found for a in m["at"] if text.startswith(m["value"], a)]
        parts, at = [], 0
        for start, stop, token in longest_first(spans):
            parts += [text[at:start], token]
            at = stop
        out.append("".join([*parts, text[at:]]))
    return pa.array(out, pa.string())
