"""Operator 4: concatenate and cut.

Pass one encodes each document, ends it with a separator id and writes the ids to the shared
folder with their place in their partition. Prefix sums over the partitions' token totals give
every document its global offset; pass two cuts the endless sequence of ids into fixed windows
and records the pieces. Only one row for each partition is ever brought together, and the ids
are not shuffled. Sequences are full but for the very last one.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _cuts, release, table, written
from .memo import Memo
from .ragged import binaries, contents, distinct, joined, per_list, taken

LENGTH = 2048
SEPARATOR = 1
#: Between the words that are encoded together; it has an id of its own.
MARK = "\x01"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """ids of whole texts by the tokenizers library, which sees each distinct word of a slice once.

    This tokenizer drops white space and never merges across it, so the ids of a text are
    those of its words in order. Ids are little-endian unsigned 32-bit.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        mark = self._ids(MARK)
        if len(mark) != 1:
            raise ValueError(f"{path}: the mark between words must be one token")
        self.mark = mark[0]
        self.memo = Memo(self._encode, 120_000)
        # the characters that stand for bytes in the vocabulary, by byte
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        odd = [b for b in range(256) if b not in plain]
        self.shown = {b: b for b in plain} | {b: 256 + i for i, b in enumerate(odd)}

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _encode(self, words: list[str]) -> list[bytes]:
        """Words of lower-case Latin-1 letters are one piece to this tokenizer and go to its model at once; others go through it whole."""
        out: list[bytes] = [b""] * len(words)
        rest: list[int] = []
        tokenize, pack = self.tokenizer.model.tokenize, [struct.Struct(f"<{n}I").pack for n in range(64)]
        for i, w in enumerate(words):
            if w.isalpha() and len(w) < 32 and (w.isascii() or (max(w) <= "ÿ" and "ª" not in w and "º" not in w)) and w.islower():
                if not w.isascii():
                    w = w.encode().decode("latin-1").translate(self.shown)
                ids = [t.id for t in tokenize(w)]
                out[i] = pack[len(ids)](*ids)
            elif MARK in w:
                out[i] = np.array(self._ids(w), "<u4").tobytes()
            elif w:
                rest.append(i)
        for at in range(0, len(rest), 256):
            some = rest[at : at + 256]
            ids = np.array(self._ids(f" {MARK} ".join([words[i] for i in some])), "<u4")
            cuts = np.flatnonzero(ids == self.mark)
            for i, a, b in zip(some, [0, *(cuts + 1)], [*cuts, len(ids)]):
                out[i] = ids[a:b].tobytes()
        return out

    def _words(self, texts: pa.Array) -> pa.ListArray:
        """Parts of the texts at which the tokenizer cuts in any case, as alike as they can be made.

        It lower-cases by character; so does Arrow within Latin-1, which has nothing to compose
        either. A full stop or comma between a letter and a space or the end is a piece of its own.
        """
        texts = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
        wide = pc.match_substring_regex(texts, r"[^\x00-\x{ff}]")
        alike = pc.replace_substring_regex(pc.utf8_lower(texts), r"([a-zà-öø-ÿ])([.,])( |$)", r"\1 \2\3")
        return pc.split_pattern(pc.if_else(wide, texts, alike), " ")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end (null: none), and how many each text has."""
        words, which, counts = distinct(self._words(texts))
        self.memo.prepare(set(words))
        values, starts, sizes = joined([self.memo[w] for w in words], "<u4")
        each = sizes[which]
        return taken(values, starts[which], each), per_list(each, counts)


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


def tokens(docs: DataFrame, path: str, separator: int = SEPARATOR) -> DataFrame:
    """(doc_id, part, start, ids): ids of the text (null: empty) and the separator, little-endian unsigned 32-bit; start counts in the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for whole in batches:
            done = 0
            for n in _cuts(whole.column(1)):
                batch = whole.slice(done, n)
                done += n
                values, sizes = encoder(path).encode(batch.column(1))
                values, sizes = np.insert(values, np.cumsum(sizes), separator), sizes + 1
                stops = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(n, part, np.int32)), pa.array(at + stops - sizes), binaries(values, sizes)],
                    ["doc_id", "part", "start", "ids"],
                )
                at += int(stops[-1])
        release()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, part int, start long, ids binary")


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, separator: int = SEPARATOR, ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Every document has at least one piece: a null or empty text is the separator alone. A long
    text has as many pieces as windows it crosses. The order is that of the input's partitions.
    Repeated rows are documents of their own; an empty table gives no rows; other columns are
    not read.
    """
    found = written(tokens(docs, path or tokenizer_path(), separator), "tokens")
    size = (F.octet_length("ids") / 4).cast("long")
    totals = found.groupBy("part").agg(F.sum(size).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    # one row of two numbers for each task of pass one, which the driver knows one by one anyway
    placed = found.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("start")).alias("at"), "ids")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * ids]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, edges = contents(batch.column(2), "<i4")
            at, lo, hi = batch.column(1).to_numpy(), edges[:-1], edges[1:]
            n = hi - lo
            count = (at + n - 1) // length - at // length + 1
            row = np.repeat(np.arange(len(n)), count)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            sequence = at[row] // length + nth
            first = np.maximum(sequence * length, at[row])
            last = np.minimum((sequence + 1) * length, at[row] + n[row])
            start = first - at[row]
            a, b = (lo[row] + start).tolist(), (lo[row] + last - at[row]).tolist()
            crc = np.fromiter((zlib.crc32(values[i:j]) for i, j in zip(a, b)), np.int64, len(a))
            out = [batch.column(0).take(pa.array(row)), *map(pa.array, (start, last - first, crc, n[row], sequence, first - sequence * length))]
            if ids:
                out.append(pa.ListArray.from_arrays(pa.array(np.array([*a, b[-1]] if a else [0], np.int32)), pa.array(values)))
            yield pa.RecordBatch.from_arrays(out, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return placed.mapInArrow(cut, schema + ", ids array<int>" * ids)


def op4_concat_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), ids=False)


QUERIES = {"op4_concat_and_cut": op4_concat_and_cut}
ORACLE_SQL: dict[str, str] = {}
