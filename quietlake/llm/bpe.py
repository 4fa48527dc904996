"""Operator 6: byte-level BPE encoding and decoding with a two-tier lookup.

A text is cut into pre-tokens. A minimal perfect hash over the vocabulary resolves those that
are tokens as they stand; each other one is merged by a heap of candidate pairs over a linked
list of its bytes, lowest rank first and leftmost among equals. A bounded memo keeps what space-separated
chunks gave, since a corpus repeats its words; cuts at a single space between other characters
are always cuts between pre-tokens, and texts with other white space go through the pattern whole.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table
from .memo import Memo
from .ragged import binaries, contents, distinct, joined, per_list, taken

#: Marks a piece that follows no space; a text that holds it is encoded whole.
FIRST = "\r"
#: White space other than single spaces and newlines, in any script.
ODD = r"[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n]{2}"


def rank_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PerfectHash:
    """Minimal perfect hash of byte strings by hash and displace: n keys, n slots.

    Keys of a bucket get the first displacement that sends them to free slots, large buckets
    first; a bucket of one key names its slot directly (as -1 - slot).
    """

    def __init__(self, keys: list[bytes], values: list[int]):
        n = max(1, len(keys))
        self.n, self.buckets = n, n // 2 + 1
        groups: dict[int, list[int]] = {}
        hashes = [xxhash.xxh64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            groups.setdefault(h % self.buckets, []).append(i)
        self.displace = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * n
        self.values = [0] * n
        singles = []
        for b, members in sorted(groups.items(), key=lambda g: -len(g[1])):
            if len(members) == 1:
                singles.append((b, members[0]))
                continue
            d = 0
            while True:
                slots = [self._slot(hashes[i], d) for i in members]
                if len(set(slots)) == len(slots) and all(self.keys[s] is None for s in slots):
                    break
                d += 1
            self.displace[b] = d
            for i, s in zip(members, slots):
                self.keys[s], self.values[s] = keys[i], values[i]
        free = (s for s in range(n) if self.keys[s] is None)
        for (b, i), s in zip(singles, free):
            self.displace[b] = -1 - s
            self.keys[s], self.values[s] = keys[i], values[i]

    def _slot(self, h: int, d: int) -> int:
        return (((h ^ (d * 0x9E3779B97F4A7C15)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF) >> 20) % self.n

    def get(self, key: bytes) -> int:
        """The value of the key, or -1 if it is none of the keys."""
        h = xxhash.xxh64_intdigest(key)
        d = self.displace[h % self.buckets]
        s = -1 - d if d < 0 else self._slot(h, d)
        return self.values[s] if self.keys[s] == key else -1


def pair_table(ranks: dict[bytes, int]) -> dict[int, int]:
    """left id and right id as one number -> id of the token that the two make, which is its rank."""
    out = {}
    for token, i in ranks.items():
        for at in range(1, len(token)):
            left, right = ranks.get(token[:at]), ranks.get(token[at:])
            if left is not None and right is not None:
                out[left << 24 | right] = i
    return out


def merge(parts: list[int], pairs: dict[int, int]) -> list[int]:
    """ids of a pre-token that is not a token itself, from the ids of its bytes: the heap holds (rank, place) as one number."""
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank, push, pop = pairs.get, heapq.heappush, heapq.heappop
    heap = [r << 32 | i for i in range(n - 1) if (r := rank(parts[i] << 24 | parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        top = pop(heap)
        r, i = top >> 32, top & 0xFFFFFFFF
        left, j = parts[i], after[i]
        if left < 0 or j >= n or rank(left << 24 | parts[j]) != r:
            continue
        parts[i], parts[j] = r, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (new := rank(r << 24 | parts[k])) is not None:
                push(heap, new << 32 | i)
        h = before[i]
        if h >= 0 and (new := rank(parts[h] << 24 | r)) is not None:
            push(heap, new << 32 | h)
    return [p for p in parts if p >= 0]


class Codec:
    def __init__(self, path: str):
        import public_tokenizers
        import regex

        self.ranks = load_ranks(path)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.pairs = pair_table(self.ranks)
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.whole = PerfectHash(list(self.ranks), list(self.ranks.values()))
        ids = sorted(t for t in self.ranks.values())
        by_id = {i: t for t, i in self.ranks.items()}
        self.bytes, starts, sizes = joined([by_id[i] for i in ids], "u1")
        self.starts, self.sizes = np.zeros(ids[-1] + 1, np.int64), np.zeros(ids[-1] + 1, np.int64)
        self.starts[ids], self.sizes[ids] = starts, sizes
        self.memo = Memo(lambda pieces: [self._piece(p) for p in pieces], 200_000)
        self.line = self._chunk("\n")

    def pretoken(self, text: str) -> list[int]:
        piece = text.encode("utf-8", "surrogatepass")
        found = self.whole.get(piece)
        return [found] if found >= 0 else merge([self.single[b] for b in piece], self.pairs)

    def _chunk(self, text: str) -> bytes:
        out: list[int] = []
        for p in self.pattern.findall(text):
            out += self.pretoken(p)
        return np.array(out, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        """Pieces that follow no space are marked by FIRST, the first one of a line by its newline; all others follow a space."""
        if piece.startswith(FIRST):
            return self._chunk(piece[1:])
        return self.line + self._chunk(piece[1:]) if piece.startswith("\n") else self._chunk(" " + piece)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end (null: none), and how many each text has."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, ODD)
        # a full stop or comma between a letter and white space or the end is a pre-token of its own
        stops = pc.replace_substring_regex(pc.if_else(odd, "", texts), r"([A-Za-zÀ-ÖØ-öø-ÿ])([.,])([ \n]|$)", rf"\1 {FIRST}\2\3")
        plain = pc.binary_join_element_wise(FIRST, pc.replace_substring(stops, "\n", " \n"), "")
        pieces, which, counts = distinct(pc.split_pattern(plain, " "))
        self.memo.prepare(set(pieces))
        values, starts, sizes = joined([self.memo[p] for p in pieces], "<u4")
        each = sizes[which]
        out, n = taken(values, starts[which], each), per_list(each, counts)
        at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if not len(at):
            return out, n
        whole = [self._chunk(texts[int(i)].as_py()) for i in at]
        more, begin, size = joined(whole, "<u4")
        first = np.cumsum(n) - n
        first[at], n[at] = begin + len(out), size
        return taken(np.concatenate([out, more]), first, n), n

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids end to end, and how many each text has."""
        sizes = self.sizes[ids]
        return taken(self.bytes, self.starts[ids], sizes), per_list(sizes, counts)


@functools.cache
def codec(path: str) -> Codec:
    """One for each worker process; its size is that of the vocabulary."""
    return Codec(path)


def encode(docs: DataFrame, path: str | None = None, decoded: bool = False) -> DataFrame:
    """(doc_id, ids) and, if asked for, decoded: ids as little-endian unsigned 32-bit, decoded as bytes.

    A null or empty text has no ids. Special-token strings in a text are ordinary text. Texts of
    any length are encoded whole. Repeated rows stay; an empty table gives no rows; other
    columns are not read.
    """
    path = path or rank_path()
    names = ["doc_id", "ids", *["decoded"] * decoded]

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, counts = codec(path).encode(batch.column(1))
        out = [batch.column(0), binaries(ids, counts)]
        if decoded:
            out.append(binaries(*codec(path).decode(ids, counts)))
        yield pa.RecordBatch.from_arrays(out, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs.select("doc_id", "text"), work, f"doc_id {kind}, ids binary" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, decoded) of the ids of encode(); null ids decode to nothing."""
    path = path or rank_path()

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, edges = contents(pc.fill_null(batch.column(1), b""), "<u4")
        yield pa.RecordBatch.from_arrays([batch.column(0), binaries(*codec(path).decode(ids, np.diff(edges)))], ["doc_id", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return map_texts(encoded.select("doc_id", "ids"), work, f"doc_id {kind}, decoded binary", text="ids")


def op6_two_tier_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = encode(table(spark, sf_dir, "documents"), decoded=True)
    size = (F.octet_length("ids") / 4).cast("long")
    return both.select("doc_id", size.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op6_two_tier_bpe": op6_two_tier_bpe}
ORACLE_SQL: dict[str, str] = {}
