"""Operator 11: SentencePiece BPE encoding and decoding in vectorised merge rounds.

The symbols of many words lie end to end in one numpy array. Each round finds the best pair of
every word by a segmented minimum over the pairs' ranks, merges all its leftmost occurrences at
once and compacts the array; words without a pair leave it, until none is left. A merge whose
product makes a pair that is as good or better ends the word's round, because one-at-a-time
merging would take that pair first; so results are those of the library.

Words are cut where no piece can reach across: before runs of spaces, around newlines, and
(inside long words) between two characters that stand next to each other in no piece. A bounded
memo keeps what words gave, since a corpus repeats them.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table
from .memo import Memo
from .ragged import binaries, contents, distinct, joined, per_list, taken

SPACE = "▁"
NONE = np.int32(2**31 - 1)
#: Words that go through the rounds together.
ROUND_WORDS = 20_000
#: Texts in which a space does not simply stand between two words.
ODD = "(^| )[ \n]|^$| $"
SEGMENTS = re.compile(" +[^ \n]*|\n[^ \n]*|[^ \n]+")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    """The model's pieces as numpy tables; symbols beyond the pieces stand for characters that are none."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.size = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(n)]
        if any(model.is_unused(i) for i in range(n)):
            raise ValueError(f"{path}: unused pieces are not supported")
        text = [model.id_to_piece(i) for i in range(n)]
        self.bos, self.eos, self.unknown = model.bos_id(), model.eos_id(), model.unk_id()
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        # ranks: the best score is 0, equal scores are equal
        order = np.unique([-model.get_score(i) for i in range(n)])
        self.rank = np.searchsorted(order, [-model.get_score(i) for i in range(n)]).astype(np.int32)
        normal = {text[i]: i for i in range(n) if not special[i]}
        self._characters(normal)
        self._pairs(normal)
        self.run = self._longest_run(normal)
        self._outputs(model, text)
        self.memo = Memo(self._words, 200_000)

    def _characters(self, normal: dict[str, int]) -> None:
        """Symbol of every character: its piece, or a number of its own beyond the pieces."""
        known = sorted({c for p in normal for c in p})
        self.points = np.array([ord(c) for c in known], np.uint32)
        self.symbols = np.array([normal.get(c, self.size + i) for i, c in enumerate(known)], np.int32)
        #: Symbols from here on stand for the character itself.
        self.beyond = self.size + len(known)
        own = self.symbols >= self.size
        self.own = {int(s): int(c) for s, c in zip(self.symbols[own], self.points[own])}
        self.symbol_of = {chr(c): int(s) for c, s in zip(self.points, self.symbols)}
        pairs = {ord(p[i]) << 32 | ord(p[i + 1]) for p in normal for i in range(len(p) - 1)}
        self.neighbours = np.array(sorted(pairs), np.uint64)

    def _pairs(self, normal: dict[str, int]) -> None:
        """Sorted (left, right) symbols as one number, with the piece that the two make."""
        found = {}
        for piece, i in normal.items():
            for at in range(1, len(piece)):
                left, right = piece[:at], piece[at:]
                a = normal.get(left, self.symbol_of.get(left) if at == 1 else None)
                b = normal.get(right, self.symbol_of.get(right) if len(right) == 1 else None)
                if a is not None and b is not None:
                    found[a << 32 | b] = i
        self.pair_keys = np.array(sorted(found), np.int64)
        self.pair_made = np.array([found[k] for k in self.pair_keys.tolist()], np.int32)

    def _longest_run(self, normal: dict[str, int]) -> int:
        """Spaces of the longest piece of spaces, where runs twice and more as long begin with it (0: they do not)."""
        longest = max((len(p) for p in normal if not p.strip(SPACE)), default=0)
        run = np.full(3 * longest, self.symbol_of.get(SPACE, self.beyond), np.int32)
        if not longest:
            return 0
        first = self._merged(run, np.array([len(run)]))[0][:2]
        worst = all(self.rank[i] == self.rank.max() for p, i in normal.items() if not p.strip(SPACE) and len(p) > 1)
        return longest if worst and (first == normal[SPACE * longest]).all() else 0

    def _outputs(self, model, text: list[str]) -> None:
        """Bytes that each id decodes to."""
        parts = []
        for i, piece in enumerate(text):
            if model.is_control(i):
                parts.append(b"")
            elif model.is_byte(i):
                parts.append(bytes([int(piece[3:5], 16)]))
            else:
                parts.append((" ⁇ " if model.is_unknown(i) else piece.replace(SPACE, " ")).encode())
        self.bytes, self.starts, self.sizes = joined(parts, "u1")
        self.is_byte = np.array([model.is_byte(i) for i in range(self.size)])
        self.visible = np.array([not model.is_control(i) for i in range(self.size)])

    def _made(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece of each pair of neighbours, or -1."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_made[at], np.int32(-1))

    def _ranked(self, made: np.ndarray) -> np.ndarray:
        return np.where(made >= 0, self.rank[made], NONE)

    def _merged(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words of these sizes (none of them 0) after all merges, with the new sizes."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        words = np.arange(len(sizes))
        made = np.append(self._made(symbols[:-1], symbols[1:]), np.int32(-1))
        made[np.cumsum(sizes) - 1] = -1
        while len(words):
            starts = np.cumsum(sizes) - sizes
            rank = self._ranked(made)
            best = np.minimum.reduceat(rank, starts)
            done = best == NONE
            if done.any():
                gone = np.repeat(done, sizes)
                out.append((words[done], sizes[done], symbols[gone]))
                symbols, made, rank = symbols[~gone], made[~gone], rank[~gone]
                words, sizes, best = words[~done], sizes[~done], best[~done]
                if not len(words):
                    break
            word = np.repeat(np.arange(len(words)), sizes)
            at = self._leftmost(np.flatnonzero(rank == best[word]))
            at = self._in_turn(at, symbols, made, word, best)
            symbols[at] = made[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            last = np.flatnonzero(np.append(word[1:] != word[:-1], True))
            ends = np.zeros(len(symbols), bool)
            ends[last] = True
            ends[at] |= ends[at + 1]
            changed = np.zeros(len(symbols), bool)
            changed[at] = True
            sizes = sizes - np.bincount(word[at], minlength=len(words))
            symbols, made, ends, changed = symbols[keep], made[keep], ends[keep], changed[keep]
            changed[:-1] |= changed[1:]
            again = np.flatnonzero(changed & ~ends)
            made[ends] = -1
            made[again] = self._made(symbols[again], symbols[again + 1])
        if not out:
            return symbols, sizes
        # back into the words' own order
        number = np.concatenate([w for w, _, _ in out])
        size = np.concatenate([s for _, s, _ in out])
        order = np.argsort(number, kind="stable")
        starts = np.cumsum(size) - size
        return taken(np.concatenate([s for _, _, s in out]), starts[order], size[order]), size[order]

    @staticmethod
    def _leftmost(at: np.ndarray) -> np.ndarray:
        """Of places of pairs those that remain when each one taken covers the next place."""
        if len(at) < 2:
            return at
        first = np.append(True, at[1:] != at[:-1] + 1)
        since = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        return at[since % 2 == 0]

    def _in_turn(self, at: np.ndarray, symbols: np.ndarray, made: np.ndarray, word: np.ndarray, best: np.ndarray) -> np.ndarray:
        """The merges of each word up to the first one that makes a pair as good as itself or better."""
        new = made[at]
        mine = word[at]
        n = len(symbols)
        before = np.maximum(at - 1, 0)
        left = symbols[before]
        follows = np.append(False, at[1:] == at[:-1] + 2)  # the pair before has just been merged
        left = np.where(follows, np.append(np.int32(0), new[:-1]), left)
        has_left = (at > 0) & (word[before] == mine)
        after = np.minimum(at + 2, n - 1)
        has_right = (at + 2 < n) & (word[after] == mine)
        bar = best[mine]
        better = has_left & (self._ranked(self._made(left, new)) <= bar)
        better |= has_right & (self._ranked(self._made(new, symbols[after])) <= bar)
        if not better.any():
            return at
        total = np.cumsum(better) - better  # of merges before this one
        start = np.append(True, mine[1:] != mine[:-1])
        base = np.maximum.accumulate(np.where(start, total, 0))
        return at[total == base]

    def _cut(self, points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sizes of the parts of words between characters that no piece has next to each other."""
        key = points[:-1].astype(np.uint64) << np.uint64(32) | points[1:]
        place = np.minimum(np.searchsorted(self.neighbours, key), len(self.neighbours) - 1)
        apart = np.append(self.neighbours[place] != key, True)
        apart[np.cumsum(sizes) - 1] = True
        if self.run:
            # runs of spaces are merged last and from the left: whole blocks can be cut off while more than one block remains
            space = points == ord(SPACE)
            if space.sum() > 2 * self.run:
                edge = np.flatnonzero(np.diff(np.concatenate(([0], space.view(np.int8), [0]))))
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    whole = (b - a - 2) // self.run
                    if whole > 0:
                        apart[a + self.run - 1 : a + whole * self.run : self.run] = True
        return np.diff(np.concatenate(([0], np.flatnonzero(apart) + 1)))

    def _words(self, keys: list[str]) -> list[bytes]:
        """ids of words: a key that begins with a newline follows no space, each other one does."""
        out: list[bytes] = []
        for at in range(0, len(keys), ROUND_WORDS):
            words = [(k if k.startswith("\n") else " " + k).replace(" ", SPACE) for k in keys[at : at + ROUND_WORDS]]
            points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            place = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
            symbols = np.where(self.points[place] == points, self.symbols[place], self.beyond + points.astype(np.int64)).astype(np.int32)
            parts = self._cut(points, sizes)
            owner = np.searchsorted(np.cumsum(sizes), np.cumsum(parts) - 1, side="right")
            merged, left = self._merged(symbols, parts)
            counts = np.bincount(np.repeat(owner, left), minlength=len(words))
            ids, counts = self._fallback(merged, counts)
            ends = np.cumsum(counts)
            raw = ids.astype("<u4").tobytes()
            out += [raw[4 * (e - c) : 4 * e] for e, c in zip(ends.tolist(), counts.tolist())]
        return out

    def _fallback(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no piece become the ids of their bytes."""
        at = np.flatnonzero(symbols >= self.size)
        if not len(at):
            return symbols, counts
        kinds, which = np.unique(symbols[at], return_inverse=True)
        points = [self.own[s] if s < self.beyond else s - self.beyond for s in kinds.tolist()]
        coded = [self.byte_ids[list(chr(c).encode("utf-8", "surrogatepass"))].astype("<i4").tobytes() for c in points]
        values, starts, sizes = joined(coded, "<i4")
        begin, size = np.arange(len(symbols)), np.ones(len(symbols), np.int64)
        begin[at], size[at] = len(symbols) + starts[which], sizes[which]
        return taken(np.concatenate([symbols, values]), begin, size), per_list(size, counts)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end (null: as empty), begin and end ids with them, and how many each text has."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), SPACE, " ")
        odd = pc.match_substring_regex(texts, ODD)
        plain = pc.replace_substring(pc.if_else(odd, "", texts), "\n", " \n")
        pieces, which, counts = distinct(pc.split_pattern(plain, " "))
        self.memo.prepare(set(pieces))
        ends = np.array([self.bos, self.eos], "<u4").tobytes()
        values, starts, sizes = joined([ends, *[self.memo[p] for p in pieces]], "<u4")
        begin, size = starts[which + 1], sizes[which + 1]
        at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        n = per_list(size, counts)
        ids = taken(values, begin, size)
        first = np.cumsum(n) - n
        if len(at):
            whole = []
            for i in at:
                text = texts[int(i)].as_py()
                keys = [s.removeprefix(" ") for s in SEGMENTS.findall(" " + text)] if text else []
                self.memo.prepare(set(keys))
                whole.append(b"".join([self.memo[k] for k in keys]))
            more, where, size = joined(whole, "<u4")
            first[at], n[at] = where + len(ids), size
            ids = np.concatenate([ids, more])
        # begin id, the text's ids, end id
        begin = np.stack([np.full(len(n), len(ids)), first, np.full(len(n), len(ids) + 1)], 1).ravel()
        size = np.stack([np.ones(len(n), np.int64), n, np.ones(len(n), np.int64)], 1).ravel()
        return taken(np.concatenate([ids, values[:2]]), begin, size), n + 2

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids end to end, and how many each text has: the space before a text is left out."""
        sizes, begin = self.sizes[ids].copy(), self.starts[ids].copy()
        ends = np.cumsum(counts)
        shown = np.flatnonzero(self.visible[ids])
        place = np.searchsorted(shown, ends - counts)
        first = np.append(shown, len(ids))[place]
        first = first[first < ends]
        lead = first[(self.bytes[begin[first]] == 32) & ~self.is_byte[ids[first]] & (ids[first] != self.unknown)]
        begin[lead] += 1
        sizes[lead] -= 1
        out, n = taken(self.bytes, begin, sizes), per_list(sizes, counts)
        byte = self.is_byte[ids]
        if not byte.any():
            return out, n
        return self._repaired(out, n, ids, byte, counts)

    def _repaired(self, out: np.ndarray, n: np.ndarray, ids: np.ndarray, byte: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each byte of a run of byte ids that is part of no character there becomes the replacement character."""
        starts = (np.cumsum(n) - n)[n > 0]
        broken = byte[:-2] & ~self.visible[ids[1:-1]] & byte[2:]
        try:
            out.tobytes().decode()
            if not broken.any() and not ((out[starts] & 0xC0) == 0x80).any():
                return out, n
        except UnicodeDecodeError:
            pass
        parts = []
        for e, k, at, m in zip(np.cumsum(n).tolist(), n.tolist(), np.cumsum(counts).tolist(), counts.tolist()):
            text, edge = out[e - k : e].tobytes(), np.flatnonzero(np.diff(byte[at - m : at].view(np.int8))) + 1
            lengths = self.sizes[ids[at - m : at]]
            lead = int(lengths.sum()) - k  # the space left out
            place = np.maximum(np.concatenate(([0], np.cumsum(lengths)[edge - 1], [k + lead])) - lead, 0).tolist()
            parts.append(b"".join([_decoded(text[x:y]) for x, y in zip(place, place[1:])]))
        values, _, sizes = joined(parts, "u1")
        return values, sizes


def _decoded(raw: bytes) -> bytes:
    out, at = [], 0
    while at < len(raw):
        try:
            raw[at:].decode()
            out.append(raw[at:])
            break
        except UnicodeDecodeError as e:
            out.append(raw[at : at + e.start])
            out.append("\N{REPLACEMENT CHARACTER}".encode())
            at += e.start + 1
    return b"".join(out)


@functools.cache
def codec(path: str) -> Codec:
    """One for each worker process; its size is that of the vocabulary."""
    return Codec(path)


def encode(docs: DataFrame, path: str | None = None, decoded: bool = False) -> DataFrame:
    """(doc_id, ids) and, if asked for, decoded: ids as little-endian unsigned 32-bit, decoded as the text's bytes.

    Every text has the begin and the end id; a null or empty one has nothing else. Strings of
    special pieces in a text are ordinary text; the character that stands for spaces decodes to
    a space, as with the library. Texts of any length are encoded whole. Repeated rows stay; an
    empty table gives no rows; other columns are not read.
    """
    path = path or model_path()
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
    """(doc_id, decoded) of the ids of encode(), or of any ids of the model; null ids decode to nothing."""
    path = path or model_path()

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, edges = contents(pc.fill_null(batch.column(1), b""), "<u4")
        yield pa.RecordBatch.from_arrays([batch.column(0), binaries(*codec(path).decode(ids, np.diff(edges)))], ["doc_id", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return map_texts(encoded.select("doc_id", "ids"), work, f"doc_id {kind}, decoded binary", text="ids")


def op11_piece_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = encode(table(spark, sf_dir, "documents"), decoded=True)
    size = (F.octet_length("ids") / 4).cast("long")
    return both.select("doc_id", size.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op11_piece_rounds": op11_piece_rounds}
ORACLE_SQL: dict[str, str] = {}
