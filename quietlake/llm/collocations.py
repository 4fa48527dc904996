"""Operator 13: phrase collocations from mergeable Misra-Gries summaries and one exact count.

First pass: every task counts the hashes of its n-grams (one to three words) and writes them by
hash partition. Each partition merges its tasks' counts into a Misra-Gries summary of more than
(mass of the partition) / (threshold) counters; what a summary takes off a counter stays below
the threshold, so every n-gram that is frequent enough survives. Second pass: n-grams whose hash
survived are counted exactly, as strings. Hashes and the bit array made of the survivors only
spare work: equal hashes of different n-grams can add n-grams to the exact count, never lose one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _cuts, discard, release, table, written

THRESHOLD = 10
LONGEST = 3
TOP = 2000
#: A phrase goes if a longer one has at least this share of its occurrences, in hundredths.
ABSORBED = 50
UNKNOWN = "und"
#: Counters of a summary for each (mass / threshold); more than one of them keeps fewer chance survivors.
SLACK = 4
#: Bytes of text for each hash partition; a summary's size follows from it.
PARTITION_BYTES = 4_000_000
#: n-grams that a task counts at a time.
PENDING = 1_500_000
#: The survivors' bit array: bits for each survivor, and the most bits (128 MB); fuller arrays let more n-grams into the exact count.
BITS_EACH, MOST_BITS = 32, 1 << 30
SEGMENT_BITS = 1 << 23

WORD, BLANK, BREAK = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = BLANK
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


class Words:
    """The words of a slice of texts in order: distinct words, the code of each place, its text and its piece."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "")
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = texts.buffers()[2]
        raw = _LOWER[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data is not None else np.zeros(0, np.uint8)
        offsets -= offsets[0]
        kind = _KIND[raw]
        inside = kind == WORD
        begins = np.ones(len(raw), bool)
        begins[1:] = ~inside[:-1]
        begins[offsets[:-1][offsets[:-1] < len(raw)]] = True
        starts = np.flatnonzero(begins & inside)
        before = np.cumsum(inside, dtype=np.int32)
        edges = np.append(before[starts] - 1, before[-1] if len(before) else 0).astype(np.int32)
        words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(raw[inside])])
        coded = words.dictionary_encode()
        self.distinct = coded.dictionary
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.text = np.searchsorted(offsets, starts, side="right") - 1
        self.piece = np.cumsum(kind == BREAK, dtype=np.int32)[starts] + self.text

    def hashes(self) -> np.ndarray:
        return np.array([xxhash.xxh3_64_intdigest(w) for w in self.distinct.to_numpy(zero_copy_only=False)], np.uint64)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    h = h * _MIX[k % 3]
    h = (h ^ (h >> np.uint64(32))) * _MIX[(k + 1) % 3]
    return h ^ (h >> np.uint64(29))


def grams(words: Words, seed: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, places of the first word, hashes) of all n-grams of each length; seed tells the texts' languages apart."""
    each = words.hashes()[words.codes]
    h = _mixed(each ^ seed[words.text], 0)
    at = np.arange(len(h))
    yield 1, at, h
    for n in range(2, LONGEST + 1):
        stay = words.piece[n - 1 :] == words.piece[: len(words.piece) - n + 1]
        at = np.flatnonzero(stay)
        h = _mixed(h[: len(stay)] + each[n - 1 :] * _MIX[2], n - 1)
        yield n, at, h[at]


def _packed(values: np.ndarray) -> bytes:
    """Numbers by their bytes' significance, which compresses the leading zeros."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def _unpacked(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Summary:
    """A mergeable Misra-Gries summary: of `mass` occurrences, a key's counter is short by less than mass / (capacity + 1)."""

    def __init__(self, capacity: int):
        self.capacity = max(1, capacity)
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.short = 0
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.size += len(keys)
        if self.size >= self.capacity:
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *[k for k, _ in self.waiting]])
        counts = np.concatenate([self.counts, *[c for _, c in self.waiting]])
        self.waiting, self.size = [], 0
        keys, counts = _summed(keys, counts)
        if len(keys) > self.capacity:
            off = np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1]
            self.short += int(off)
            left = counts > off
            keys, counts = keys[left], counts[left] - off
        self.keys, self.counts = keys, counts

    def survivors(self, threshold: int) -> np.ndarray:
        """All keys that may have occurred this often."""
        self.merge()
        return self.keys[self.counts + self.short >= threshold]


def _seeds(langs: pa.Array) -> np.ndarray:
    coded = langs.dictionary_encode()
    each = np.array([xxhash.xxh3_64_intdigest(x) for x in coded.dictionary.to_pylist()], np.uint64)
    return each[coded.indices.to_numpy(zero_copy_only=False)]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for n in _cuts(batch.column(1)):
            yield batch.slice(at, n)
            at += n


def hashed_counts(docs: DataFrame, partitions: int) -> DataFrame:
    """(p, mass, keys, counts): for each hash partition what one task counted."""
    names = ["p", "mass", "keys", "counts"]

    def flushed(pending: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(np.concatenate(pending), return_counts=True)
        p = ((keys >> np.uint64(32)) * np.uint64(partitions) >> np.uint64(32)).astype(np.int64)
        edges = np.append(np.flatnonzero(np.append(True, p[1:] != p[:-1])), len(p))
        for lo in range(0, len(edges) - 1, 200):
            some = list(zip(edges[lo : lo + 200].tolist(), edges[lo + 1 : lo + 201].tolist()))
            rows = [
                [int(p[a]) for a, _ in some],
                [int(counts[a:b].sum()) for a, b in some],
                [_packed(np.append(keys[a], np.diff(keys[a:b]))) for a, b in some],
                [_packed(counts[a:b].astype("<u4")) for a, b in some],
            ]
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[np.ndarray] = []
        size = 0
        for part in _slices(batches):
            for _, _, h in grams(Words(part.column(1)), _seeds(part.column(0))):
                pending.append(h)
                size += len(h)
            if size >= PENDING:
                yield from flushed(pending)
                pending, size = [], 0
        if size:
            yield from flushed(pending)
        release()

    return docs.mapInArrow(run, "p long, mass long, keys binary, counts binary")


def surviving(blocks: DataFrame, threshold: int, slack: int = SLACK) -> DataFrame:
    """(keys): the survivors of each hash partition's summary, whose capacity comes from the partition's mass."""
    masses = blocks.groupBy("p").agg(F.sum("mass").alias("mass"))
    nothing = F.lit(None).cast("binary")
    # a partition's mass comes before its blocks
    rows = masses.select("p", F.lit(0).alias("o"), "mass", nothing.alias("keys"), nothing.alias("counts"))
    rows = rows.union(blocks.select("p", F.lit(1).alias("o"), "mass", "keys", "counts")).repartition("p").sortWithinPartitions("p", "o")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = None

        def result() -> Iterator[pa.RecordBatch]:
            keys = summary.survivors(threshold) if summary else ()
            if len(keys):
                yield pa.RecordBatch.from_arrays([pa.array([keys.tobytes()], pa.binary())], ["keys"])

        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column(1)[i].as_py() == 0:
                    yield from result()
                    summary = Summary(slack * batch.column(2)[i].as_py() // threshold + 1)
                else:
                    keys = np.cumsum(_unpacked(batch.column(3)[i].as_py(), "<u8"), dtype=np.uint64)
                    summary.add(keys, _unpacked(batch.column(4)[i].as_py(), "<u4").astype(np.int64))
        yield from result()
        release()

    return rows.mapInArrow(run, "keys binary")


def bit_array(survivors: DataFrame) -> tuple[bytes, int]:
    """Bits by the leading bits of the survivors' hashes, and log2 of their number; at most MOST_BITS."""
    n = survivors.agg(F.sum(F.octet_length("keys") / 8)).first()[0] or 0
    bits = 1 << 16
    while bits < min(n * BITS_EACH, MOST_BITS):
        bits *= 2
    width = bits.bit_length() - 1
    per_segment = min(bits, SEGMENT_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                at = np.unique(np.frombuffer(raw.as_py(), "<u8") >> np.uint64(64 - width)).astype(np.int64)
                segment = at // per_segment
                for s in np.unique(segment).tolist():
                    local = (at[segment == s] % per_segment).astype("<u4")
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([local.tobytes()], pa.binary())], ["s", "at"])

    def joined(key: tuple, found: pa.Table) -> pa.Table:
        """A segment's survivors are at most as many as its bits."""
        on = np.zeros(per_segment, bool)
        for raw in found.column("at"):
            on[np.frombuffer(raw.as_py(), "<u4")] = True
        return pa.table({"s": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())})

    out = bytearray(bits // 8)
    parts = survivors.mapInArrow(run, "s long, at binary").groupBy("s").applyInArrow(joined, "s long, bits binary")
    for row in parts.toLocalIterator():
        out[row.s * per_segment // 8 : (row.s + 1) * per_segment // 8] = row.bits
    return bytes(out), width


def exact_counts(docs: DataFrame, bits: bytes, width: int) -> DataFrame:
    """(lang, words, phrase, a) of all n-grams whose hash is in the bit array; words 0: all words of the language."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    names = ["lang", "words", "phrase", "a"]

    def counted(part: pa.RecordBatch, on: np.ndarray) -> Iterator[pa.RecordBatch]:
        words = Words(part.column(1))
        langs = part.column(0).dictionary_encode()
        lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[words.text]
        n_langs, n_words = len(langs.dictionary), len(words.distinct)
        total = np.bincount(lang, minlength=n_langs)
        yield pa.RecordBatch.from_arrays([langs.dictionary, pa.array([0] * n_langs, pa.int32()), pa.array([""] * n_langs), pa.array(total)], names)
        for n, at, h in grams(words, _seeds(part.column(0))):
            place = h >> np.uint64(64 - width)
            at = at[on[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1 == 1]
            if not len(at):
                continue
            if n_langs * n_words**n < 1 << 62:
                key = lang[at]
                for k in range(n):
                    key = key * n_words + words.codes[at + k]
                key, a = np.unique(key, return_counts=True)
                parts = []
                for _ in range(n):
                    key, code = np.divmod(key, n_words)
                    parts.append(words.distinct.take(pa.array(code)))
                of = key
            else:
                rows, a = np.unique(np.stack([lang[at], *[words.codes[at + k] for k in range(n)]], 1), axis=0, return_counts=True)
                of, parts = rows[:, 0], [words.distinct.take(pa.array(rows[:, k])) for k in range(n, 0, -1)]
            phrase = parts[-1] if n == 1 else pc.binary_join_element_wise(*parts[::-1], " ")
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(of)), pa.array(np.full(len(a), n, np.int32)), phrase, pa.array(a)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.frombuffer(shared.value, np.uint8)
        for part in _slices(batches):
            yield from counted(part, on)
        release()

    found = docs.mapInArrow(run, "lang string, words int, phrase string, a long")
    return found.groupBy("lang", "words", "phrase").agg(F.sum("a").alias("a"))


def frequent(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(lang, words, phrase, a): every n-gram of one to three words with a >= threshold, and n as words 0; in the shared folder."""
    given = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = written(hashed_counts(given, size // PARTITION_BYTES + 1), "grams")
    survivors = written(surviving(blocks, threshold), "survivors")
    discard(blocks)
    bits, width = bit_array(survivors)
    discard(survivors)
    return written(exact_counts(given, bits, width).where((F.col("a") >= threshold) | (F.col("words") == 0)), "frequent")


def collocations(docs: DataFrame, threshold: int = THRESHOLD, top: int = TOP, absorbed: int = ABSORBED) -> DataFrame:
    """The first `top` phrases of two and three words of every language: lang, rank, phrase, a, l, r, n, score.

    Words are runs without space or tab within pieces, which end at `.,;:!?` and line ends; A-Z
    are lower-cased. A phrase's score is that of its weakest cut, floor(10^6 a^2 / (l r)). A
    phrase inside a longer one that has at least `absorbed` hundredths of its occurrences goes. A
    null text is empty, a null language `und`; empty texts and tables give no rows, repeated rows
    count each, ties are ordered by a and phrase. Other columns are not read. Counts may reach
    10^15 (exact decimals).
    """
    all_counts = frequent(docs, threshold)
    counts = all_counts.where("words > 0").select("lang", "phrase", "a")
    long = all_counts.where("words > 1")
    first = F.substring_index("phrase", " ", 1)
    last = F.substring_index("phrase", " ", -1)
    tail = F.expr("substr(phrase, length(substring_index(phrase, ' ', 1)) + 2)")
    cut = lambda k, a, b: F.struct(F.lit(k).alias("k"), a.alias("first"), b.alias("rest"))
    ways = F.when(F.col("words") == 2, F.array(cut(1, first, tail))).otherwise(F.array(cut(1, first, tail), cut(2, F.substring_index("phrase", " ", 2), last)))
    cuts = long.select("lang", "words", "phrase", "a", F.explode(ways).alias("c")).select("lang", "words", "phrase", "a", "c.*")
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.expr("(CAST(a AS decimal(16,0)) * CAST(a AS decimal(16,0)) * CAST(1000000 AS decimal(7,0))) div (CAST(l AS decimal(19,0)) * CAST(r AS decimal(19,0)))")
    weakest = cuts.withColumn("score", score).groupBy("lang", "words", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("w"))
    # the two-word phrases inside three-word ones, with the largest count of those
    inner = F.array(F.substring_index("phrase", " ", 2), tail)
    longer = long.where("words = 3").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("b")).groupBy("lang", "phrase").agg(F.max("b").alias("b"))
    kept = weakest.join(longer.withColumn("words", F.lit(2)), ["lang", "words", "phrase"], "left")
    kept = kept.where(F.col("b").isNull() | (wide("b") * 100 < wide("a") * absorbed)).select("lang", "phrase", "a", "w.l", "w.r", "w.score")
    # the best of parts of each language first, so that no task ranks a whole language
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = kept.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = all_counts.where("words = 0").select("lang", F.col("a").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op13_misra_gries_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, '{UNKNOWN}') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded),
grams AS (
  SELECT lang, 1 AS words, w[i] AS phrase FROM spots
  UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1] FROM spots WHERE i + 1 <= len(w)
  UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM spots WHERE i + 2 <= len(w)),
f AS (SELECT lang, words, phrase, count(*)::HUGEINT AS a FROM grams GROUP BY ALL),
long AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND a >= {THRESHOLD}),
cuts AS (
  SELECT lang, words, phrase, a, 1 AS k, w[1] AS head, array_to_string(w[2:], ' ') AS rest FROM long
  UNION ALL SELECT lang, words, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM long WHERE words = 3),
scored AS (
  SELECT c.*, x.a AS l, y.a AS r, (1000000::HUGEINT * c.a * c.a) // (x.a * y.a) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.rest),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a AS b FROM long WHERE words = 3),
kept AS (
  SELECT * FROM weakest s WHERE NOT EXISTS (
    SELECT 1 FROM inside i WHERE i.lang = s.lang AND i.phrase = s.phrase AND 100 * i.b >= {ABSORBED} * s.a)),
n AS (SELECT lang, sum(a) AS n FROM f WHERE words = 1 GROUP BY lang)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN n USING (lang)
WHERE rank <= {TOP}
"""
QUERIES = {"op13_misra_gries_phrases": op13_misra_gries_phrases}
ORACLE_SQL = {"op13_misra_gries_phrases": SQL}
