"""Operator 10: passages that repeat across documents, by paragraph MinHash banding.

Paragraphs (lines of at least MIN_WORDS words) of equal words are one content. Distinct ones that
collide in a band of their MinHash signature meet in blocks of bounded size, where exact Jaccard
similarity on five-word shingles decides; connected components of what passes are the classes.
In each class that spans documents the unit with the smallest (doc_id, place) stays and the
others are removals.

So that a passage spliced into other text or wrapped otherwise is found too, seeds of SEED words
are chosen by winnowing (the smallest hash of every WINNOW consecutive starts): every run of
SEED + WINNOW - 1 = 25 words that two documents share has a seed in common. A passage of over 50
words with a similarity of 0.8 has such a run: e separate edits cost at least 5 e of its shingles,
which are at most a ninth of them, so the longest of the e + 1 runs between has 25 words or more.
Each place of a seed is compared with the seed's first place: the common run is grown word by word
to its ends, then over edited places to the next common shingle, and of the chain of runs every
stretch of at least MIN_WORDS words and a similarity of 0.8 is a removal. A removed word thus
still stands, in its context, in an earlier place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, discard, map_texts, release, shuffled, table, written

SHINGLE, MIN_WORDS, SEED, WINNOW = 5, 24, 16, 10
THRESHOLD, RECALL = 0.8, 0.995
#: Distinct contents of one band that are compared in one task; fuller bands are split into blocks.
BLOCK = 1024
#: Shingles, of two sets or more, and ids that are looked at in one go: bounds the arrays of a block.
COLUMNS, STRIPE = 2048, 128
#: Documents whose words a task keeps while it compares pairs.
KEPT = 32


def tuned_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 32) -> tuple[int, int]:
    """(bands, rows): the most selective banding with at most `most` hashes that finds pairs at the threshold with this recall."""
    best = (most, 1)
    for rows in range(1, most + 1):
        for bands in range(1, most // rows + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                best = (bands, rows)
                break
    return best


_RNG = np.random.default_rng(20)
_MULTIPLY = _RNG.integers(1 << 62, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _RNG.integers(1 << 63, size=64, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, _STEP, np.uint64))


def words_of(text: str) -> tuple[list[bytes], list[int]]:
    """Lower-cased (A-Z) words between ASCII white space, and how many each line has."""
    lines = [line.split() for line in text.encode("utf-8", "surrogatepass").lower().split(b"\n")]
    return [w for line in lines for w in line], [len(line) for line in lines]


def shingles(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and of their runs of SHINGLE words."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if len(words) < SHINGLE:
        return h, h[:0]
    n = len(words) - SHINGLE + 1
    return h, _mix(sum(h[j : n + j] * _MULTIPLY[j] for j in range(SHINGLE)))


def winnowed(hashes: np.ndarray) -> np.ndarray:
    """Places of the smallest of every WINNOW consecutive hashes (of all, if they are fewer)."""
    if len(hashes) <= WINNOW:
        return np.array([hashes.argmin()])
    low, size = hashes, 1
    while size < WINNOW:  # minima of ever longer windows
        step = min(size, WINNOW - size)
        low, size = np.minimum(low[:-step], low[step:]), size + step
    at = np.full(len(low), WINNOW - 1)
    for k in range(WINNOW - 2, -1, -1):  # the first of equal ones
        at[hashes[k : k + len(low)] == low] = k
    at += np.arange(len(low))
    return at[np.concatenate(([True], at[1:] != at[:-1]))]  # they never go back


def _grouped(x: np.ndarray, m: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """x and m in groups that make at most 64K numbers of n each."""
    size = max(1, 65_536 // n)
    for at in range(0, len(x), size):
        yield x[at : at + size], m[at : at + size]


def doc_units(text: str, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths (words) and contents of the units of a text, lines before seeds, and the lines' band keys."""
    words, sizes = words_of(text)
    none = np.zeros(0, np.int64)
    if len(words) < MIN_WORDS:
        return none, none, none, none.reshape(0, bands)
    _, s = shingles(words)
    ends = np.cumsum(sizes)
    long = np.array(sizes) >= MIN_WORDS
    start, stop = (ends - sizes)[long], ends[long]
    power = _powers(max([MIN_WORDS, *(stop - start)]))
    content = np.array([(s[a : b - SHINGLE + 1] * power[: b - a - SHINGLE + 1]).sum() for a, b in zip(start.tolist(), stop.tolist())], np.uint64)
    keys = none.reshape(0, bands)
    if len(start):
        pairs = np.stack([start, stop - SHINGLE + 1], 1).ravel()
        tail = np.append(s, ~np.uint64(0))
        out = np.zeros((bands, len(start)), np.uint64)
        for r in range(rows):  # hashes of all bands at once, of as many words as stay in the processor's cache
            k = np.arange(r, bands * rows, rows)
            low = [np.minimum.reduceat((tail ^ x[:, None]) * m[:, None], pairs, axis=1)[:, ::2] for x, m in _grouped(_XOR[k], _MULTIPLY[k], len(tail))]
            out = (out + np.concatenate(low)) * _MULTIPLY[63 - r]
        keys = _mix(out + np.arange(bands, dtype=np.uint64)[:, None] * _STEP).T.view(np.int64)
    seeds = sum(s[j : len(words) - SEED + 1 + j] * power[j] for j in range(SEED - SHINGLE + 1))
    at = winnowed(_mix(seeds))
    windows = seeds[at]
    starts = np.concatenate([start, at])
    lengths = np.concatenate([stop - start, np.full(len(at), SEED)])
    contents = _mix(np.concatenate([content, windows]) + lengths.astype(np.uint64) * _STEP).view(np.int64)
    return starts, lengths, contents, keys


def units(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(doc_id, start, words, content, keys) of every unit; keys is null for seeds."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        row, starts, lengths, contents, keys, line = [], [], [], [], [], []
        for i, t in enumerate(batch.column(1)):
            a, n, c, k = doc_units(t.as_py() or "", bands, rows)
            row.append(np.full(len(a), i)), starts.append(a), lengths.append(n), contents.append(c)
            keys.append(k.ravel()), line.append(np.arange(len(a)) < len(k))
        out = [pa.array(np.concatenate(x)) for x in (row, starts, lengths, contents)]
        lines = np.concatenate(line)
        edges = np.concatenate(([0], np.cumsum(lines * bands))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.ascontiguousarray(np.concatenate(keys))), mask=pa.array(~lines))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(out[0]), out[1].cast(pa.int32()), out[2].cast(pa.int32()), out[3], lists], ["doc_id", "start", "words", "content", "keys"]
        )

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, start int, words int, content long, keys array<long>")


def forest(ids: list[int], sets: list[np.ndarray], threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Edges that connect what pairs of Jaccard similarity >= threshold connect, at most one for each id."""
    n = len(ids)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    values, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.full(len(values), -1)
    column[df > 1] = np.arange((df > 1).sum())
    col = column[inverse]
    owner, col = owner[col >= 0], col[col >= 0]
    common = np.zeros((n, n), np.float32)
    x = np.zeros((n, COLUMNS), np.float32)
    for at in range(0, int((df > 1).sum()), COLUMNS):
        part = (col >= at) & (col < at + COLUMNS)
        x[:] = 0
        x[owner[part], col[part] - at] = 1
        common += x @ x.T
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    out = []
    for k in range(0, n, STRIPE):
        mine = common[k : k + STRIPE]
        union = sizes[k : k + STRIPE, None] + sizes[None, :] - mine
        rows, columns = np.nonzero(np.triu(mine >= threshold * union - 1e-6, k + 1))
        for i, j in zip((rows + k).tolist(), columns.tolist()):
            a, b = find(i), find(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((ids[i], ids[j]))
    return out


def _with_shingles(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(content, set): the distinct shingle hashes of each content, from the document at its place."""
    wanted = places.groupBy("doc_id").agg(F.collect_list(F.struct("content", "start", "words")).alias("wanted"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    both = wanted.join(shuffled(texts), "doc_id").select("text", "wanted")

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, sets = [], []
        for t, w in zip(batch.column(0), batch.column(1).to_pylist()):
            words, _ = words_of(t.as_py())
            for u in w:
                mine = words[u["start"] : u["start"] + u["words"]]
                ids.append(u["content"]), sets.append(np.unique(shingles(mine)[1]).view(np.int64))
        edges = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists], ["content", "set"])

    return map_texts(both, work, "content long, set array<long>").dropDuplicates(["content"])


def similar(docs: DataFrame, paragraphs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) between contents of paragraphs (content, doc_id, start, words, keys; contents distinct)."""
    keys = paragraphs.select("content", F.explode("keys").alias("key"))
    full = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = written(shuffled(keys).join(full, "key").select("key", "content", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "collisions")
    places = paragraphs.select("content", "doc_id", "start", "words").join(met.select("content").distinct(), "content", "left_semi")
    sets = written(_with_shingles(docs, places), "shingles")
    edges = written(similar_in_blocks(met, sets), "similar")
    discard(met), discard(sets)
    return edges


def similar_in_blocks(met: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Edges (u, v) that connect what pairs of a group of Jaccard similarity >= threshold connect.

    met: key, content, blocks (into how many the group is split); sets: content, set. A task
    holds one block or two of a group, and hands on a forest, not all pairs.
    """
    mine = F.pmod(F.xxhash64("content"), F.col("blocks")).cast("int")
    # in a band of one block only its own; else every pair of blocks has a task that sees both
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, mine).alias("a"), F.greatest(o, mine).alias("b")))
    members = met.select("key", "content", F.explode(pairs).alias("p")).select("content", F.xxhash64("key", "p.a", "p.b").alias("task"))
    members = shuffled(members).join(sets, "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        lists: list[np.ndarray] = []
        now = None
        u: list[int] = []
        v: list[int] = []

        def flush() -> None:
            if len(ids) > 1:
                edges = forest(ids, lists, threshold)
                u.extend(a for a, _ in edges)
                v.extend(b for _, b in edges)
            ids.clear(), lists.clear()

        for batch in batches:
            tasks, contents = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            values, cuts = batch.column(2).flatten().to_numpy(), np.concatenate(([0], np.cumsum(np.diff(batch.column(2).offsets.to_numpy())))).tolist()
            for i, t in enumerate(tasks):
                if t != now:
                    flush()
                    now = t
                ids.append(contents[i]), lists.append(values[cuts[i] : cuts[i + 1]])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
            u.clear(), v.clear()
        flush()
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
        release()

    ordered = members.select("task", "content", "set").repartition("task").sortWithinPartitions("task", "content")
    return ordered.mapInArrow(run, "u long, v long").distinct()


def _places(units: DataFrame) -> DataFrame:
    """content, its first place (doc_id, start) and its last document."""
    return units.groupBy("content").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.max("doc_id").alias("last"))


def _next(s: np.ndarray, t: np.ndarray, a: int, b: int, far: int) -> tuple[int, int] | None:
    """The nearest places from a and b on, at most `far` further, with a shingle in common."""
    x, y = s[a : a + far + 1], t[b : b + far + 1]
    if far <= 64:  # by hand, where arrays are too small to be worth it
        place: dict[int, int] = {}
        for j, v in enumerate(y.tolist()):
            place.setdefault(v, j)
        met = [(i + place[v], i, place[v]) for i, v in enumerate(x.tolist()) if v in place]
        if not met:
            return None
        _, i, j = min(met)
        return a + i, b + j
    _, i, j = np.intersect1d(x, y, return_indices=True)
    if not len(i):
        return None
    k = (i + j).argmin()
    return a + int(i[k]), b + int(j[k])


def _run(x: np.ndarray, y: np.ndarray, a: int, b: int) -> int:
    """How many words are equal from a and b on."""
    n, size = min(len(x) - a, len(y) - b), 32
    at = 0
    while at < n:
        differ = np.flatnonzero(x[a + at : a + min(n, at + size)] != y[b + at : b + min(n, at + size)])
        if len(differ):
            return at + int(differ[0])
        at, size = at + size, size * 4
    return max(n, 0)


def _onward(x: np.ndarray, y: np.ndarray, s: np.ndarray, t: np.ndarray, a: int, b: int, words: int) -> list[tuple[int, int, int]]:
    """Common runs (start, start, words) that follow the ends a and b of a run over edits that its length bears."""
    out: list[tuple[int, int, int]] = []
    while met := _next(s, t, a, b, 4 + words // 8):
        n = _run(x, y, *met)
        if n < SHINGLE:  # equal hashes of different words
            break
        out.append((*met, n))
        words += n
        a, b = met[0] + n, met[1] + n
    return out


def grow(x: np.ndarray, y: np.ndarray, seeds: list[tuple[int, int]], threshold: float = THRESHOLD, s: np.ndarray | None = None, t: np.ndarray | None = None) -> list[tuple[int, int, int, int]]:
    """(start, stop, start, stop) of the passages around seeds (places in x and in y) that the texts of word hashes x and y share. s, t: their shingles, if known."""
    s, t = (_shingled(h) if given is None else given for h, given in ((x, s), (y, t)))
    runs: dict[int, list[tuple[int, int]]] = {}
    out: list[tuple[int, int, int, int]] = []
    reach = 0
    for i, j in sorted(seeds):
        if i + SEED + WINNOW - 1 <= reach:  # well within a removal: a passage that goes on past its end has a later seed
            continue
        if any(a <= i < b for a, b in runs.get(i - j, ())) or not np.array_equal(x[i : i + SEED], y[j : j + SEED]) or len(x) < i + SEED:
            continue
        back = _run(x[:i][::-1], y[:j][::-1], 0, 0)
        first = (i - back, j - back, back + _run(x, y, i, j))
        before = _onward(x[::-1], y[::-1], s[::-1], t[::-1], len(x) - first[0], len(y) - first[1], first[2])
        before = [(len(x) - a - n, len(y) - b - n, n) for a, b, n in reversed(before)]
        chain = [*before, first, *_onward(x, y, s, t, first[0] + first[2], first[1] + first[2], first[2])]
        for a, b, n in chain:
            runs.setdefault(a - b, []).append((a, a + n))
        if len(chain) == 1:
            a, b, n = first
            if n >= MIN_WORDS:
                out.append((a, a + n, b, b + n))
                reach = max(reach, a + n)
            continue
        a, b, n = (np.array(c) for c in zip(*chain))
        total = np.concatenate(([0], np.cumsum(np.maximum(n - SHINGLE + 1, 0))))
        for k in range(len(chain)):
            common = total[k + 1 :] - total[k]
            long, other = a[k:] + n[k:] - a[k], b[k:] + n[k:] - b[k]
            union = long + other - 2 * (SHINGLE - 1) - common
            ok = np.flatnonzero((common >= threshold * union - 1e-9) & (long >= MIN_WORDS))
            if len(ok):
                e = k + int(ok[-1])
                out.append((int(a[k]), int(a[e] + n[e]), int(b[k]), int(b[e] + n[e])))
                if a[k] <= i:
                    reach = max(reach, out[-1][1])
    return out


def grow_within(x: np.ndarray, s: np.ndarray, seeds: list[tuple[int, int]], threshold: float = THRESHOLD) -> list[tuple[int, int, int, int]]:
    """The same for seeds (a place and an earlier one) within one text, each from its later place on; s: its shingles."""
    out, reach = [], 0
    for i, j in sorted(seeds):
        if i <= j or i + SEED + WINNOW - 1 <= reach:
            continue
        for a, b, e, f in grow(x[i:], x[:i], [(0, j)], threshold, s[i:], s[: max(i - SHINGLE + 1, 0)]):
            out.append((a + i, b + i, e, f))
            reach = max(reach, b + i if a == 0 else 0)
    return out


def _shingled(h: np.ndarray) -> np.ndarray:
    n = len(h) - SHINGLE + 1
    return _mix(sum(h[j : n + j] * _MULTIPLY[j] for j in range(SHINGLE))) if n > 0 else h[:0]


def grown(docs: DataFrame, seeds: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, start, stop, class_doc, keep) of the passages around seeds that stand in several documents.

    A place of a seed is compared with the seed's first place. Within a document a passage
    counts only where another document has its seed too, and is cut from the seed on.
    """
    shared = _places(seeds).where("first.doc_id < last").select("content", "first")
    at = seeds.select("doc_id", "start", "content").join(shared, "content").where("doc_id <> first.doc_id OR start <> first.start")
    pairs = at.groupBy("doc_id", F.col("first.doc_id").alias("head")).agg(F.collect_set(F.struct("start", F.col("first.start").alias("other"))).alias("seeds"))
    pairs = written(pairs, "pairs")  # seeds are not read from here on
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    heads = texts.join(pairs.select(F.col("head").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("head"), F.col("text").alias("other"))
    both = shuffled(pairs).join(heads, "head").join(shuffled(texts), "doc_id").select("doc_id", "head", "seeds", "other", "text")

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, int, int, bool]] = []
        recent: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def hashed(i: int, text: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
            """Words and shingles of document i, kept while other pairs of it are near."""
            if i not in recent:
                if len(recent) >= KEPT:
                    recent.pop(next(iter(recent)))
                h = np.fromiter(map(xxhash.xxh64_intdigest, text.as_py().encode("utf-8", "surrogatepass").lower().split()), np.uint64)
                recent[i] = h, _shingled(h)
            return recent[i]

        for d, h, found, other, text in zip(*(batch.column(i) for i in range(5))):
            d, h = d.as_py(), h.as_py()
            x, s = hashed(d, text)
            seeds = [(p["start"], p["other"]) for p in found.as_py()]
            if d != h:
                y, t = hashed(h, other)
                spans = grow(x, y, seeds, threshold, s, t)
            else:
                spans = grow_within(x, s, seeds, threshold)
            for a, b, e, f in spans:
                rows += [(d, a, b, h, False), (h, e, f, h, True)]
        rows = list(dict.fromkeys(rows))
        out = list(zip(*rows)) or [[]] * 5
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "start", "stop", "class_doc", "keep"])

    return map_texts(both, work, "doc_id long, start int, stop int, class_doc long, keep boolean")


def identified(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """docs with a doc_id of its own for each text, and (uid, doc_id) of the texts that had to share one (None if none had to).

    The text of the smallest hash keeps the doc_id; others get a large number made of both.
    """
    docs = docs.where("doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id").cast("long"))
    h = F.xxhash64("text")
    spread = docs.groupBy("doc_id").agg(F.min(h).alias("_lo"), F.max(h).alias("_hi")).where("_lo <> _hi").select("doc_id", "_lo")
    spread = written(spread, "sharedids")
    if not spread.take(1):
        return docs, None
    made = F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 61) - 1)).bitwiseOR(F.lit(1 << 61))
    both = docs.join(spread, "doc_id", "left").withColumn("_uid", F.when(F.col("_lo").isNull() | (h == F.col("_lo")), F.col("doc_id")).otherwise(made))
    names = both.where("_lo IS NOT NULL").select(F.col("_uid").alias("uid"), "doc_id").distinct()
    return both.withColumn("doc_id", F.col("_uid")).select(*docs.columns), written(names, "uids")


def repeats(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Repeated passages: doc_id, start, words (counted in words of the text), class_doc, keep.

    One row per run of units of the same fate: keep for the first places of their classes,
    not keep for removals; class_doc is the smallest doc_id that the run's first unit repeats in.
    Only classes over at least two documents count; documents without such a unit have no rows. A null
    or short text has no units. Rows of one doc_id with different texts are documents of their
    own, equal rows are one. Documents without a doc_id take no part. An empty table gives no
    rows; other columns are not read.
    """
    own, names = identified(docs.select("doc_id", "text"))
    return _named(_repeats(own, threshold, block), names)


def _named(found: DataFrame, names: DataFrame | None) -> DataFrame:
    for c in ("doc_id", "class_doc") if names is not None else ():
        known = names.select(F.col("uid").alias(c), F.col("doc_id").alias("_name"))
        found = found.join(known, c, "left").withColumn(c, F.coalesce("_name", c)).drop("_name")
    return found.select("doc_id", "start", "words", "class_doc", "keep")


def _repeats(docs: DataFrame, threshold: float, block: int) -> DataFrame:
    bands, rows = tuned_bands(threshold)
    found = written(units(docs, bands, rows), "units")
    lines_found = found.where("keys IS NOT NULL")
    contents = _places(lines_found)
    lines = lines_found.groupBy("content").agg(F.min(F.struct("doc_id", "start", "words", "keys")).alias("u")).select("content", "u.*")
    lines = written(lines, "paragraphs")
    roots = components(similar(docs, lines, block))
    rooted = roots.select(F.col("node").alias("content"), "root").union(roots.select(F.col("root").alias("content"), "root").distinct())
    members = contents.join(rooted.distinct(), "content", "left").where("root IS NOT NULL OR first.doc_id < last")
    members = written(members.withColumn("root", F.coalesce("root", "content")), "members")
    discard(lines), discard(roots)
    classes = members.groupBy("root").agg(F.min("first").alias("head"), F.max("last").alias("last")).where("head.doc_id < last")
    kept = members.join(classes.select("root", "head"), "root").select("content", "head")
    each = lines_found.select("doc_id", "start", "words", "content").join(kept, "content")
    each = each.select(
        "doc_id", "start", (F.col("start") + F.col("words")).alias("stop"), F.col("head.doc_id").alias("class_doc"),
        ((F.col("doc_id") == F.col("head.doc_id")) & (F.col("start") == F.col("head.start"))).alias("keep"),
    )
    each = written(each, "lines")
    grew = grown(docs, found.where("keys IS NULL"), threshold)
    discard(members), discard(found)
    return _joined(each.unionByName(grew))


def _joined(spans: DataFrame) -> DataFrame:
    """Overlapping or touching spans of a document and fate as one; a document's spans are bounded by its text."""
    w = Window.partitionBy("doc_id", "keep").orderBy("start", "stop", "class_doc")
    before = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    begins = spans.withColumn("_new", (before.isNull() | (F.col("start") > before)).cast("int"))
    runs = begins.withColumn("_run", F.sum("_new").over(w)).groupBy("doc_id", "keep", "_run")
    out = runs.agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min_by("class_doc", F.struct("start", "stop", "class_doc")).alias("class_doc"))
    return out.select("doc_id", "start", (F.col("stop") - F.col("start")).alias("words"), "class_doc", "keep")


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """docs without the passages that an earlier document has, and without documents of which nothing is left; rows without a doc_id stay as they are."""
    own, names = identified(docs)
    removals = written(_repeats(own.select("doc_id", "text"), threshold, block).where("NOT keep"), "removals")
    out = without(own, removals)
    if names is not None:
        out = out.join(names.select(F.col("uid").alias("doc_id"), F.col("doc_id").alias("_name")), "doc_id", "left").withColumn("doc_id", F.coalesce("_name", "doc_id"))
    kind = docs.schema["doc_id"].dataType
    return out.withColumn("doc_id", F.col("doc_id").cast(kind)).select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def without(docs: DataFrame, removals: DataFrame) -> DataFrame:
    """docs with the words of removals (doc_id, start, words) cut from text; documents left without a word go."""
    cuts = removals.groupBy("doc_id").agg(F.collect_list(F.struct("start", "words")).alias("_cuts"))
    columns = docs.columns
    both = docs.join(cuts, "doc_id", "left").select(*columns, "_cuts")
    at = columns.index("text")

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = []
        for t, cut in zip(batch.column(at), batch.column(len(columns)).to_pylist()):
            text = t.as_py()
            texts.append(_cut(text, [(c["start"], c["words"]) for c in cut]) if cut and text else text)
        out = list(batch.columns[:-1])
        out[at] = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays(out, columns)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = map_texts(both, work, schema)
    return out.where(F.col("text").isNull() | F.col("text").rlike(r"\S"))


def _cut(text: str, cuts: list[tuple[int, int]]) -> str:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    space = (points == 32) | ((points >= 9) & (points <= 13))
    edge = np.diff(np.concatenate(([1], space.astype(np.int8), [1])))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    out, at = [], 0
    for start, words in sorted(cuts):
        out.append(text[at : max(at, int(begin[start]))])
        at = max(at, int(end[start + words - 1]))
    return "".join([*out, text[at:]])


def op10_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op10_paragraph_minhash": op10_paragraph_minhash}
ORACLE_SQL: dict[str, str] = {}
