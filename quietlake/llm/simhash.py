"""Operator 2: SimHash near-duplicates with pigeonring filtering.

A 64-bit fingerprint is cut into 16 ring segments of 4 bits. If two fingerprints differ in at
most 4 bits, then from some segment on every run of l consecutive segments differs in at most
floor(l / 4) bits: the chain. It has no difference in its first three segments, at most one in
the next four and at most two in the next eight. So one of a few sets of its segments is equal,
which gives the join keys of each start: two of 20 bits, or, for more fingerprints, 4 of 24 bits or
22 of 36 bits. The longer prefixes of the chain (7, 11 and 15 segments) prune what the keys bring
together, and only what passes is checked in full.

Equal fingerprints are one node, so exact copies never meet in the join. A key that more than
hot_bucket distinct fingerprints share is not joined: all fingerprints of such keys are linked
among themselves through the points at most two bits away (two of them link exactly if they
share one), which costs a fixed number of rows each instead of all pairs. Keys grow with the
number of fingerprints, so this is left to fingerprints that really crowd together.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, discard, map_texts, shuffled, table, written
from .paragraph_dedup import _MULTIPLY, _STEP, _XOR, _mix, similar_in_blocks, tuned_bands

BITS, SEGMENTS, WIDTH, DISTANCE = 64, 16, 4, 4
HOT_BUCKET = 1000
#: Segments of a chain, counted from its start, of which one set must be equal; by the distinct fingerprints up to which it serves.
KEYS = (
    (1 << 22, ((0, 1, 2, 3, 4), (0, 1, 2, 5, 6))),
    (1 << 26, tuple((0, 1, 2, *(i for i in range(3, 7) if i != e)) for e in range(3, 7))),
    (
        1 << 62,
        (
            *((0, 1, 2, *(i for i in range(3, 11) if i not in (e, f))) for e in range(3, 7) for f in range(7, 11)),
            *((0, 1, 2, 3, 4, 5, 6, *pair) for pair in combinations(range(7, 11), 2)),
        ),
    ),
)
#: Prefix lengths of a chain with the bits in which they may differ; shorter ones follow from these.
BUDGETS = ((3, 0), (7, 1), (11, 2), (15, 3), (16, 4))


def fingerprint(text: str | None, shingle_words: int) -> int:
    """Bit is 1 if set in over half the shingles' XXH64; A-Z lower-cased, ASCII white space between words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    data, n = b" ".join(words), len(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle_words:
        return digest(data, 42)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    ones, total = np.zeros(64, np.int64), n - shingle_words + 1
    for at in range(0, total, 65536):
        i, j = starts[at : min(at + 65536, total)].tolist(), ends[at + shingle_words - 1 :][:65536].tolist()
        h = np.fromiter((digest(data[a:b], 42) for a, b in zip(i, j)), np.uint64, len(i))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle_words: int = 4) -> DataFrame:
    """(doc_id, fp): fp as a signed long. A text that is null or has no word gets 0."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fps = np.array([fingerprint(t.as_py(), shingle_words) for t in batch.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs.select("doc_id", "text"), work, f"doc_id {kind}, fp long")


def _rotated(x: Column, start: Column) -> Column:
    """The 64-bit ring turned so that segment `start` is lowest."""
    by = start * WIDTH
    return F.when(start == 0, x).otherwise(F.call_function("shiftrightunsigned", x, by).bitwiseOR(F.call_function("shiftleft", x, F.lit(BITS) - by)))


def _mask(segments: int) -> Column:
    return F.lit(-1 if segments == SEGMENTS else (1 << (segments * WIDTH)) - 1).cast("long")


def _chain(x: Column, start: Column) -> Column:
    """Whether the differences x keep every budget from `start` on."""
    turned = _rotated(x, start)
    ok = F.lit(True)
    for segments, most in BUDGETS:
        ok = ok & (F.bit_count(turned.bitwiseAND(_mask(segments))) <= most)
    return ok


def _begins(x: Column, start: Column) -> Column:
    """Whether the chain before this one is broken.

    Distinct fingerprints differ in some segment, where no chain can start; so every linked pair
    has such a start, and is found a few times instead of from nearly all starts.
    """
    return ~_chain(x, (start + (SEGMENTS - 1)) % SEGMENTS)


def keys_for(distinct: int) -> tuple[tuple[int, ...], ...]:
    """The sets of segments whose keys suit so many distinct fingerprints."""
    return next(sets for most, sets in KEYS if distinct <= most)


def _keys(nodes: DataFrame, sets: tuple[tuple[int, ...], ...]) -> DataFrame:
    """A key for each start and each of the sets of segments, counted from the start."""
    at = nodes.withColumn("start", F.explode(F.array(*[F.lit(i) for i in range(SEGMENTS)])))
    turned = _rotated(F.col("fp"), F.col("start"))
    keys = []
    for n, segments in enumerate(sets):
        mask = sum(((1 << WIDTH) - 1) << (WIDTH * i) for i in segments)
        keys.append(F.struct(F.lit(n).alias("set"), turned.bitwiseAND(F.lit(mask).cast("long")).alias("bits")))
    return at.select("fp", "rep", "start", F.explode(F.array(*keys)).alias("k")).select("fp", "rep", "start", F.xxhash64("start", "k.set", "k.bits").alias("key"))


def _around(nodes: DataFrame) -> DataFrame:
    """Every point at most two bits from each fingerprint."""
    flips = [0, *[1 << i for i in range(64)], *[(1 << i) | (1 << j) for i, j in combinations(range(64), 2)]]
    masks = np.array(flips, np.uint64).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                fp, rep = (c.to_numpy() for c in batch.slice(at, 256).columns)
                points = (fp[:, None] ^ masks[None, :]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(points), pa.array(np.repeat(rep, len(masks)))], ["point", "rep"])

    return nodes.select("fp", "rep").mapInArrow(run, "point long, rep long")


def links(nodes: DataFrame, hot_bucket: int = HOT_BUCKET, sets: tuple[tuple[int, ...], ...] | None = None) -> DataFrame:
    """Edges (u, v) between rep of nodes (fp, rep) whose connectivity is that of all links.

    fp are distinct. Pairs that share a key of at most hot_bucket fingerprints are joined and
    checked; fingerprints with a fuller key are linked through shared points, both exactly.
    """
    keys = _keys(nodes, sets or keys_for(nodes.count()))
    full = written(keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot_bucket).select("key"), "hotkeys")
    hot = bool(full.take(1))
    cold = shuffled(keys.join(full, "key", "left_anti") if hot else keys)
    a, b = cold.alias("a"), cold.select("key", F.col("fp").alias("fp2"), F.col("rep").alias("rep2")).alias("b")
    x = F.col("fp").bitwiseXOR(F.col("fp2"))
    same = (F.col("a.key") == F.col("b.key")) & (F.col("rep") > F.col("rep2")) & _chain(x, F.col("start"))
    pairs = a.join(b, same & _begins(x, F.col("start")))
    pairs = pairs.select(F.col("rep").alias("u"), F.col("rep2").alias("v")).distinct()
    if not hot:
        return pairs
    points = _around(keys.join(full, "key", "left_semi").select("fp", "rep").distinct())
    least = points.groupBy("point").agg(F.min("rep").alias("v"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = shuffled(points).join(least, "point").where("rep <> v").select(F.col("rep").alias("u"), "v").distinct()
    return pairs.union(shared)


def near_duplicates(docs: DataFrame, shingle_words: int = 4, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """One row per row of docs: doc_id (a long), fp, component_id, the smallest doc_id that it reaches.

    Documents link if their fingerprints differ in at most 4 bits. Null and empty texts have
    fingerprint 0 and link like any others. Rows with a null doc_id take part (others may reach each
    other through them) but never name a component; one that reaches no doc_id has a null
    component_id. Repeated rows stay, each with its component. An empty table gives no rows;
    other columns are not read.
    """
    found = written(fingerprints(docs, shingle_words), "fingerprints")
    nodes = written(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp", F.col("fp").alias("rep")), hot_bucket)).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(names, "root").select("fp", "component_id")
    return found.join(classes, "fp").select("doc_id", "fp", "component_id")


def fingerprint_classes(docs: DataFrame, shingle_words: int = 4) -> DataFrame:
    """(doc_id, text_hash, component_id, component_key) as similar_documents() has them, of near_duplicates(): fingerprints of at most 4 differing bits. Null doc_ids take no part."""
    each = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    out = near_duplicates(docs.where("doc_id IS NOT NULL").select(each.alias("doc_id"), "text"), shingle_words)
    return out.select("doc_id.*", F.col("component_id.doc_id").alias("component_id"), F.col("component_id").alias("component_key"))


#: Candidates for similar_documents(): the bands of MinHashes of shingles that find a pair at the threshold with this recall.
BAND_RECALL, MOST_HASHES = 0.9995, 64


def shingle_set(words: list[bytes], size: int) -> np.ndarray:
    """Distinct hashes of the runs of `size` words; of fewer words, of all of them; none for no word."""
    n = min(size, len(words))
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out = np.zeros(max(1, len(words) - size + 1), np.uint64)
    for j in range(n):
        out = _mix(out * _MULTIPLY[0] + h[j : len(out) + j])
    return np.unique(out)


def band_keys(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key (signed) for each band of the set's MinHash signature."""
    out = np.zeros(bands, np.uint64)
    for b in range(bands):
        for k in range(b * rows, (b + 1) * rows):
            out[b : b + 1] = _mix(out[b : b + 1] * _MULTIPLY[1] + ((shingles ^ _XOR[k]) * _MULTIPLY[k]).min())
    return _mix(out + np.arange(bands, dtype=np.uint64) * _STEP).view(np.int64)


#: Rows and shingles that a block of one group of candidates may have.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 4_000_000


def similar_documents(docs: DataFrame, shingle_words: int = 5, threshold: float = 0.8, block: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, text_hash, component_id, component_key): documents connected by Jaccard similarity >= threshold on word shingles.

    For similarities that are not as high as 4 bits of one fingerprint of shingles ask for: at 0.8
    two of them differ in about 10 of 64 bits, too many for keys that select. Equal word sequences
    are one text. Texts that share a band of the MinHash signature of their shingles are
    candidates, whatever the kind of edit; among these the exact similarity decides, block by
    block, and groups that several bands bring together are compared once. Texts with fewer words
    than a shingle are compared as one shingle. component_id is the smallest doc_id of the
    component; text_hash (xxhash64 of the text) tells the rows of a repeated doc_id apart, which
    are texts of their own, and component_key their components. Null doc_ids take no part.
    """
    bands, rows = tuned_bands(threshold, BAND_RECALL, MOST_HASHES)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, keys, sizes = [], [], []
        for t in batch.column(2):
            words = (t.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
            texts.append(xxhash.xxh3_64_intdigest(b" ".join(words)))
            shingles = shingle_set(words, shingle_words)
            keys.append(band_keys(shingles, bands, rows)), sizes.append(len(shingles))
        flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * bands), flat)
        content = pa.array(np.array(texts, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), content, lists, pa.array(sizes, pa.int32())], ["doc_id", "text_hash", "content", "keys", "size"])

    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    found = written(map_texts(docs, work, "doc_id long, text_hash long, content long, keys array<long>, size int"), "signatures")
    least = F.min(F.struct("doc_id", "text_hash")).alias("first")
    texts = written(found.groupBy("content").agg(least, F.first("keys").alias("keys"), F.first("size").alias("size")), "texts")
    keys = texts.select("content", "size", F.explode("keys").alias("key"))
    who = [F.bit_xor(F.xxhash64("content")).alias("who"), F.bit_xor(F.xxhash64("content", F.lit(1))).alias("who2")]
    full = keys.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"), *who).where("n > 1")
    once = full.groupBy("n", "who", "who2").agg(F.min("key").alias("key"), F.min("shingles").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("n") / block, F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    met = written(shuffled(keys).join(once, "key").select("key", "content", blocks), "collisions")

    def shingle(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = [shingle_set((t.as_py() or "").encode("utf-8", "surrogatepass").lower().split(), shingle_words).view(np.int64) for t in batch.column(1)]
        cuts = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(sets)))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["content", "set"])

    wanted = texts.join(met.select("content").distinct(), "content", "left_semi").select("content", "first.doc_id", "first.text_hash")
    members = shuffled(docs).join(wanted, ["doc_id", "text_hash"]).select("content", "text").dropDuplicates(["content"])
    sets = written(map_texts(members, shingle, "content long, set array<long>"), "shingles")
    edges = written(similar_in_blocks(met, sets, threshold), "similar")
    discard(met), discard(sets)
    roots = components(edges).withColumnRenamed("node", "content")
    rooted = texts.join(roots, "content", "left").select("content", F.coalesce("root", "content").alias("root"), F.col("first.doc_id").alias("least"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(names, "root").select("content", "root", "component_id")
    return found.join(classes, "content").select("doc_id", "text_hash", "component_id", F.col("root").alias("component_key"))


def first_of_each(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """docs with one row for each component of these classes: that of the smallest doc_id (of its texts, of the smallest hash). Rows without a doc_id stay."""
    first = classes.groupBy("component_key").agg(F.min(F.struct("doc_id", "text_hash")).alias("f")).select(F.col("f.doc_id").alias("doc_id"), F.col("f.text_hash").alias("_hash"))
    hashed = docs.withColumn("_hash", F.xxhash64("text"))
    kept = hashed.join(first, ["doc_id", "_hash"], "left_semi").dropDuplicates(["doc_id", "_hash"]).select(*docs.columns)
    return kept.unionByName(docs.where("doc_id IS NULL"))


def op2_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op2_simhash_pigeonring": op2_simhash_pigeonring}
ORACLE_SQL: dict[str, str] = {}
