"""Operator 9: approximate nearest neighbours by additive quantisation.

Unit vectors are approximated by sums of codewords, one from each of BOOKS full-dimensional
codebooks. The books start as k-means of successive residuals on a bounded sample and are then
refitted jointly by least squares; every row is encoded by a beam search and keeps its codes and
the norm of its approximation. Only codes and norms meet the queries: a query scores every row
by table look-ups (one table of inner products per query) over the stored norm. The shortlists of
the blocks are merged to one of each query, and only its rows are fetched to be reranked by the
exact cosine of the original vectors. Equal vectors have equal codes, so they are searched as one,
which stands for the few of them that can be answers; else they would crowd each other out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .vectors import answer, best, blocks_of, bucket, matrix, sample, valid_vectors

#: Bound of the training sample. Every row is encoded and searched.
SAMPLE = 8192
BOOKS, WORDS, BEAM = 16, 128, 4
BLOCK_ROWS, QUERY_ROWS, SHORTLIST = 65_536, 1024, 512


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    centers = x[rng.permutation(len(x))[:k]]
    if len(centers) < k:
        centers = np.vstack([centers, np.zeros((k - len(centers), x.shape[1]))])
    for _ in range(rounds):
        label = (x @ centers.T - (centers**2).sum(1) / 2).argmax(1)
        n = np.bincount(label, minlength=k)
        hot = np.zeros((k, len(x)), np.float32)
        hot[label, np.arange(len(x))] = 1
        centers = np.where(n[:, None] > 0, (hot @ x) / np.maximum(n, 1)[:, None], centers)
    return centers


def train(x: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 7) -> np.ndarray:
    """Codebooks (book x word x dimension) for the unit vectors x."""
    rng = np.random.default_rng(seed)
    rest, out = x.copy(), []
    for _ in range(books):
        centers = _kmeans(rest, words, rng)
        rest = rest - centers[(rest @ centers.T - (centers**2).sum(1) / 2).argmax(1)]
        out.append(centers)
    found = np.stack(out)
    codes = encode(x, found)
    hot = np.zeros((len(x), books * words), np.float32)
    for b in range(books):
        hot[np.arange(len(x)), b * words + codes[:, b].astype(int)] = 1
    # ridge towards the residual codebooks, so that rare words keep their place
    gram = (hot.T @ hot).astype(float) + 2.0 * np.eye(books * words)
    return np.linalg.solve(gram, (hot.T @ x.astype(np.float32)).astype(float) + 2.0 * found.reshape(books * words, -1)).reshape(found.shape)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (row x book) of a beam search over the books in turn."""
    out = []
    for at in range(0, len(x), 1024):
        part = x[at : at + 1024]
        n = len(part)
        rest, codes = part[:, None, :], np.zeros((n, 1, 0), np.uint8)
        for book in books:
            # |rest - word|^2 = |rest|^2 - 2 <rest, word> + |word|^2
            cost = (rest**2).sum(2)[:, :, None] - 2 * (rest @ book.T) + (book**2).sum(1)
            flat = cost.reshape(n, -1)
            width = min(beam, flat.shape[1])
            pick = np.argpartition(flat, width - 1, axis=1)[:, :width]
            come, word = np.divmod(pick, len(book))
            rows = np.arange(n)[:, None]
            rest = rest[rows, come] - book[word]
            codes = np.concatenate([codes[rows, come], word[:, :, None].astype(np.uint8)], axis=2)
        out.append(codes[np.arange(n), (rest**2).sum(2).argmin(1)])
    return np.concatenate(out) if out else np.zeros((0, len(books)), np.uint8)


def scaled(x: np.ndarray) -> np.ndarray:
    """Unit vectors, also of vectors so large or small that squares overflow or vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def _encoded(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(row, vec_id, h, h2, codes, norm): h and h2 are hashes of the vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                codes = encode(scaled(matrix(part.column(4), part.num_rows)), b)
                norm = np.sqrt((sum(b[i][codes[:, i]] for i in range(len(b))) ** 2).sum(1))
                packed = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:4], packed, pa.array(norm)], ["row", "vec_id", "h", "h2", "codes", "norm"])

    hashed = vectors.select("row", "vec_id", F.xxhash64("vec").alias("h"), F.xxhash64("vec", F.lit(1)).alias("h2"), "vec")
    return hashed.mapInArrow(run, "row long, vec_id long, h long, h2 long, codes binary, norm double")


def _distinct(coded: DataFrame, most: int) -> DataFrame:
    """(row, members, codes, norm) of each distinct vector, the `most` smallest of its (vec_id, row) as members, the first one's row."""
    place = F.row_number().over(Window.partitionBy("h", "h2").orderBy("vec_id", "row"))
    few = coded.withColumn("_n", place).where(F.col("_n") <= most).groupBy("h", "h2")
    each = few.agg(F.array_sort(F.collect_list(F.struct("vec_id", "row"))).alias("members"), F.first("codes").alias("codes"), F.first("norm").alias("norm"))
    return each.select(F.col("members")[0]["row"].alias("row"), "members", "codes", "norm")


def shortlists(q: np.ndarray, q_rows: np.ndarray, rows: np.ndarray, codes: np.ndarray, norm: np.ndarray, books: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, place of the row, score) of the `most` best rows of a block for each query, its own row apart."""
    look = np.einsum("qd,mkd->qmk", q, books)
    down = np.maximum(norm, 1e-12)
    who, which, scores = [], [], []
    columns = [np.ascontiguousarray(codes[:, m]) for m in range(len(books))]
    for i in range(len(q)):
        score = look[i, 0][columns[0]]
        for m in range(1, len(books)):
            score += look[i, m][columns[m]]
        score /= down
        score[rows == q_rows[i]] = -np.inf
        few = min(most, len(rows))
        at = np.argpartition(-score, few - 1)[:few]
        at = at[score[at] > -np.inf]
        who.append(np.full(len(at), i)), which.append(at), scores.append(score[at])
    return np.concatenate(who), np.concatenate(which), np.concatenate(scores).astype(float)


def nearest(rows: DataFrame, k: int = 5, every: int = 50, shortlist: int = SHORTLIST) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest cosines that the search finds for each query.

    rows: vec_id and embedding. Queries are the rows whose vec_id is divisible by `every`,
    candidates every other row; ties go to the smaller vec_id. Zero vectors, and what
    valid_vectors() leaves out, take no part. Rows of a repeated vec_id are queries and candidates
    each by itself, of each other too. An empty table gives no rows.
    """
    vectors = valid_vectors(rows.where(F.exists("embedding", lambda x: x != 0)))
    n = vectors.count()
    if not n:
        return vectors.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    books = train(scaled(sample(vectors, SAMPLE, n)))
    blocks = blocks_of(n, BLOCK_ROWS)
    coded = written(_distinct(_encoded(vectors, books), k + 1).withColumn("block", bucket(blocks)), "codes")
    asked = vectors.where(F.pmod("vec_id", F.lit(every)) == 0)
    batches = blocks_of(asked.count(), QUERY_ROWS)
    each = lambda m, name: F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(name)
    left = coded.select("*", each(batches, "batch"))
    right = asked.withColumn("batch", bucket(batches)).select("*", each(blocks, "block"))
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(key: tuple, d: pa.Table, q: pa.Table) -> pa.Table:
        who = which = np.zeros(0, np.int64)
        score = np.zeros(0)
        if d.num_rows and q.num_rows:
            codes = np.frombuffer(b"".join(d["codes"].to_pylist()), np.uint8).reshape(d.num_rows, -1)
            alone = np.where(pc.list_value_length(d["members"]).to_numpy() == 1, d["row"].to_numpy(), -1)
            who, which, score = shortlists(scaled(matrix(q["vec"], q.num_rows)), q["row"].to_numpy(), alone, codes, d["norm"].to_numpy(), shared.value, shortlist)
        return pa.table([q["row"].take(pa.array(who)), d["row"].take(pa.array(which)), d["members"].take(pa.array(which)), pa.array(score)], ["query", "row", "members", "score"])

    members = "members array<struct<vec_id: long, row: long>>"
    part = left.groupBy("block", "batch").cogroup(right.groupBy("block", "batch")).applyInArrow(run, f"query long, row long, {members}, score double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "row"))
    chosen = part.withColumn("_n", place).where(F.col("_n") <= shortlist).select("query", "row", "members")
    exact = chosen.join(vectors.select("row", "vec"), "row").join(asked.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), F.col("vec").alias("q")), "query")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                x, q = (matrix(b.column(i), b.num_rows) for i in (3, 4))
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(cosines(q, x))], ["query", "query_id", "members", "score"])

    scored = exact.select("query", "query_id", "members", "vec", "q").mapInArrow(rerank, f"query long, query_id long, {members}, score double")
    each = scored.select("query", "query_id", "score", F.inline("members")).where("row <> query")
    return answer(best(each, k), "double")


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row; huge and tiny vectors are scaled by their largest component first."""
    top = [np.abs(x).max(1, keepdims=True) for x in (a, b)]
    far = [np.where((t > 1e100) | (t < 1e-100), t, 1.0) for t in top]
    a, b = a / far[0], b / far[1]
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def op9_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {"op9_additive_quantisation": op9_additive_quantisation}
ORACLE_SQL: dict[str, str] = {}
