"""Operator 8: exact top-k inner products by dual-tree search over cover trees.

The first level of both trees is common: at most CELLS centres from a bounded sample, every
vector in the cell of its nearest centre, with the cell's covering radius. Query groups first
visit the cells with the best bounds; the worst kth score of each group then prunes (query
group, cell) pairs: no inner product of the pair can exceed
<cq, cd> + rq |cd| + rd |cq| + rq rd. Pairs that stay meet in tasks of one block of vectors
and one batch of queries, where local cover trees over both are descended together with the
same bound. The centres' sample only steers the search; every vector is indexed and the
results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .vectors import answer, best, blocks_of, bucket, matrix, sample, valid_vectors

#: Bound of the vectors from which centres are chosen, and of the centres: both fit on the driver.
SAMPLE, CELLS = 20_000, 4096
CELL_ROWS, BLOCK_ROWS, QUERY_ROWS, LEAF = 1500, 4096, 1024, 16
#: Relative and absolute slack of bounds against rounding.
SLACK = 1e-9


class CoverTree:
    """Nodes as arrays: centre, covering radius of all points below, children or (in leaves) points.

    A node's children are centres more than half its scale apart, the first being the node's own
    centre, and every point below lies within half the scale of one of them.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = points, leaf
        self.center: list[int] = []
        self.radius: list[float] = []
        self.children: list[np.ndarray] = []
        self.members: list[np.ndarray | None] = []
        if len(points):
            d = np.sqrt(((points - points[0]) ** 2).sum(1))
            self._add(0, np.arange(len(points)), d)
            todo = [(0, np.arange(len(points)), d)]
            while todo:
                node, idx, d = todo.pop()
                scale = self.radius[node]
                if len(idx) <= leaf or scale == 0:
                    self.members[node] = idx
                    continue
                kids = []
                for center, mine, dist in self._net(self.center[node], idx, d, scale / 2):
                    kids.append(self._add(center, mine, dist))
                    todo.append((kids[-1], mine, dist))
                self.children[node] = np.array(kids)
        self.centers = points[self.center] if len(points) else points
        self.radii = np.array(self.radius)
        self.norms = np.sqrt((self.centers**2).sum(1))

    def _add(self, center: int, idx: np.ndarray, d: np.ndarray) -> int:
        self.center.append(center)
        self.radius.append(float(d.max()))
        self.children.append(np.zeros(0, np.int64))
        self.members.append(None)
        return len(self.center) - 1

    def _net(self, center: int, idx: np.ndarray, d: np.ndarray, scale: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        while len(idx):
            near = d <= scale
            yield center, idx[near], d[near]
            idx = idx[~near]
            if len(idx):
                center = int(idx[0])
                d = np.sqrt(((self.points[idx] - self.points[center]) ** 2).sum(1))


def _bounds(cq: np.ndarray, rq: float, nq: float, centers: np.ndarray, radii: np.ndarray, norms: np.ndarray) -> np.ndarray:
    most = centers @ cq + rq * norms + radii * nq + rq * radii
    return most + SLACK * (np.abs(most) + norms * nq + 1)


def dual_search(queries: np.ndarray, q_rows: np.ndarray, data: np.ndarray, d_ids: np.ndarray, d_rows: np.ndarray, k: int, floor: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(place of the query, vec id, row, score) of each query's k best in data that reach its floor; its own row apart."""
    order = np.lexsort((d_rows, d_ids))
    data, d_ids, d_rows = data[order], d_ids[order], d_rows[order]
    qt, dt = CoverTree(queries), CoverTree(data)
    kth = floor.copy()
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(queries)
    stack = [(0, np.zeros(1, np.int64))]
    below: dict[int, np.ndarray] = {}

    def queries_below(n: int) -> np.ndarray:
        if n not in below:
            kids = qt.children[n]
            below[n] = np.concatenate([queries_below(int(c)) for c in kids]) if len(kids) else qt.members[n]
        return below[n]

    while stack:
        q, front = stack.pop()
        mine = queries_below(q)
        bound = _bounds(qt.centers[q], qt.radii[q], qt.norms[q], dt.centers[front], dt.radii[front], dt.norms[front])
        front = front[bound >= kth[mine].min()]
        if not len(front):
            continue
        if len(qt.children[q]):
            opened = [dt.children[n] if len(dt.children[n]) else np.array([n]) for n in front.tolist()]
            stack += [(int(c), np.concatenate(opened)) for c in qt.children[q]]
            continue
        while any(len(dt.children[n]) for n in front.tolist()):
            front = np.concatenate([dt.children[n] if len(dt.children[n]) else np.array([n]) for n in front.tolist()])
            bound = _bounds(qt.centers[q], qt.radii[q], qt.norms[q], dt.centers[front], dt.radii[front], dt.norms[front])
            front = front[bound >= kth[mine].min()]
        bound = _bounds(qt.centers[q], qt.radii[q], qt.norms[q], dt.centers[front], dt.radii[front], dt.norms[front])
        front, bound = front[np.argsort(-bound, kind="stable")], np.sort(-bound) * -1
        at, step = 0, 16
        while at < len(front) and bound[at] >= kth[mine].min():
            cand = np.concatenate([dt.members[n] for n in front[at : at + step].tolist()])
            at, step = at + step, step * 2
            scores = queries[mine] @ data[cand].T
            for i, qi in enumerate(mine.tolist()):
                ok = (scores[i] >= kth[qi]) & (d_rows[cand] != q_rows[qi])
                if ok.any():
                    s = np.concatenate([found[qi][0], scores[i][ok]])
                    p = np.concatenate([found[qi][1], cand[ok]])
                    top = np.lexsort((p, -s))[:k]
                    found[qi] = (s[top], p[top])
                    if len(top) == k:
                        kth[qi] = max(kth[qi], s[top[-1]])
    return [(i, int(d_ids[p]), int(d_rows[p]), float(s)) for i, (ss, pp) in enumerate(found) for s, p in zip(ss, pp)]


def _net_of(points: np.ndarray, most: int) -> np.ndarray:
    """Farthest-first centres."""
    if not len(points):
        return points
    chosen, d = [0], ((points - points[0]) ** 2).sum(1)
    while len(chosen) < most and d.max() > 0:
        i = int(d.argmax())
        chosen.append(i)
        d = np.minimum(d, ((points - points[i]) ** 2).sum(1))
    return points[chosen]


def _assigned(vectors: DataFrame, centers: np.ndarray) -> DataFrame:
    """(row, vec_id, vec, cell, dist) of the nearest centre."""
    shared = vectors.sparkSession.sparkContext.broadcast(centers)
    names = ["row", "vec_id", "vec", "cell", "dist"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        half = (c**2).sum(1) / 2
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = matrix(part.column(2), part.num_rows)
                cell = (x @ c.T - half).argmax(1)
                dist = np.sqrt(((x - c[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(dist)], names)

    return vectors.mapInArrow(run, "row long, vec_id long, vec array<double>, cell int, dist double")


def _batches(centers: np.ndarray, queries: dict[int, int]) -> dict[int, tuple[int, int]]:
    """cell -> (first batch, batches): neighbouring cells share a batch of about QUERY_ROWS queries, a fuller cell has several of its own.

    Cells are taken in a chain of nearest neighbours; there are at most CELLS.
    """
    left, chain = sorted(queries), []
    at = left[0] if left else 0
    while left:
        left.remove(at)
        chain.append(at)
        if left:
            at = left[int(((centers[left] - centers[at]) ** 2).sum(1).argmin())]
    out, batch, filled = {}, 0, 0
    for cell in chain:
        n = queries[cell]
        if filled and filled + n > QUERY_ROWS:
            batch, filled = batch + 1, 0
        count = blocks_of(n, QUERY_ROWS)
        out[cell] = (batch, count)
        if count > 1:
            batch, filled = batch + count, 0
        else:
            filled += n
    return out


_FOUND = "query long, query_id long, vec_id long, row long, score double"


def _visit(data: DataFrame, queries: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """Partial results of the (cell, batch) pairs in visits: data rows meet the batch's queries block by block.

    data: row, vec_id, vec, cell, block; queries: row, vec_id, vec, batch, group, kth; visits: batch, group, cell, blocks.
    """
    left = data.join(visits.select("cell", "batch").distinct(), "cell").select("cell", "block", "batch", "row", "vec_id", "vec")
    blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    right = queries.drop("cell").join(visits.select("cell", "batch", "group", "blocks"), ["batch", "group"])
    right = right.select("cell", "batch", "row", "vec_id", "vec", "kth", blocks)

    def run(key: tuple, d: pa.Table, q: pa.Table) -> pa.Table:
        rows: list = []
        if d.num_rows and q.num_rows:
            args = matrix(q["vec"], q.num_rows), q["row"].to_numpy(), matrix(d["vec"], d.num_rows), d["vec_id"].to_numpy(), d["row"].to_numpy()
            rows = dual_search(*args, k, q["kth"].to_numpy())
        i, b, r, s = (np.array(x) for x in (zip(*rows) if rows else ((), (), (), ())))
        at = pa.array(i.astype(np.int64))
        columns = [q["row"].take(at), q["vec_id"].take(at), pa.array(b.astype(np.int64)), pa.array(r.astype(np.int64)), pa.array(s.astype(float))]
        return pa.table(columns, ["query", "query_id", "vec_id", "row", "score"])

    keys = ("cell", "block", "batch")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, _FOUND)


def top_k(rows: DataFrame, k: int = 5, every: int = 50, quantise: bool = True) -> DataFrame:
    """query_id, rank, vec_id, score (a long if quantised): the k largest inner products of each query.

    rows: vec_id and embedding. Queries are the rows whose vec_id is divisible by `every`,
    candidates every other row, ties to the smaller vec_id; fewer candidates than k give fewer
    rows. What takes no part: see valid_vectors(). Rows of a repeated vec_id are queries and
    candidates each by itself, of each other too. An empty table gives no rows.
    """
    change = (lambda x: F.floor(256 * x).cast("double")) if quantise else (lambda x: x)
    vectors = valid_vectors(rows, change)
    n = vectors.count()
    kind = "long" if quantise else "double"
    if not n:
        return vectors.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast(kind).alias("score"))
    centers = _net_of(sample(vectors, SAMPLE, n), min(CELLS, blocks_of(n, CELL_ROWS)))
    cells = written(_assigned(vectors, centers), "cells")
    spark = rows.sparkSession

    # one row for each cell, of which there are at most CELLS
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    per_cell = cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("radius"), F.count_if(is_query).alias("q")).collect()
    sizes = {r["cell"]: (r["n"], r["radius"]) for r in per_cell}
    blocks = spark.createDataFrame([(c, blocks_of(s[0], BLOCK_ROWS)) for c, s in sizes.items()], "cell int, blocks int")
    data = cells.join(F.broadcast(blocks), "cell").withColumn("block", bucket(F.col("blocks"))).drop("blocks", "dist")

    dealt = _batches(centers, {r["cell"]: r["q"] for r in per_cell if r["q"]})
    batches = spark.createDataFrame([(c, *b) for c, b in dealt.items()], "cell int, first int, count int")
    asked = cells.where(is_query).join(F.broadcast(batches), "cell")
    asked = asked.withColumn("batch", F.col("first") + bucket(F.col("count"))).withColumn("group", F.col("cell")).drop("first", "count")
    asked = written(asked, "queries")
    known = np.array(sorted(sizes))
    radii = np.array([sizes[c][1] for c in known.tolist()])
    shared = spark.sparkContext.broadcast((centers, known, radii, [blocks_of(sizes[c][0], BLOCK_ROWS) for c in known.tolist()]))
    groups = asked.groupBy("batch", "group").agg(F.max("dist").alias("radius"))

    def choose(groups: DataFrame, first: bool) -> DataFrame:
        """(batch, group, cell, blocks): the two cells of the best bounds, or the others that the kth scores leave."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c, cell, rd, n_blocks = shared.value
            d, norms = c[cell], np.sqrt((c[cell] ** 2).sum(1))
            out: list[list[int]] = [[], [], [], []]
            for batch in batches:
                for b, g, rq, kth in zip(*(x.to_pylist() for x in batch.columns)):
                    bound = _bounds(c[g], rq, float(np.sqrt((c[g] ** 2).sum())), d, rd, norms)
                    order = np.argsort(-bound, kind="stable")
                    for i in order[:2] if first else [i for i in order[2:].tolist() if bound[i] >= kth]:
                        for into, x in zip(out, (b, g, int(cell[i]), n_blocks[i])):
                            into.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()) for x in out], ["batch", "group", "cell", "blocks"])

        return groups.select("batch", "group", "radius", "kth").mapInArrow(run, "batch int, group int, cell int, blocks int")

    low = F.lit(float("-inf"))
    first = written(_visit(data, asked.withColumn("kth", low), choose(groups.withColumn("kth", low), True), k), "first")
    worst = best(first, k).where(F.col("rank") == k).select(F.col("query").alias("row"), F.col("score").alias("kth"))
    with_kth = asked.join(worst, "row", "left").withColumn("kth", F.coalesce("kth", low))
    reach = with_kth.groupBy("batch", "group").agg(F.max("dist").alias("radius"), F.min("kth").alias("kth"))
    rest = _visit(data, with_kth, choose(reach, False), k)
    return answer(best(first.union(rest), k), kind)


def op8_dual_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


QUERIES = {"op8_dual_cover_tree": op8_dual_cover_tree}
ORACLE_SQL = {
    "op8_dual_cover_tree": """
WITH v AS (
  SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.k AS q, q.vec_id AS query_id, c.k, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.k <> c.k
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id, k) AS rank, vec_id, score FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
}
