"""Operator 3: language identification as inference of a multilingual mixture.

Training counts letter trigrams per language over all labelled documents outside the held-out
quarter, as a distributed sum into a fixed number of hashed cells. A text is then explained as a
mixture: expectation-maximisation estimates the proportion of each language from the trigrams'
likelihoods, and backward elimination keeps the set of languages whose penalised likelihood is
best. The language with the largest proportion is the prediction, that proportion the score.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table

CELLS = 1 << 15
#: Added to every cell of every language.
SMOOTHING = 0.5
#: Price of one more language, in log-likelihood, for each unit of log(trigrams).
PENALTY = 4.0
ROUNDS = 12
UNDETERMINED = "und"
#: Bound of the model, which every worker holds.
MOST_LANGUAGES = 500


@functools.cache
def _letters() -> np.ndarray:
    """Lower-case code point if a letter, else a space, for the first 12288 code points."""
    out = np.full(0x3000, 32, np.uint32)
    for c in range(0x3000):
        if chr(c).isalpha():
            out[c] = c
    return out


def trigram_cells(text: str) -> np.ndarray:
    """Hashed cell of every trigram with a letter in it; runs of other characters count as one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    small = points < 0x3000
    points = np.where(small, _letters()[np.where(small, points, 0)], points)
    points = np.concatenate(([32], points, [32])).astype(np.uint64)
    space = points == 32
    points = points[np.concatenate(([True], ~(space[1:] & space[:-1])))]
    if len(points) < 3:
        return np.zeros(0, np.int64)
    h = points[:-2] * np.uint64(0x9E3779B97F4A7C15) + points[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + points[2:] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(29)
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(49)).astype(np.int64)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities (language x cell). The model has a fixed size for each language.

    Reads only text and lang of documents that are not held out and have both.
    """
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                into = counts.setdefault(lang, np.zeros(CELLS, np.int64))
                into += np.bincount(trigram_cells(t.as_py()), minlength=CELLS)
        for lang, c in counts.items():
            cell = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cell)), pa.array(cell), pa.array(c[cell])], ["lang", "cell", "n"])

    kinds = known.select("lang").distinct().limit(MOST_LANGUAGES + 1).count()
    if kinds > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} values of lang: a model has a row of {CELLS} cells for each")
    sums = known.mapInArrow(run, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    found = sums.toPandas()
    langs = sorted(found["lang"].unique())
    counts = np.full((len(langs), CELLS), SMOOTHING)
    if langs:
        counts[found["lang"].map({x: i for i, x in enumerate(langs)}), found["cell"]] += found["n"]
    return langs, np.log(counts / counts.sum(1, keepdims=True))


def _fit(p: np.ndarray, c: np.ndarray, theta: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    total = c.sum()
    for _ in range(rounds):
        each = theta[:, None] * p
        z = each.sum(0)
        new = each @ (c / z) / total
        done = np.abs(new - theta).max() < 1e-3
        theta = new
        if done:
            break
    return theta, float(np.log(theta @ p) @ c)


def mixture(log_p: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Proportions of the languages (zero for those not in the chosen set), summing to one."""
    u, c = np.unique(cells, return_counts=True)
    c = c.astype(float)
    part = log_p[:, u]
    single = part @ c
    best = int(single.argmax())
    out = np.zeros(len(log_p))
    price = PENALTY * np.log(c.sum() + 1)
    p = np.exp(part)
    keep = np.arange(len(log_p))
    theta, ll = _fit(p, c, np.full(len(keep), 1 / len(keep)), ROUNDS)
    if ll - single[best] <= price:
        out[best] = 1.0
        return out
    while len(keep) > 1:
        rest = np.delete(np.arange(len(keep)), theta.argmin())
        if len(rest) == 1:
            less, ll_less = np.ones(1), float(single[keep[rest[0]]])
        else:
            less, ll_less = _fit(p[keep[rest]], c, theta[rest] / theta[rest].sum(), ROUNDS)
        if ll - ll_less > price:
            break
        keep, theta, ll = keep[rest], less, ll_less
    out[keep] = theta / theta.sum()
    return out


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str] | None = None) -> DataFrame:
    """docs' columns named in keep (doc_id if none), with lang_pred, score and languages (the chosen set).

    Only text is an input. A text that is null, empty or without a letter is `und` with score 0,
    as is every text if nothing was learned. Texts of any length are used whole. Ties between
    languages go to the name that sorts first. Repeated rows stay; an empty table gives no rows.
    """
    langs = model[0]
    shared = docs.sparkSession.sparkContext.broadcast(model[1].astype(np.float32))
    keep = keep or ["doc_id"]

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        log_p = shared.value
        names, scores, sets = [], [], []
        for t in batch.column(batch.num_columns - 1):
            text = t.as_py()
            if not text or not langs or not any(map(str.isalpha, text)):
                names.append(UNDETERMINED), scores.append(0.0), sets.append([])
                continue
            theta = mixture(log_p, trigram_cells(text))
            best = int(theta.argmax())
            names.append(langs[best]), scores.append(min(1.0, float(theta[best]))), sets.append([langs[i] for i in np.flatnonzero(theta)])
        new = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], [*batch.schema.names[:-1], "lang_pred", "score", "languages"])

    given = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)], F.col("text").alias("_text"))
    kinds = ", ".join(f"_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = map_texts(given, work, f"{kinds}, lang_pred string, score double, languages array<string>", text="_text")
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score", "languages")


def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, train(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "languages")


QUERIES = {"op3_language_mixture": op3_language_mixture}
ORACLE_SQL: dict[str, str] = {}
