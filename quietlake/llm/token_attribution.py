"""Operator 1: token counts by offset-mapped attribution.

Each document (its fields joined by a separator) is encoded once as a whole. Token lengths give
every token its span of bytes and so of characters; the sorted token spans are interval-joined
to the spans of fields and sections by binary search. A token that crosses a boundary is
allocated by an explicit rule:

- `majority`: to the section with most of its bytes, the earlier one among equals;
- `start`: to the section of its first byte;
- `split`: to each section by its share of the bytes (counts become fractions).

Spans that cover the document without overlap thus share out exactly its tokens.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import load_ranks, rank_path
from .common import map_texts, table

RULES = ("majority", "start", "split")


@functools.cache
def _encoding(path: str):
    """The tokenizer and the byte length of each id, one for each worker process."""
    import public_tokenizers
    import tiktoken

    ranks = load_ranks(path)
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for t, i in ranks.items():
        sizes[i] = len(t)
    return tiktoken.Encoding("quietlake", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def allocate(ends: np.ndarray, starts: np.ndarray, stops: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of sections [starts, stops) of bytes, given the tokens' ends.

    Sections are sorted and do not overlap; what lies in none of them is given to none.
    """
    begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    first = np.searchsorted(ends, starts, "right")  # first token that ends in or after the section
    last = np.searchsorted(begins, stops, "left")  # first token that begins after it
    inside = np.maximum(last - first, 0)
    if not len(ends):
        return inside.astype(float), inside
    counts = inside.astype(float)
    crossing = np.zeros(len(starts), np.int64)
    empty = stops <= starts
    counts[empty] = 0
    touched = np.flatnonzero((inside > 0) & ~empty)
    partial: dict[int, list[tuple[int, int]]] = {}
    for s in touched.tolist():
        for t in {int(first[s]), int(last[s]) - 1}:
            if begins[t] < starts[s] or ends[t] > stops[s]:
                crossing[s] += 1
                counts[s] -= 1
                partial.setdefault(t, []).append((s, int(min(ends[t], stops[s]) - max(begins[t], starts[s]))))
    for t, shares in partial.items():
        if rule == "split":
            for s, b in shares:
                counts[s] += b / (ends[t] - begins[t])
        elif rule == "start":
            for s, _ in shares:
                counts[s] += starts[s] <= begins[t]
        else:
            # bytes outside all sections count as one more party
            s, b = max(shares, key=lambda x: (x[1], -x[0]))
            counts[s] += b >= ends[t] - begins[t] - sum(x for _, x in shares)
    return counts, crossing


def attribute(docs: DataFrame, fields: list[str], rule: str = "majority", sections: bool = True, path: str | None = None, separator: str = "\n") -> DataFrame:
    """One row per field of a document, or per line of a field with sections.

    Columns: doc_id, field, section (from 0), start, stop (characters of the rendered document,
    the separator or line end included), n_tokens (a double for `split`), n_crossing,
    doc_tokens. A null field is empty and keeps its row with no tokens but the separator's.
    Texts of any length are encoded whole. Repeated rows stay; an empty table gives no rows;
    columns other than doc_id and the fields are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = path or rank_path()
    whole = rule != "split"
    count = pa.int64() if whole else pa.float64()
    names = ["doc_id", "field", "section", "start", "stop", "n_tokens", "n_crossing", "doc_tokens"]

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encoding, sizes = _encoding(path)
        columns = [c.to_pylist() for c in batch.columns[1:]]
        rows: list[list] = [[] for _ in names]
        for i, values in enumerate(zip(*columns)):
            parts = [v if v is not None else "" for v in values]
            pieces: list[tuple[int, int, str]] = []
            for f, p in enumerate(parts):
                p += separator if f < len(parts) - 1 else ""
                lines = p.splitlines(keepends=True) if sections and p else [p]
                pieces += [(f, n, line) for n, line in enumerate(lines)]
            text = "".join(line for _, _, line in pieces)
            ids = np.array(encoding.encode_ordinary(text), np.int64)
            ends = np.cumsum(sizes[ids])
            chars = np.cumsum([len(line) for _, _, line in pieces])
            stops = np.cumsum([len(line.encode("utf-8", "surrogatepass")) for _, _, line in pieces])
            starts = np.concatenate(([0], stops[:-1]))
            n, crossing = allocate(ends, starts, stops, rule)
            rows[0] += [i] * len(pieces)
            rows[1] += [fields[f] for f, _, _ in pieces]
            rows[2] += [s for _, s, _ in pieces]
            rows[3] += [0, *chars[:-1].tolist()]
            rows[4] += chars.tolist()
            rows[5] += n.astype(np.int64).tolist() if whole else n.tolist()
            rows[6] += crossing.tolist()
            rows[7] += [len(ids)] * len(pieces)
        kinds = [None, pa.string(), pa.int32(), pa.int64(), pa.int64(), count, pa.int64(), pa.int64()]
        ids_ = batch.column(0).take(pa.array(rows[0], pa.int64()))
        yield pa.RecordBatch.from_arrays([ids_, *[pa.array(r, k) for r, k in zip(rows[1:], kinds[1:])]], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    given = docs.select("doc_id", *[F.col(f).cast("string").alias(f"_{i}") for i, f in enumerate(fields)])
    schema = f"doc_id {kind}, field string, section int, start long, stop long, n_tokens {'long' if whole else 'double'}, n_crossing long, doc_tokens long"
    return map_texts(given, work, schema, text=f"_{len(fields) - 1}")


def op1_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of source, lang and text of every document."""
    return attribute(table(spark, sf_dir, "documents"), ["source", "lang", "text"])


QUERIES = {"op1_token_attribution": op1_token_attribution}
ORACLE_SQL: dict[str, str] = {}
