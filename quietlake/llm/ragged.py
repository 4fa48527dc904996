"""Arrays of pieces of different lengths, laid end to end: texts as their distinct pieces, and what these become."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def taken(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[starts[i] : starts[i] + sizes[i]] for each i in turn, end to end."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(starts - (ends - sizes), sizes)]


def joined(parts: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts end to end as numbers of this kind, with the start and size of each."""
    values = np.frombuffer(b"".join(parts), kind)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // values.itemsize
    return values, np.cumsum(sizes) - sizes, sizes


def distinct(lists: pa.ListArray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Of lists of strings: the distinct strings, which of them stands at each place of all lists, and how many each list has."""
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())


def per_list(sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of sizes over lists of `counts` members each."""
    total = np.concatenate(([0], np.cumsum(sizes)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def binaries(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary array whose i-th member holds the next sizes[i] of values."""
    offsets = np.concatenate(([0], np.cumsum(sizes))) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def contents(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """A binary array's bytes end to end as numbers of this kind, and the edges between its members."""
    edges = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]].view(kind) if data is not None else np.zeros(0, kind)
    return values, (edges - edges[0]) // np.dtype(kind).itemsize
