"""Lists of numbers that travel as bytes, by bucket: Spark moves a few rows, numpy does the rest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def pressed(x: np.ndarray) -> bytes:
    """Numbers as compressed bytes: all their first bytes, then all their second ones, and so on."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
    return len(x).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def opened(x: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(x[:8], "little"), np.dtype(kind).itemsize
    planes = pa.Codec("zstd").decompress(x[8:], n * size)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, n).T).reshape(-1).view(kind)


def bucket_of(codes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets in the order of the codes."""
    return (codes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


def listed(buckets: np.ndarray, *columns: np.ndarray) -> list[pa.Array]:
    """The buckets there are, from sorted ones, and the numbers of each as bytes, per column."""
    new = np.concatenate([np.ones(min(len(buckets), 1), bool), buckets[1:] != buckets[:-1]])
    cuts = np.append(np.flatnonzero(new), len(buckets))
    lists = [pa.array(buckets[cuts[:-1]].astype(np.int32))]
    for x in columns:
        offsets = pa.py_buffer(cuts * x.itemsize)
        data = pa.py_buffer(np.ascontiguousarray(x))
        lists.append(pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, offsets, data]).cast(pa.binary()))
    return lists


def flat(lists: pa.ChunkedArray, kind: type) -> np.ndarray:
    """All the numbers of a column of lists; null is an empty list."""
    parts = [np.empty(0, np.uint8)]
    for x in lists.chunks:
        x = x.cast(pa.large_binary())
        if len(x) and x.buffers()[2] is not None:
            ends = np.frombuffer(x.buffers()[1], np.int64)[[x.offset, x.offset + len(x)]]
            parts.append(np.frombuffer(x.buffers()[2], np.uint8)[ends[0]:ends[1]])
    return np.concatenate(parts).view(kind)


def sizes(lists: pa.ChunkedArray, kind: type) -> np.ndarray:
    return pc.fill_null(pc.binary_length(lists), 0).to_numpy().astype(np.int64) // np.dtype(kind).itemsize


def groups(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): the places of the codes in their order, and where in it each code begins."""
    order = np.argsort(codes)
    codes = codes[order]
    return order, np.flatnonzero(np.concatenate([np.ones(min(len(codes), 1), bool), codes[1:] != codes[:-1]]))


def sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, first) if len(first) else x[:0]
