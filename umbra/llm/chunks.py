"""Texts as runs between white space: equal runs are worked on once, results are spread over all occurrences by Arrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: The six bytes of ASCII white space.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def starts(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of `inside` bytes start and end; a run never crosses the bounds of a text."""
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cuts = bounds[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    cuts = cuts[inside[cuts] & inside[cuts - 1]] if len(cuts) else cuts
    if len(cuts):
        first, last = np.sort(np.concatenate([first, cuts])), np.sort(np.concatenate([last, cuts]))
    return first, last


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column over data without a copy; offsets has one more entry than the column."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def pieces(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Each text cut where a run of non-space bytes starts (spaces stay with what stands before them), and the number of pieces before each text."""
    solid = ~SPACE[data]
    begins = np.empty(len(data), bool)
    np.logical_and(solid[1:], ~solid[:-1], out=begins[1:])
    begins[bounds[:-1][bounds[:-1] < bounds[1:]]] = True  # spaces that begin a text are a piece
    at = np.flatnonzero(begins) if len(data) else np.zeros(0, np.int64)
    column = binaries(data, np.append(at, len(data)))
    return column.dictionary_encode(), np.searchsorted(at, bounds)


def spread(values: list[bytes], codes: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The value of each piece joined in order, and the bounds of each."""
    out = pa.array(values, pa.large_binary()).take(codes.indices)
    return data_of(out)


def data_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    n = len(column)
    bounds = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    buffer = column.buffers()[2]
    return (np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)), bounds
