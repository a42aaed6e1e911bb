"""Flat numpy views of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20  # numpy temporaries take up to some 60 bytes a byte of text


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and where each row begins and the last one ends."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if len(ends) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    own = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return own, ends - ends[0]


def chunks(batches: Iterator[pa.RecordBatch], text: int, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of one have ``most`` bytes at most, or are a single text."""
    for batch in batches:
        _, at = flat(batch.column(text))
        first = 0
        while first < len(batch):
            last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of a string column without nulls, and where each row begins and the last one ends."""
    data, at = flat(column)
    try:
        text = data.tobytes().decode("utf-8")
    except UnicodeDecodeError:
        rows = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]
        text, at = "".join(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows], dtype=np.int64)])
    else:
        begun = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        at = begun[at]
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), at


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sum of each row's values, 0 for rows without any."""
    out = np.zeros(len(at) - 1)
    some = at[1:] > at[:-1]
    if some.any():
        out[some] = np.add.reduceat(values, at[:-1][some], dtype=np.float64)
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads all bits (in place)."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h
