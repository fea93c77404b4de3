"""Words of many texts at once, by Arrow kernels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters between words, for texts in which A-Z are lower-cased: ASCII but letters and digits.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def dictionary_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of ``texts``, and for each word in order its number and its text's.

    A-Z count as a-z; null texts have no words.
    """
    parts = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), pattern=BETWEEN)
    words, owner = pc.list_flatten(parts), pc.list_parent_indices(parts)
    some = pc.not_equal(words, "")  # a text that begins or ends between words
    coded = pc.dictionary_encode(words.filter(some))
    return coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy(), owner.filter(some).to_numpy()


def binaries(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """``values`` cut into pieces of ``counts`` numbers, as a binary each."""
    ends = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=ends[1:])
    ends *= values.itemsize
    if ends[-1] < 2**31:
        return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])
    raw = np.ascontiguousarray(values).view(np.uint8)
    return pa.array([raw[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.large_binary())


def numbers(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """What :func:`binaries` has packed: all values, and how many each piece has."""
    if not len(column):
        return np.zeros(0, dtype), np.zeros(0, np.int64)
    wide = pa.types.is_large_binary(column.type)
    ends = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(raw.tobytes(), dtype), np.diff(ends) // np.dtype(dtype).itemsize
