"""Texts of an Arrow batch cut into chunks whose results are computed once for each different chunk."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KEPT = 150_000
KEPT_CHARS = 64
SLICE_BYTES = 2 << 20


class Recent(dict):
    """A bounded cache of short keys: when the young generation is full it becomes the old one, and the old one goes."""

    def __init__(self, size: int = KEPT) -> None:
        super().__init__()
        self.size = size
        self.old: dict = {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is not None:
            self[key] = value
        return value

    def keep(self, key, value) -> None:
        if len(key) <= KEPT_CHARS:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = value


def slices(batch: pa.RecordBatch, name: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about ``size`` bytes; a longer text is a run of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype("int64")
    block = (np.cumsum(lengths) - lengths) // size
    starts = np.flatnonzero(np.diff(block, prepend=-1))
    for at, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield batch.slice(at, end - at)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and the bounds of each text in them. A null counts as empty."""
    texts = pa.concat_arrays([pc.fill_null(texts, "").cast(pa.string())])
    _, ends, data = texts.buffers()
    bounds = np.frombuffer(ends, "int32")[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, "int32")
    body = np.frombuffer(data, "uint8") if data is not None and data.size else np.zeros(0, "uint8")
    return body[bounds[0] : bounds[-1]], bounds - bounds[0]


def runs(
    body: np.ndarray, bounds: np.ndarray, gap: np.ndarray, cut: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The begins and ends of the runs of bytes that are no ``gap``, within texts, and the bounds of each text in these. ``cut`` tells for
    each byte but the first whether a run ends before it."""
    first, last = ~gap, ~gap
    apart = gap[:-1] if cut is None else gap[:-1] | cut
    first[1:] &= apart
    apart = gap[1:] if cut is None else gap[1:] | cut
    last[:-1] &= apart
    at = bounds[:-1][bounds[:-1] < bounds[1:]]
    first[at] = ~gap[at]
    at = bounds[1:][bounds[:-1] < bounds[1:]] - 1
    last[at] = ~gap[at]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, bounds)


def different(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """The spans of ``body`` as numbers into a list of the different ones. Spans ascend and do not overlap."""
    offsets = np.empty(2 * len(starts) + 1, "int32")
    offsets[0:-1:2], offsets[1::2], offsets[-1] = starts, ends, ends[-1] if len(ends) else 0
    spans = pa.Array.from_buffers(pa.string(), 2 * len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(body)])
    if len(starts) and (starts[1:] == ends[:-1]).all():  # no gaps: every second span is empty
        packed = np.append(starts, ends[-1:]).astype("int32")
        spans = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(packed), pa.py_buffer(body)])
    else:
        spans = spans.take(pa.array(np.arange(0, 2 * len(starts), 2)))
    coded = spans.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def looked_up(keys: list[str], cache: Recent, compute: Callable[[list[str]], Iterable]) -> list:
    """A value for each key: from the cache, or computed for all missing ones at once."""
    found = [cache[x] for x in keys]
    missing = [x for x, value in zip(keys, found, strict=True) if value is None]
    if missing:
        new = dict(zip(missing, compute(missing), strict=True))
        for key, value in new.items():
            cache.keep(key, value)
        found = [new[x] if value is None else value for x, value in zip(keys, found, strict=True)]
    return found


def gathered(values: list[bytes], codes: np.ndarray, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The sequences ``values[codes[0]]``, ``values[codes[1]]``... of numbers in one array, and the end of each in it."""
    flat = np.frombuffer(b"".join(values), dtype)
    sizes = np.fromiter(map(len, values), "int64", len(values)) // flat.itemsize
    each = sizes[codes]
    ends = np.cumsum(each)
    shift = (np.cumsum(sizes) - sizes)[codes] - (ends - each)
    return flat[np.repeat(shift, each) + np.arange(ends[-1] if len(ends) else 0)], ends
