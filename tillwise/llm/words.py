"""Words and word windows of whole texts as 64-bit hashes, computed per Arrow batch with numpy.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r. Hashes depend on the bytes of
the words alone, so every task and every run gives the same ones.
"""

from __future__ import annotations

import ctypes
import sys
import time
import types
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The seed of the byte table and odd 64-bit multipliers.
SEED = 20260101
STEP = 0x9E3779B97F4A7C15
MIX_A = 0xBF58476D1CE4E5B9
MIX_B = 0x94D049BB133111EB
SLICE_BYTES = 1 << 19
BATCH_ROWS = 512
IDLE_SECONDS = 20


class Words(NamedTuple):
    """Words of some texts, one after the other."""

    hashes: np.ndarray
    starts: np.ndarray  # first byte of each word, counted from the first text
    ends: np.ndarray
    bounds: np.ndarray  # text i has the words bounds[i]:bounds[i + 1]
    texts: np.ndarray  # first byte of each text, and the end
    data: np.ndarray


def worker_state(name: str, make: Callable[[], object]) -> object:
    """Something that a Python worker makes once and keeps for its later tasks."""
    home = sys.modules.setdefault("_tillwise_worker_state", types.ModuleType("_tillwise_worker_state"))
    held = home.__dict__.setdefault("held", {})
    made = held[name][0] if name in held else make()
    held[name] = (made, time.monotonic())
    return made


def let_go() -> None:
    """Give back what an earlier stage kept in this worker and no task has used for a while."""
    home = sys.modules.get("_tillwise_worker_state")
    held = getattr(home, "held", {})
    for name in [name for name, (_, used) in held.items() if time.monotonic() - used > IDLE_SECONDS]:
        del held[name]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a bijection)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(MIX_A)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(MIX_B)
    return values ^ (values >> np.uint64(31))


def powers(base: int, count: int) -> np.ndarray:
    """base ** 0, 1, ... as 64-bit values; those for slices of the usual size are kept."""

    def made(size: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[:1] = 1
        return np.cumprod(out, dtype=np.uint64)

    usual = worker_state(f"powers:{base}", lambda: made(SLICE_BYTES + 1))
    return usual[:count] if count <= len(usual) else made(count)


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of ``BATCH_ROWS``: what a task makes of one piece is soon let go."""
    let_go()
    for batch in batches:
        for first in range(0, max(1, batch.num_rows), BATCH_ROWS):
            yield batch.slice(first, BATCH_ROWS)


def slices(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Cut a text column into pieces of half a megabyte; a longer text is a piece of its own."""
    sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, size in enumerate(sizes):
        if i > first and held + size > SLICE_BYTES:
            yield first, column.slice(first, i - first)
            first, held = i, 0
        held += int(size)
    if first < len(column):
        yield first, column.slice(first)


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the place where each begins (a null text is empty)."""
    column = column.fill_null("").cast(pa.large_string())
    column = pa.concat_arrays([column])  # offsets from the first row of the slice
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    first = int(places[0])
    size = int(places[-1]) - first
    content = np.frombuffer(data, np.uint8, size, first) if size else np.zeros(0, np.uint8)
    return content, places - first


def words_of(column: pa.Array, lower: bool = False) -> Words:
    """The words of each text; ``lower`` lower-cases A-Z first."""
    data, texts = raw_bytes(column)
    blank = np.zeros(256, bool)
    blank[[0x20, *range(0x09, 0x0E)]] = True
    if lower:
        fold = np.arange(256, dtype=np.uint8)
        fold[ord("A") : ord("Z") + 1] += 32
        data = fold[data]
    inside = ~blank[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    inner = texts[1:-1]
    inner = inner[inner < len(data)]
    begins[inner] = inside[inner]  # a word does not go on in the next text
    stops = np.zeros(len(data) + 1, bool)
    stops[1:] = inside
    stops[1:-1] &= ~inside[1:] | begins[1:]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
    return Words(span_hashes(data, starts, ends), starts, ends, np.searchsorted(starts, texts), texts, data)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span: a polynomial in STEP, from running sums."""
    table = np.random.default_rng(SEED).integers(0, 2**64, 256, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers(STEP, len(data)), out=sums[1:])
    back = powers(pow(STEP, -1, 2**64), len(data) + 1)
    return mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each window of ``width`` words; text bounds are the caller's."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:count].copy()
    for k in range(1, width):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(MIX_A) + hashes[k : k + count]
    return mixed(out)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its word windows, A-Z lower-cased.

    A text with fewer words is one window of them all, one without words has none.
    """
    for _, piece in slices(column):
        words = words_of(piece, lower=True)
        every = windows(words.hashes, width)
        for first, last in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
            if last - first >= width:
                yield np.unique(every[first : last - width + 1])
            elif last > first:
                yield windows(words.hashes[first:last], last - first) ^ np.uint64(last - first)
            else:
                yield np.zeros(0, np.uint64)
