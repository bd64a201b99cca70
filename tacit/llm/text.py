"""Words, hashes and process-wide caches that the text operators share."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

# Bytes of text that a Python task handles at a time; the batches it receives hold rows, not bytes.
SLICE_BYTES = 4 << 20
# Entries after which a word cache starts anew.
CACHE_ENTRIES = 150_000


def once(key: tuple, make: Callable):
    """``make()``, called once per worker process and key; tasks of a reused worker share it.

    Functions travel to tasks by value, so their own globals do not outlive a task.  The first
    part of a key names a kind of work: another kind than the last clears what that one held.
    """
    store = sys.modules.setdefault("tacit_worker_store", types.ModuleType("tacit_worker_store"))
    held = store.__dict__.setdefault("held", {})
    if store.__dict__.get("kind") != key[0]:
        held.clear()
        store.kind = key[0]
        _give_back()
    if key not in held:
        held[key] = make()
    return held[key]


def _give_back() -> None:
    """Return freed memory to the system, where the allocators offer it; workers live on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Cache(dict):
    """A bounded dict that computes what it lacks."""

    def __init__(self, make: Callable, limit: int = CACHE_ENTRIES):
        super().__init__()
        self.make = make
        self.limit = limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


def words(text: str | None) -> list[bytes]:
    """Runs of anything but space, tab, LF, VT, FF and CR; bytes.split() breaks at just these."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def hash64(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


def word_hashes(found: list[bytes]) -> np.ndarray:
    """A 64-bit hash per word; frequent words are hashed once per worker."""
    known = once(("words",), lambda: Cache(hash64))
    return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (multiply, shift and xor)."""
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0x7FB5D329728EA185)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x81DADEF4BC2DD44D)
    return values ^ (values >> np.uint64(33))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash per run of ``width`` words; order matters, as each place has its own odd factor."""
    count = len(hashes) - width + 1
    if count < 1:
        return np.empty(0, np.uint64)
    total = np.zeros(count, np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        power = factor
        for place in range(width):
            total += hashes[place : place + count] * power
            power = power * factor
        return mix(total)


def slices(
    batches: Iterator[pa.RecordBatch], column: int, limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a text column has about ``limit`` bytes a piece (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        if batch.nbytes <= limit:
            yield batch
            continue
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy()
        at = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            yield batch.slice(low, high - low)
