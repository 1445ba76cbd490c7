"""Shared pieces of the Arrow-based operators: bounded slices of text columns, and word tables as numpy arrays."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one vectorised step takes, so that its arrays stay bounded. A longer text is a step of its own.
STEP_BYTES = 1 << 20

MIX = np.uint64(0xD6E8FEB86659FD93)
BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


#: Rows of a batch between Spark and Python. Texts are large: Spark's default of 10,000 rows may take too much memory.
BATCH_ROWS = 500
_RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, unless they are smaller already. Spark reads the setting when a query runs,
    so it has to stay set."""
    if int(spark.conf.get(_RECORDS)) > BATCH_ROWS or int(spark.conf.get(_RECORDS)) <= 0:
        spark.conf.set(_RECORDS, str(BATCH_ROWS))


def in_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """mapInArrow whose worker gives its memory back when a task ends. Spark keeps idle workers, and what they hold
    counts beside the executor's heap in all later stages."""

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            released()

    return df.mapInArrow(whole, schema)


def released() -> None:
    _POWERS.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """Names like these that no column has, whatever their case."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of a folder; the session's Arrow batches are set for texts."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(batch: pa.RecordBatch, text: int, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch between rows into slices of about `limit` bytes of its column number `text`."""
    if not batch.num_rows:
        return
    column = batch.column(text)
    sizes = np.asarray(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    part = (np.cumsum(sizes) - sizes) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without copying; NULL is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8)[offsets[0] : offsets[-1]] if raw[2] is not None and len(column) else np.zeros(0, np.uint8)
    return data, offsets - (offsets[0] if len(offsets) else 0)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    h = (h ^ (h >> np.uint64(32))) * MIX
    h = (h ^ (h >> np.uint64(29))) * MIX
    return h ^ (h >> np.uint64(32))


def powers(n: int, base: int = BASE) -> np.ndarray:
    out = np.empty(n, np.uint64)
    if n:
        out[0] = 1
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


_POWERS: dict[int, np.ndarray] = {}


def cached_powers(n: int, base: int) -> np.ndarray:
    if n > 2 * STEP_BYTES:
        return powers(n, base)
    if base not in _POWERS or len(_POWERS[base]) < n:
        _POWERS[base] = powers(2 * STEP_BYTES, base)
    return _POWERS[base][:n]


INVERSE = pow(BASE, -1, 1 << 64)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """p with (p[e] - p[s]) * BASE ** -s the polynomial hash of data[s:e], modulo 2 ** 64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * cached_powers(len(data), BASE), out=out[1:])
    return out


@dataclass
class Words:
    """Words of the texts of one step: their bytes' ends, hashes and rows."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    row: np.ndarray
    count: np.ndarray


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words_of(column: pa.Array, is_word: np.ndarray) -> Words:
    """Maximal runs of bytes marked in is_word (a table of 256), with A-Z lower-cased in the hashes."""
    data, offsets = flat(column)
    n = len(column)
    mask = is_word[data]
    before = np.zeros(len(data), bool)
    before[1:] = mask[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = mask[1:]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    after[edges[edges > 0] - 1] = False
    start = np.flatnonzero(mask & ~before)
    end = np.flatnonzero(mask & ~after) + 1
    p = prefix_hash(LOWER[data])
    h = mixed((p[end] - p[start]) * cached_powers(len(data) + 1, INVERSE)[start])
    row = np.searchsorted(offsets, start, side="right") - 1
    return Words(start, end, h, row, np.bincount(row, minlength=n).astype(np.int64))


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; entry i covers words i..i+k-1, also across rows."""
    m = max(len(h) - k + 1, 0)
    out = np.zeros(m, np.uint64)
    for j in range(k):
        out = out * np.uint64(BASE) + h[j : j + m]
    return mixed(out)


def byte_table(allowed) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(allowed)] = True
    return out


#: Bytes of words that are separated by white space, and of words of letters, digits and all beyond ASCII.
SPACED = ~byte_table([0x20, *range(0x09, 0x0E)])
ALNUM = byte_table([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
