"""Array views of text columns, shared by the text operators.

An Arrow string column is one byte buffer with offsets, so words, shingles and windows of a whole
batch are found with numpy on that buffer and no Python object is made for a word. Words are maximal
runs of bytes outside ``\\x20\\x09-\\x0D``; they never cross the border of a document.
"""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _LIBC = None
PAD = 64
CHUNK_BYTES = 1 << 20
LONG_WORD = 512
_U = np.uint64
_K1, _K2, _K3 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=_U)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; two different inputs never give one output."""
    h = h ^ (h >> _U(32))
    h *= _K1
    h ^= h >> _U(29)
    h *= _K2
    h ^= h >> _U(32)
    return h


def loads(buf: np.ndarray) -> np.ndarray:
    """Element i: the eight bytes from i on, as one little-endian number (buf is padded)."""
    return np.ndarray((buf.size - 7,), dtype="<u8", buffer=buf, strides=(1,))


@dataclass
class Texts:
    """Some documents of a batch: their bytes on end, padded with blanks, and where each begins."""

    rows: slice
    buf: np.ndarray
    offs: np.ndarray

    @property
    def size(self) -> int:
        return int(self.offs[-1])

    def lower(self) -> Texts:
        return Texts(self.rows, _LOWER[self.buf], self.offs)

    def raw(self, k: int) -> bytes:
        return self.buf[self.offs[k] : self.offs[k + 1]].tobytes()

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Where words start and end."""
        n = self.size
        inside = ~_SPACE[self.buf[: n + 1]]
        inside[n] = False
        border = np.zeros(n + 1, dtype=bool)
        border[self.offs] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | border[1:]
        last = inside[:-1] & (~inside[1:] | border[1:])
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    @cached_property
    def bounds(self) -> np.ndarray:
        """Words of document k are bounds[k] to bounds[k + 1]."""
        return np.searchsorted(self.words[0], self.offs)

    @cached_property
    def word_hashes(self) -> np.ndarray:
        return span_hashes(self.buf, *self.words)

    def windows(self, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """A hash for each run of width words, and a mask of the runs inside one document."""
        w = self.word_hashes
        n = max(w.size - width + 1, 0)
        h = np.full(n, _U(seed) * _K3 + _U(width), dtype=_U)
        for j in range(width):
            h *= _K1
            h ^= w[j : j + n]
            h ^= h >> _U(31)
            h *= _K2
        owner = self.owner
        return mix(h), owner[:n] == owner[width - 1 : width - 1 + n]

    @cached_property
    def owner(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(self.offs.size - 1), np.diff(self.bounds))


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes have equal hashes, wherever they stand."""
    length = end - start
    at8 = loads(buf)
    h = mix(length.astype(_U) * _K3 ^ (at8[start] & _MASK[np.minimum(length, 8)]))
    idx, k = np.flatnonzero((length > 8) & (length <= LONG_WORD)), 8
    while idx.size:
        left = length[idx] - k
        h[idx] = mix(h[idx] * _K3 ^ (at8[start[idx] + k] & _MASK[np.minimum(left, 8)]))
        idx, k = idx[left > 8], k + 8
    for i in np.flatnonzero(length > LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(buf[start[i] : end[i]].tobytes())
    return h


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """The column in runs of rows of about limit bytes; a longer text stands alone. A null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offs = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        part = whole[offs[lo] : offs[hi]]
        buf = np.full(part.size + PAD, 0x20, dtype=np.uint8)
        buf[: part.size] = part
        yield Texts(slice(lo, hi), buf, offs[lo : hi + 1] - offs[lo])
        lo = hi


def release() -> None:
    """Gives freed memory back to the system: workers are kept from stage to stage, and what their allocators hold adds up."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """df.mapInArrow, with fn giving dictionaries of columns in the order of the schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in fn(batch):
                yield pa.RecordBatch.from_pydict(columns)
            del batch
            release()

    return df.mapInArrow(run, schema)


def binaries(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    """A binary column over one byte array."""
    return pa.Array.from_buffers(pa.binary(), offs.size - 1, [None, pa.py_buffer(np.ascontiguousarray(offs, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(data).view(np.uint8))])


def bounded_batches(spark) -> None:
    """Keeps the rows of one Arrow batch within a worker's memory however long texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; one is made only where none is set and Spark is local, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not where and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
