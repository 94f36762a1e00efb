"""Vectorised word handling shared by the operators of this folder.

Texts reach Python as Arrow binary columns. A batch is cut into pieces of whole
documents of about ``PIECE_BYTES`` and each piece is handled as one byte array,
so no Python object is made per word. Words are named by 64-bit hashes.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_ROOT = str(Path(__file__).resolve().parents[2])

PIECE_BYTES = 1 << 20
BATCH_ROWS = 256

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x5851F42D4C957F2D)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_ROWS`` rows, as one row may hold a very long text.

    Also lets Python workers find this package where the driver runs it from a
    folder that is not on their path.
    """
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def text_bytes(column: Column | str = "text") -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit("")).cast("binary")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply ``fn`` to each Arrow batch of ``df``."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that nearby values share no bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _STEP, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(256)
_BYTE_CODES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _GOLD)


def table(pattern: Callable[[int], bool]) -> np.ndarray:
    """A lookup table over byte values."""
    return np.array([bool(pattern(b)) for b in range(256)])


SPACE = table(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)
NOT_SPACE = ~SPACE
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)
LEAD = table(lambda b: b & 0xC0 != 0x80)  # bytes that begin a code point


@dataclass
class Piece:
    """Some whole documents of a batch: bytes and the offset of each document (one more at the end)."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    """Cut an Arrow binary column into pieces; one document is never split."""
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    raw = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = raw[column.offset : column.offset + len(column) + 1].astype(np.int64)
    values = column.buffers()[2]
    data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, np.uint8)
    start, n = 0, len(column)
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), n)
        own = offsets[start : end + 1]
        yield Piece(start, data[own[0] : own[-1]], own - own[0])
        start = end


def spans(piece: Piece, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes for which ``inside`` is true: starts, ends and, per document, its first run (one more at the end)."""
    data, offsets = piece.data, piece.offsets
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(piece.n + 1, np.int64)
    at = inside[data]
    begins, ends = at.copy(), at.copy()
    begins[1:] &= ~at[:-1]
    ends[:-1] &= ~at[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] = at[inner]
    ends[inner - 1] = at[inner - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash per run of bytes (runs in order, none empty, none overlapping)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(first, lengths)
    codes = _BYTE_CODES[data[place + np.repeat(starts, lengths)]]
    longest = int(lengths.max())
    powers = _POWERS if longest <= len(_POWERS) else _powers(longest)
    codes *= powers[place]
    return mix(np.add.reduceat(codes, first) + lengths.astype(np.uint64) * _GOLD)


def lower(piece: Piece) -> Piece:
    """The piece with A-Z as a-z."""
    return Piece(piece.first, LOWER[piece.data], piece.offsets)


def word_hashes(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^ \\t-\\r]+`` and, per document, its first word."""
    starts, ends, first = spans(piece, NOT_SPACE)
    return span_hashes(piece.data, starts, ends), first


def windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of ``width`` words inside one document, and the place of its first word."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    whole = np.ones(n, dtype=bool)
    for back in range(1, width):
        cut = first[1:-1] - back
        whole[cut[(cut >= 0) & (cut < n)]] = False
    total = np.zeros(n, np.uint64)
    for j in range(width):
        total += hashes[j : j + n] * _powers(width + 1)[j + 1]
    places = np.flatnonzero(whole)
    return mix(total[places] + np.uint64(width)), places


def sequence_hash(hashes: np.ndarray) -> int:
    """One hash for a whole sequence of words."""
    if not len(hashes):
        return 0
    total = (hashes * _powers(len(hashes) + 1)[1:]).sum(dtype=np.uint64, keepdims=True)
    return int(mix(total + np.array([len(hashes)], np.uint64) * _GOLD)[0])


def per_document(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive offsets."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]
