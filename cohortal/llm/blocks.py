"""Counting keys over shards with compressed blocks instead of a row per key.

A shard holds a sorted array of 64-bit keys and a count for each. The key range
is cut into buckets; a shard sends each bucket one block, a bucket adds up what
its shards sent (one entry per shard and key, like Spark's own partial sums) and
answers each shard with the totals of its keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BUCKET_ENTRIES = 250_000  # expected entries of a bucket

_CODEC = pa.Codec("zstd", compression_level=1)


def pack(values: np.ndarray, rising: bool = False) -> bytes:
    """An array as compressed byte planes; ``rising`` arrays are stored as differences."""
    values = np.ascontiguousarray(values)
    if rising and len(values):
        values = np.concatenate((values[:1], values[1:] - values[:-1]))
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return len(values).to_bytes(8, "little") + (_CODEC.compress(planes, asbytes=True) if planes else b"")


def unpack(data: bytes, kind: type, rising: bool = False) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = _CODEC.decompress(data[8:], n * size, asbytes=True)
    values = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, n).T).view(kind).ravel()
    return np.cumsum(values, dtype=kind) if rising else values


def n_buckets(entries: int) -> int:
    """A power of two, so that a bucket is a run of sorted keys."""
    return 1 << max(0, -(-int(entries) // BUCKET_ENTRIES) - 1).bit_length()


def to_blocks(shards: DataFrame, buckets: int, extra: str | None = None) -> DataFrame:
    """(bucket, shard, keys, counts, extra): ``shards`` has shard, keys, counts and perhaps an int16 array per key."""
    shift = np.uint64(64 - buckets.bit_length() + 1)
    columns = ["shard", "keys", "counts", *([extra] if extra else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, counts = unpack(row["keys"], np.uint64, True), unpack(row["counts"], np.int32)
                more = unpack(row[extra], np.int16) if extra else None
                of = (keys >> shift).astype(np.int64) if buckets > 1 else np.zeros(len(keys), np.int64)
                cut = np.searchsorted(of, np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(cut))
                parts = [(pack(keys[cut[b] : cut[b + 1]], True), pack(counts[cut[b] : cut[b + 1]]), pack(more[cut[b] : cut[b + 1]]) if extra else None) for b in full]
                arrays = [pa.array(full.astype(np.int64)), pa.array(np.full(len(full), row["shard"], np.int64))]
                arrays += [pa.array([p[k] for p in parts], pa.binary()) for k in range(3)]
                yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "shard", "keys", "counts", "extra"])

    return shards.select(*columns).mapInArrow(run, "bucket long, shard long, keys binary, counts binary, extra binary")


TOTALS = "bucket long, shard long, totals binary, key long, total long, extra int, n long"


def bucket_totals(blocks: DataFrame, summary: Callable[[np.ndarray, np.ndarray, np.ndarray], list[tuple]] | None = None) -> DataFrame:
    """Per bucket and shard the totals of the shard's keys; with ``summary`` also rows (key, total, extra, n) about the bucket."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        keys = [unpack(r["keys"], np.uint64, True) for r in rows]
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(inverse, np.concatenate([unpack(r["counts"], np.int32) for r in rows]), minlength=len(distinct)).astype(np.int64)
        ends = np.cumsum([len(k) for k in keys])
        out = [(r["bucket"], r["shard"], pack(totals[inverse[e - len(k) : e]]), None, None, None, None) for r, k, e in zip(rows, keys, ends)]
        if summary is not None:
            extra = np.zeros(len(distinct), np.int16)
            extra[inverse] = np.concatenate([unpack(r["extra"], np.int16) for r in rows])
            out += [(rows[0]["bucket"], None, None, *s) for s in summary(distinct, totals, extra)]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["bucket", "shard", "totals", "key", "total", "extra", "n"])

    return blocks.groupBy("bucket").applyInArrow(run, TOTALS)


def shard_totals(answers: pa.Table) -> np.ndarray:
    """The totals of a shard's keys, in their order, from its buckets' answers."""
    if not answers.num_rows:
        return np.zeros(0, np.int64)
    order = np.argsort(answers["bucket"].to_numpy())
    parts = answers["totals"].to_pylist()
    return np.concatenate([unpack(parts[k], np.int64) for k in order])


def key_totals(shards: DataFrame, settle, label: str, summary=None, extra: str | None = None) -> DataFrame:
    """``bucket_totals`` of settled ``shards`` (shard, keys, counts, n_keys), written down."""
    entries = shards.agg(F.sum("n_keys")).first()[0] or 0
    return settle(bucket_totals(to_blocks(shards, n_buckets(entries), extra), summary), label)
