"""Token files with directly addressable codes.

An id is cut into chunks of bits, lowest first. Level 0 holds the lowest chunk
of every id; a continuation bitmap says which ids go on, and only those have a
chunk in the next level. A rank directory over each bitmap gives the place of
any id's next chunk, so any token is read from a few bytes of every level,
without decoding its neighbours. The widths of the levels are the cheapest
ones for the ids at hand.

A file is a sequence of segments, each followed by a line feed:

    magic "DAC1", bytes of the segment (8), slice (4), first token in the
    slice (8), tokens (8), documents (4), levels (4); per level its width (4)
    and number of chunks (8); then per level the packed chunks and, but for
    the last, the bitmap and a directory of ones before every 512th bit (4
    each); then per document the first token (4, one more at the end), 1 byte
    for a null id, the offset of its id (4, one more at the end), and all ids
    as UTF-8. Integers are little-endian and unsigned.

Slices are ranges of ascending document ids; slices and the segments in them
are numbered in that order.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import DataType

from cohortal.core.lookup import lookup
from cohortal.llm.words import SPACE, Piece, pieces, small_batches, span_hashes, table, text_bytes

MAGIC = b"DAC1"
HEAD = struct.Struct("<4sQIQQII")
LEVEL = struct.Struct("<IQ")
DIRECTORY_BITS = 512
SEGMENT_TOKENS = 1 << 20  # a segment is closed at this many tokens; a longer document has one of its own
SEGMENTS_PER_FILE = 32
PIECE_BYTES = 4 << 20
MEMO_UNITS = 1_000_000  # distinct units whose ids a worker remembers between batches


def best_widths(ids: np.ndarray, most: int = 2) -> list[int]:
    """Chunk widths of at most ``most`` levels with the fewest bits in all, bitmaps and directories included."""
    lengths = np.bincount(np.frexp(ids.astype(np.float64))[1], minlength=2)  # ids by their number of bits
    top = len(lengths) - 1
    more = [len(ids), *(len(ids) - np.cumsum(lengths)[1:-1]).tolist()]  # ids that have a bit from b on

    def cheapest(b: int, levels: int) -> tuple[float, list[int]]:
        options = [(float(more[b] * (top - b)), [top - b])]
        for w in range(1, top - b) if levels > 1 else ():
            cost, widths = cheapest(b + w, levels - 1)
            options.append((more[b] * (w + 1 + 32 / DIRECTORY_BITS) + cost, [w, *widths]))
        return min(options)

    return cheapest(0, most)[1]


def _bytes(width: int) -> int:
    return next(b for b in (1, 2, 4) if width <= 8 * b)


def _pack(values: np.ndarray, width: int) -> bytes:
    size = _bytes(width)
    bits = np.unpackbits(values.astype(f"<u{size}").view(np.uint8).reshape(-1, size), axis=1, count=width, bitorder="little")
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def _unpack(data: np.ndarray, width: int, begin: int, end: int) -> np.ndarray:
    """Values ``begin`` to ``end`` of a packed array; only their bytes are read."""
    if end <= begin:
        return np.zeros(0, np.uint32)
    low, high, size = begin * width, end * width, _bytes(width)
    bits = np.unpackbits(data[low >> 3 : (high + 7) >> 3], bitorder="little")[low & 7 : (low & 7) + high - low]
    whole = np.zeros((end - begin, 8 * size), np.uint8)
    whole[:, :width] = bits.reshape(-1, width)
    return np.packbits(whole.ravel(), bitorder="little").view(f"<u{size}").astype(np.uint32)


class Codes:
    """The levels of one sequence of ids, over the bytes they were read from."""

    def __init__(self, n: int, widths: Sequence[int], chunks: list[np.ndarray], bitmaps: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.widths, self.chunks, self.bitmaps, self.ranks = n, list(widths), chunks, bitmaps, ranks

    @classmethod
    def build(cls, ids: np.ndarray, widths: Sequence[int] | None = None) -> Codes:
        widths = best_widths(ids) if widths is None else list(widths)
        left, chunks, bitmaps, ranks = ids.astype(np.uint32), [], [], []
        for level, width in enumerate(widths):
            chunks.append(np.frombuffer(_pack(left & np.uint32((1 << width) - 1), width), np.uint8))
            left = left >> np.uint32(width) if width < 32 else left[:0]
            if level == len(widths) - 1:
                break
            on = left > 0
            bitmaps.append(np.packbits(on, bitorder="little"))
            ranks.append(np.concatenate(([0], np.add.reduceat(on, np.arange(0, len(on), DIRECTORY_BITS), dtype=np.int64).cumsum())).astype("<u4") if len(on) else np.zeros(1, "<u4"))
            left = left[on]
        if left.any():
            raise ValueError("an id needs more bits than the levels have")
        return cls(len(ids), widths, chunks, bitmaps, ranks)

    def rank(self, level: int, place: int) -> int:
        """Ones of a bitmap before ``place``: a directory entry plus the bits of less than one block."""
        block = place // DIRECTORY_BITS
        data = self.bitmaps[level][block * DIRECTORY_BITS // 8 : (place + 7) // 8]
        inside = place - block * DIRECTORY_BITS
        return int(self.ranks[level][block]) + int(np.unpackbits(data, bitorder="little")[:inside].sum())

    def token(self, place: int) -> int:
        """One id, by a chunk and a rank per level."""
        if not 0 <= place < self.n:
            raise IndexError(place)
        value, shift = 0, 0
        for level, width in enumerate(self.widths):
            value |= int(_unpack(self.chunks[level], width, place, place + 1)[0]) << shift
            shift += width
            if level == len(self.widths) - 1 or not self.bitmaps[level][place >> 3] >> (place & 7) & 1:
                return value
            place = self.rank(level, place)
        return value

    def tokens(self, begin: int, end: int) -> np.ndarray:
        """The ids from ``begin`` to ``end``: their chunks are neighbours on every level."""
        if not 0 <= begin <= end <= self.n:
            raise IndexError((begin, end))
        values = np.zeros(end - begin, np.uint32)
        going, shift = np.arange(end - begin), 0
        for level, width in enumerate(self.widths):
            values[going] |= _unpack(self.chunks[level], width, begin, end) << np.uint32(shift)
            shift += width
            if level == len(self.widths) - 1 or begin == end:
                break
            low = begin >> 3
            on = np.unpackbits(self.bitmaps[level][low : (end + 7) >> 3], bitorder="little")[begin - 8 * low : end - 8 * low] > 0
            begin = self.rank(level, begin)
            going = going[on]
            end = begin + len(going)
        return values


class Segment:
    """Documents of a slice in order, their ids in directly addressable codes."""

    def __init__(self, slice_: int, first: int, codes: Codes, starts: np.ndarray, docs: list[bytes | None]):
        self.slice, self.first, self.codes, self.starts, self.docs = slice_, first, codes, starts, docs

    def document(self, k: int) -> np.ndarray:
        return self.codes.tokens(int(self.starts[k]), int(self.starts[k + 1]))

    def to_bytes(self) -> bytes:
        codes, last = self.codes, len(self.codes.widths) - 1
        parts: list[bytes] = [b""]
        for level, width in enumerate(codes.widths):
            n = codes.n if level == 0 else int(codes.ranks[level - 1][-1])
            parts.append(LEVEL.pack(width, n))
        for level in range(last + 1):
            parts.append(codes.chunks[level].tobytes())
            if level < last:
                parts += [codes.bitmaps[level].tobytes(), codes.ranks[level].astype("<u4").tobytes()]
        names = [d or b"" for d in self.docs]
        parts.append(self.starts.astype("<u4").tobytes())
        parts.append(np.array([d is None for d in self.docs], np.uint8).tobytes())
        parts.append(np.concatenate(([0], np.cumsum([len(d) for d in names], dtype=np.int64))).astype("<u4").tobytes())
        parts += names
        size = HEAD.size + sum(map(len, parts))
        parts[0] = HEAD.pack(MAGIC, size, self.slice, self.first, codes.n, len(names), last + 1)
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, data: memoryview | bytes, at: int = 0) -> tuple[Segment, int]:
        """The segment at an offset (a view of the bytes, nothing is decoded) and the offset behind it."""
        magic, size, slice_, first, n, n_docs, levels = HEAD.unpack_from(data, at)
        if magic != MAGIC or at + size > len(data):
            raise ValueError(f"no whole segment at byte {at}")
        place = at + HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal place
            out = np.frombuffer(data, kind, count, place)
            place += out.nbytes
            return out

        shape = [LEVEL.unpack_from(data, place + k * LEVEL.size) for k in range(levels)]
        place += levels * LEVEL.size
        chunks, bitmaps, ranks = [], [], []
        for level, (width, count) in enumerate(shape):
            chunks.append(take("u1", (width * count + 7) // 8))
            if level < levels - 1:
                bitmaps.append(take("u1", (count + 7) // 8))
                ranks.append(take("<u4", -(-count // DIRECTORY_BITS) + 1))
        starts, empty, ends = take("<u4", n_docs + 1), take("u1", n_docs), take("<u4", n_docs + 1)
        names = take("u1", int(ends[-1])).tobytes()
        docs = [None if e else names[a:b] for e, a, b in zip(empty, ends[:-1], ends[1:])]
        return cls(slice_, first, Codes(n, [w for w, _ in shape], chunks, bitmaps, ranks), starts, docs), at + size


def segments_of(data: bytes) -> Iterator[Segment]:
    """The segments of a file."""
    at = 0
    while at < len(data):
        segment, at = Segment.from_bytes(data, at)
        at += 1  # the line feed
        yield segment


# White space beyond ASCII; a text that holds any is encoded as a whole.
_OTHER_SPACE = re.compile(
    rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1(?:\x9a\x80|\xa0\x8e)|\xe2(?:\x80[\x80-\x8b\xa8\xa9\xaf]|\x81\x9f)|\xe3\x80\x80|\xef\xbb\xbf"
)
_MAYBE_SPACE = table(lambda b: 0x1C <= b <= 0x1F or b in (0xC2, 0xE1, 0xE2, 0xE3, 0xEF))
_LETTER = table(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
_SIGN = table(lambda b: b < 0x80) & ~_LETTER & ~SPACE  # ASCII that is neither letter nor white space


def unit_starts(piece: Piece) -> np.ndarray:
    """Where the units of a piece begin; they tile its bytes.

    The byte-level pattern of the vocabulary cuts at all of these places too: a
    single space goes with what follows it, other white space is taken as runs
    that leave their last character alone before text, and a run of letters
    ends before any ASCII character that is none.
    """
    data, n = piece.data, len(piece.data)
    begins = np.zeros(n + 1, bool)
    begins[piece.offsets] = True  # of documents
    space = SPACE[data]
    before, after = np.append(False, space[:-1]), np.append(space[1:], True)
    after |= begins[1:]  # the end of a document counts as white space
    starts = space & (~before | ~after)
    starts |= ~space & before & (np.append(np.uint8(0), data[:-1]) != 0x20)
    letter = _LETTER[data]
    latin = (data >= 0x80) & (data <= 0xBF) & (np.append(np.uint8(0), data[:-1]) == 0xC3) & (data != 0x97) & (data != 0xB7)
    starts |= _SIGN[data] & np.append(False, (letter | latin)[:-1])
    return np.flatnonzero(starts | begins[:-1])


class Encoder:
    """Ids of whole texts by the tokenizers library, which is asked once per distinct unit of text.

    The ids of a unit are remembered under its 64-bit hash. Units are only used
    with byte-level vocabularies without a normaliser.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task per core already
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.by_unit = isinstance(self.tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel) and self.tokenizer.normalizer is None
        self.units: dict[int, bytes] = {}
        self.feed = self._ids(["\n"])[0] if self.by_unit else []

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, fresh: dict[int, bytes]) -> None:
        """Ids of new units: words go to the library as lines of longer texts, in which a line feed is a token of its own."""
        lines = sorted((h for h, unit in fresh.items() if not unit.isspace()), key=fresh.__getitem__)
        for k in range(0, len(lines), 2000):
            part = lines[k : k + 2000]
            ids = np.array(self._ids([(b"\n" + b"\n".join(map(fresh.__getitem__, part))).decode()])[0], "<u4")
            cuts = np.flatnonzero(ids == self.feed[0])
            if len(self.feed) == 1 and len(cuts) == len(part):
                data, places = ids.tobytes(), [*(4 * cuts).tolist(), 4 * len(ids)]
                self.units.update(zip(part, [data[a + 4 : b] for a, b in zip(places, places[1:])]))
        for h, unit in fresh.items():
            if h not in self.units:
                self.units[h] = np.array(self._ids([unit.decode()])[0], "<u4").tobytes()

    def _by_unit(self, piece: Piece) -> list[np.ndarray]:
        if not len(piece.data):
            return [np.zeros(0, np.uint32)] * piece.n
        starts = unit_starts(piece)
        ends = np.append(starts[1:], len(piece.data))
        hashes, first, which = np.unique(span_hashes(piece.data, starts, ends), return_index=True, return_inverse=True)
        names = hashes.tolist()
        if len(self.units) > MEMO_UNITS:
            self.units.clear()
        raw = piece.data.tobytes()
        spots = zip(names, starts[first].tolist(), ends[first].tolist())
        self._learn({h: raw[a:b] for h, a, b in spots if h not in self.units})
        known = list(map(self.units.__getitem__, names))
        flat = np.frombuffer(b"".join(known), "<u4")
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        begin = np.cumsum(sizes) - sizes
        counts = sizes[which]
        total = np.append(0, np.cumsum(counts))
        ids = flat[np.arange(total[-1]) + np.repeat(begin[which] - total[:-1], counts)]
        cuts = total[np.searchsorted(starts, piece.offsets)]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """One array of ids per text (UTF-8, no nulls)."""
        out: list[np.ndarray] = []
        for piece in pieces(texts, PIECE_BYTES):
            ids = self._by_unit(piece) if self.by_unit else [None] * piece.n
            odd = np.searchsorted(piece.offsets, np.flatnonzero(_MAYBE_SPACE[piece.data]), side="right") - 1
            for k in np.unique(odd).tolist() if self.by_unit else range(piece.n):
                text = piece.data[piece.offsets[k] : piece.offsets[k + 1]].tobytes()
                if not self.by_unit or _OTHER_SPACE.search(text):
                    ids[k] = np.array(self._ids([text.decode()])[0], np.uint32)
            out += ids
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary."""
    return Encoder(path)


def encode_tokens(docs: DataFrame, path: str, *, text: str = "text", end: int | None = 0, name: str = "token_ids") -> DataFrame:
    """``docs`` with an array<int> of the ids of the whole text (a null text has none) and ``end`` behind them.

    An input column of that name is replaced; rows are kept one by one.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != name]
    wide = docs.select(*kept, F.array().cast("array<int>").alias(name), text_bytes(text).alias("_whole_text"))
    tail = [] if end is None else [end]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.concatenate((i, tail)).astype(np.int32) for i in encoder(path).encode(batch.column(batch.num_columns - 1))]
            made = pa.array(ids, batch.schema.field(name).type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], made], names=batch.schema.names[:-1])

    return wide.mapInArrow(run, wide.drop("_whole_text").schema)


def write_tokens(docs: DataFrame, folder: str, path: str, *, doc: str = "doc_id", text: str = "text", end: int = 0, slices: int | None = None) -> None:
    """Write the ids of all texts to files in ``folder``, in ascending order of the document ids (null first).

    Texts are range-partitioned and sorted by id (and text, so equal ids can
    share tasks), encoded, and packed into segments as they stream by: no task
    holds more than a segment beyond its sort. The files are written by Spark's
    own writer, so lost tasks leave nothing behind. ``slices`` is the number of
    ranges (default: the session's shuffle partitions). A null text has ``end``
    as its only token; repeated rows are written once each. Ids of any type are
    stored as their string.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc).alias("doc"), text_bytes(text).alias("text"))
    keys = [F.col("doc").asc_nulls_first(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(*([slices] if slices else []), *keys).sortWithinPartitions(*keys)
    named = ranged.select(F.col("doc").cast("string").alias("doc"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        names: list[bytes | None] = []
        first = size = 0

        def segment() -> pa.RecordBatch:
            ids = np.concatenate(held)
            starts = np.concatenate(([0], np.cumsum([len(h) for h in held], dtype=np.int64)))
            packed = Segment(number, first, Codes.build(ids), starts, names).to_bytes()
            return pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], names=["segment"])

        for batch in batches:
            encoded = encoder(path).encode(batch.column(1))
            for name, ids in zip(batch.column(0).to_pylist(), encoded):
                held.append(np.append(ids, np.uint32(end)))
                names.append(None if name is None else name.encode())
                size += len(held[-1])
                if size >= SEGMENT_TOKENS:
                    yield segment()
                    first += size
                    held, names, size = [], [], 0
        if held:
            yield segment()

    # Bytes pass through a string column unchanged; the writer puts a line feed behind each.
    lines = named.mapInArrow(run, "segment binary").select(F.col("segment").cast("string").alias("value"))
    lines.write.option("maxRecordsPerFile", SEGMENTS_PER_FILE).text(folder)


def read_documents(spark: SparkSession, folder: str, kind: DataType | str = "long") -> DataFrame:
    """(slice, slice_start, doc_id, n_tokens, ids_crc32) per document, read back from the files.

    ``slice_start`` counts the slice's tokens before the document. Each
    document is read by its place, through the levels. The checksum is of its
    ids as little-endian unsigned 32-bit integers.
    """
    files = spark.read.format("binaryFile").load(folder).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for s in segments_of(content.as_buffer().to_pybytes()):
                    sums = [zlib.crc32(s.document(k).astype("<u4").tobytes()) for k in range(len(s.docs))]
                    starts = s.starts.astype(np.int64)
                    columns = [
                        pa.array(np.full(len(s.docs), s.slice, np.int32)), pa.array(starts[:-1] + s.first),
                        pa.array([None if d is None else d.decode() for d in s.docs], pa.string()), pa.array(np.diff(starts)), pa.array(sums, pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["slice", "slice_start", "doc_id", "n_tokens", "ids_crc32"])

    rows = files.mapInArrow(run, "slice int, slice_start long, doc_id string, n_tokens long, ids_crc32 long")
    return rows.withColumn("doc_id", F.col("doc_id").cast(kind))


def with_starts(rows: DataFrame, settle) -> DataFrame:
    """``read_documents`` with ``start``, the tokens of all documents before: slice totals are added up, one row a slice."""
    rows = settle(rows, "token-rows")
    totals = rows.groupBy("slice").agg(F.sum("n_tokens").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = settle(totals.select("slice", before.alias("_base")), "token-slices")
    joined = lookup(rows, bases, "slice", ["slice", "slice_start"])
    return joined.select("doc_id", (F.col("_base") + F.col("slice_start")).alias("start"), "n_tokens", "ids_crc32")
