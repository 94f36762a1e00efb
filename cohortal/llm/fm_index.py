"""Benchmark decontamination with a word-level FM-index per shard of documents.

A shard is a piece of whole documents. Its word sequence, with words outside the
benchmark vocabulary as separators, is suffix-sorted; the Burrows-Wheeler
transform is kept in a wavelet matrix; all benchmark windows are searched
backwards at once, and occurrences are located from sampled suffix positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortal.llm.words import Piece, pieces, small_batches, spans, table, text_bytes

WINDOW = 10  # consecutive words that count as a copy
SAMPLE = 8  # every eighth suffix position is kept
BLOCK_WORDS = 200_000  # benchmark words searched in one pass, which bounds what is broadcast

# Words: digits, a-z (after lower-casing A-Z) and everything beyond ASCII.
_IN_WORD = table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
_CLEAN = bytes(
    (b + 32 if 0x41 <= b <= 0x5A else b) if (b + 32 if 0x41 <= b <= 0x5A else b) >= 0x80 or chr(b).isalnum() else 0x20
    for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 bytes."""
    return text.translate(_CLEAN).split()


class Patterns:
    """Distinct windows of a block of benchmark items over a dense vocabulary; 0 is no word of it."""

    def __init__(self, items: list[tuple[object, bytes]], width: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for k in range(max(1, len(ids) - width + 1) if ids else 0):
                owners.setdefault(tuple(ids[k : k + width]), set()).add(item)
        self.lengths = np.array([len(p) for p in owners], dtype=np.int64)
        self.symbols = np.zeros((len(owners), width), dtype=np.int64)  # last word first
        for row, pattern in enumerate(owners):
            self.symbols[row, : len(pattern)] = pattern[::-1]
        self.owners = [sorted(x, key=str) for x in owners.values()]
        self.shortest = int(self.lengths.min()) if len(owners) else 0


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``text`` by prefix doubling; the empty suffix sorts first and is left out."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    width = 1
    while True:
        key = rank * (n + 2)
        key[: n - width] += rank[width:] if width < n else 0
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.ones(n, dtype=np.int64)
        new[1:] += np.cumsum(ranked[1:] != ranked[:-1])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        width *= 2
        if new[-1] == n or width >= n:
            return order


class WaveletMatrix:
    """Rank and access over a sequence of small non-negative integers."""

    def __init__(self, values: np.ndarray, top: int):
        self.levels: list[np.ndarray] = []
        self.zeros: list[int] = []
        self.bits = max(1, int(top).bit_length())
        for level in reversed(range(self.bits)):
            bit = (values >> level) & 1
            self.levels.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            zero = bit == 0
            self.zeros.append(int(zero.sum()))
            values = np.concatenate((values[zero], values[~zero]))

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each end."""
        low, high = np.zeros_like(ends), ends.copy()
        for level, ones, zeros in zip(reversed(range(self.bits)), self.levels, self.zeros):
            up = ((symbols >> level) & 1).astype(bool)
            low = np.where(up, zeros + ones[low], low - ones[low])
            high = np.where(up, zeros + ones[high], high - ones[high])
        return high - low

    def access(self, places: np.ndarray) -> np.ndarray:
        """The symbols at places."""
        out = np.zeros_like(places)
        for ones, zeros in zip(self.levels, self.zeros):
            up = ones[places + 1] - ones[places]
            out = out * 2 + up
            places = np.where(up == 1, zeros + ones[places], places - ones[places])
        return out


class FMIndex:
    """Backward search and location over one word sequence; symbol 0 only separates."""

    def __init__(self, text: np.ndarray, top: int, sample: int = SAMPLE):
        # Symbols move up by one: 0 is now the end of the text, 1 the separator.
        text = np.append(text.astype(np.int64) + 1, 0)
        order = suffix_array(text)
        transform = text[order - 1]
        self.n = len(text)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top + 2))))
        self.matrix = WaveletMatrix(transform, top + 1)
        self.sampled = order % sample == 0
        self.samples = order[self.sampled]
        self.sample_rank = np.cumsum(self.sampled) - 1

    def search(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of all patterns; ``symbols`` holds each pattern's last word first."""
        low = np.zeros(len(lengths), dtype=np.int64)
        high = np.full(len(lengths), self.n, dtype=np.int64)
        for step in range(symbols.shape[1]):
            live = np.flatnonzero((high > low) & (lengths > step))
            if not len(live):
                break
            symbol = symbols[live, step] + 1
            low[live] = self.before[symbol] + self.matrix.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.matrix.rank(symbol, high[live])
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step backwards to the next sampled suffix."""
        rows, steps, out = rows.copy(), 0, np.zeros(len(rows), dtype=np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            at = rows[open_]
            done = self.sampled[at]
            out[open_[done]] = self.samples[self.sample_rank[at[done]]] + steps
            open_, at = open_[~done], at[~done]
            symbol = self.matrix.access(at)
            rows[open_] = self.before[symbol] + self.matrix.rank(symbol, at)
            steps += 1
        return out


def _merge(places: np.ndarray) -> list[list[int]]:
    """Sorted distinct word places as [start, end) spans."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > 1)
    return [[int(a), int(b) + 1] for a, b in zip(places[np.append(0, cut + 1)], places[np.append(cut, len(places) - 1)])]


def search_piece(piece: Piece, patterns: Patterns) -> tuple[list[int], list[np.ndarray], list[set]]:
    """Per document of a shard: number of words, places of the words that are hit, items found."""
    clean = np.frombuffer(bytes(piece.data).translate(_CLEAN), dtype=np.uint8)
    starts, ends, first = spans(Piece(piece.first, clean, piece.offsets), _IN_WORD)
    n_words = np.diff(first)
    hits = [np.zeros(0, np.int64)] * piece.n
    items: list[set] = [set() for _ in range(piece.n)]
    if not len(starts) or not patterns.shortest:
        return n_words.tolist(), hits, items
    # Words never cross documents in a split of the joined bytes, as long as documents are split one by one.
    words: list[bytes] = []
    raw = clean.tobytes()
    for a, b in zip(piece.offsets[:-1], piece.offsets[1:]):
        words += raw[a:b].split()
    get = patterns.vocabulary.get
    ids = np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words))
    document = np.repeat(np.arange(piece.n), n_words)
    # Only runs of known words as long as the shortest window can hold one.
    change = np.flatnonzero((ids[1:] == 0) | (ids[:-1] == 0) | (document[1:] != document[:-1])) + 1
    run_starts = np.append(0, change)
    run_lengths = np.diff(np.append(run_starts, len(ids)))
    good = (run_lengths >= patterns.shortest) & (ids[run_starts] > 0)
    run_starts, run_lengths = run_starts[good], run_lengths[good]
    if not len(run_starts):
        return n_words.tolist(), hits, items
    begin = np.cumsum(run_lengths + 1) - run_lengths - 1
    text = np.zeros(int((run_lengths + 1).sum()), dtype=np.int64)
    within = np.arange(int(run_lengths.sum())) - np.repeat(np.cumsum(run_lengths) - run_lengths, run_lengths)
    source = np.repeat(run_starts, run_lengths) + within
    target = np.repeat(begin, run_lengths) + within
    text[target] = ids[source]
    origin = np.zeros(len(text), dtype=np.int64)
    origin[target] = source
    index = FMIndex(text, len(patterns.vocabulary))
    low, high = index.search(patterns.symbols, patterns.lengths)
    found = np.flatnonzero(high > low)
    counts = (high - low)[found]
    if not len(found):
        return n_words.tolist(), hits, items
    pattern = np.repeat(found, counts)
    rows = np.repeat(low[found], counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    place = origin[index.locate(rows)]
    cover = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(cover, place, 1)
    np.add.at(cover, place + patterns.lengths[pattern], -1)
    hit = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
    for d in np.unique(document[hit]):
        hits[d] = hit[np.searchsorted(hit, first[d]) : np.searchsorted(hit, first[d + 1])] - first[d]
    for d, p in np.unique(np.stack([document[place], pattern], axis=1), axis=0):
        items[d].update(patterns.owners[p])
    return n_words.tolist(), hits, items


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[object, bytes]]]:
    """The benchmark in blocks of about ``BLOCK_WORDS`` words, each small enough to be sent to every task."""
    rows = benchmark.select(F.col(item).alias("item"), text_bytes(text).alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-int(size) // (6 * BLOCK_WORDS)))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(r.item, bytes(r.text)) for r in part.collect()]


def find_benchmark(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WINDOW
) -> DataFrame:
    """``docs`` with ``n_words`` (long), ``hit_spans`` (word ranges, end exclusive, merged) and ``hit_items`` (strings, sorted).

    A window is ``width`` consecutive words of an item, or the whole item if it
    has fewer; an item without words has none. A null text has no words. Rows
    are kept one by one, so repeated rows, null ids and ids of any type are
    fine, and input columns with the names of the three new ones are replaced.
    A null item id is written as ``null``. Larger benchmarks are searched in
    blocks, one pass over the documents for each.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("n_words", "hit_spans", "hit_items")]
    out = docs.select(
        *kept,
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<array<long>>").alias("hit_spans"),
        F.array().cast("array<string>").alias("hit_items"),
    )
    for block in _blocks(benchmark, item, item_text):
        patterns = out.sparkSession.sparkContext.broadcast(Patterns([("null" if i is None else str(i), t) for i, t in block], width))
        wide = out.withColumn("_bytes_of_text", text_bytes(text))
        schema = out.schema

        def run(batches: Iterator[pa.RecordBatch], patterns=patterns, schema=schema) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column(batch.num_columns - 1)
                n_words: list[int] = []
                spans_, items_ = [], []
                old_spans, old_items = batch.column(batch.num_columns - 3).to_pylist(), batch.column(batch.num_columns - 2).to_pylist()
                for piece in pieces(column):
                    counts, hits, items = search_piece(piece, patterns.value)
                    n_words += counts
                    for k, (places, found) in enumerate(zip(hits, items)):
                        before = [np.arange(a, b) for a, b in old_spans[piece.first + k]]
                        spans_.append(_merge(np.unique(np.concatenate([places, *before])) if before else places))
                        items_.append(sorted(found.union(old_items[piece.first + k])))
                arrays = list(batch.columns[:-4])
                arrays += [
                    pa.array(n_words, pa.int64()),
                    pa.array(spans_, pa.list_(pa.list_(pa.int64()))),
                    pa.array(items_, pa.list_(batch.column(batch.num_columns - 2).type.value_type)),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names[:-1])

        out = wide.mapInArrow(run, schema)
    return out


def digest(found: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One row per document: counts, the hash of its items and whether it is contaminated."""
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda total, span: total + span[1] - span[0])
    return found.select(
        doc,
        "n_words",
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


def _cut(text: str, spans_: list[list[int]]) -> str:
    raw = text.encode()
    clean = raw.translate(_CLEAN)
    data = np.frombuffer(clean, dtype=np.uint8)
    starts, ends, _ = spans(Piece(0, data, np.array([0, len(data)])), _IN_WORD)
    parts, at = [], 0
    for a, b in spans_:
        parts.append(raw[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join([*parts, raw[at:]]).decode("utf-8", "replace")


def remove_spans(found: DataFrame, text: str = "text", drop_emptied: bool = False) -> DataFrame:
    """Cut the hit spans out of the texts; the three search columns go. Texts without hits stay as they are.

    With ``drop_emptied``, rows whose words were all cut are dropped.
    """
    columns = [c for c in found.columns if c not in ("n_words", "hit_spans", "hit_items")]
    if drop_emptied:
        n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda total, span: total + span[1] - span[0])
        found = found.where((n_hit == 0) | (n_hit < F.col("n_words")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spot = batch.schema.get_field_index(text)
            texts, hits = batch.column(spot), batch.column(batch.num_columns - 1).to_pylist()
            if any(hits):
                cut = [_cut(t, h) if h else t for t, h in zip(texts.to_pylist(), hits)]
                texts = pa.array(cut, texts.type)
            arrays = [texts if k == spot else batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names[:-1])

    return found.select(*columns, "hit_spans").mapInArrow(run, found.select(*columns).schema)
