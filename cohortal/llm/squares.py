"""Runs of repeated words, found online by dyadic square catching.

Words are appended to a catcher in pieces of any length. Whenever an aligned
block of 2^k words is complete, it becomes a catcher for the periods from
2^(k-1) up to 2^k: it is compared with the windows of its length that begin up
to 2^k words before it, and every word appended later completes one window that
is compared with the last complete block. The nearest match at distance q is a
square of period q. Squares are extended to both sides and merge into maximal
runs; a run that reaches the end of the text grows with the words that follow.

A run of smallest period q and length 4q or more holds an aligned block of
between q and 2q words whose copy q words before or after it lies in the run
too, and no nearer copy, so none of them is missed. The work is
n log n for n words, whatever their repetition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cohortal.llm.words import mix, small_batches, text_bytes

LEAST_WORDS, LEAST_POWER = 6, 4  # a run is reported from 6 words and four periods on
APPEND_WORDS = 1 << 20  # words appended at once, which bounds the working arrays
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Level:
    """Blocks and windows of ``size`` words: the hashes still needed, and where each stream of catches stands."""

    def __init__(self, size: int):
        self.size = size
        self.first = 0  # text position of hashes[0]
        self.hashes = np.zeros(0, np.uint64)
        self.caught = -1  # last block that has met its nearest copy behind it

    @property
    def end(self) -> int:
        return self.first + len(self.hashes)

    def append(self, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Take the hashes of newly complete windows; returns blocks and distances to the nearest copy before, and after."""
        size, begin = self.size, self.end
        self.hashes = np.concatenate((self.hashes, fresh))
        window, end = self.hashes, self.end
        # Blocks completed now look back over the windows that begin less than a block before them.
        block = max(1, -(-begin // size))
        last = (end - 1) // size
        before = (np.zeros(0, np.int64),) * 2
        if last >= block:
            low = (block - 1) * size - self.first
            own = window[np.arange(block, last + 1) * size - self.first]
            same = np.flatnonzero(window[low : low + len(own) * size] == np.repeat(own, size))
            row, column = same // size, same % size
            row, column = row[column > 0], column[column > 0]
            nearest = np.flatnonzero(np.diff(row, append=-1) != 0)  # the last match of a block
            before = (row[nearest] + block, size - column[nearest])
        # Every new window is compared with the last block that begins before it.
        place = np.arange(begin, end)
        same = np.flatnonzero(window[begin - self.first :] == window[place // size * size - self.first])
        row, column = place[same] // size, place[same] % size
        row, column = row[column > 0], column[column > 0]
        nearest = np.flatnonzero(np.diff(row, prepend=self.caught) != 0)  # the first match of a block
        after = (row[nearest], column[nearest])
        if len(row):
            self.caught = int(row[-1])
        # Later blocks look back less than two blocks.
        keep = max(self.first, (end // size - 2) * size)
        self.hashes, self.first = window[keep - self.first :], keep
        wide = [d * 2 >= size for _, d in (before, after)]
        return before[0][wide[0]], before[1][wide[0]], after[0][wide[1]], after[1][wide[1]]


class SquareCatcher:
    """Online detector over one sequence of small integers.

    ``append`` may be called with any number of words at a time; the runs do
    not depend on how a text is cut.
    """

    def __init__(self) -> None:
        self.text = np.zeros(0, np.int64)
        self.n = 0
        self._words = np.zeros(0, np.uint64)  # single-word hashes not yet paired
        self._levels: list[_Level] = []
        self._ends: dict[tuple[int, int], int] = {}  # (period, start) -> end of every run so far
        self._open: set[tuple[int, int]] = set()

    def append(self, words: np.ndarray) -> None:
        old = self.n
        if old + len(words) > len(self.text):
            grown = np.zeros(max(old + len(words), 2 * old), np.int64)
            grown[:old] = self.text[:old]
            self.text = grown
        self.text[old : old + len(words)] = words
        self.n = old + len(words)
        for key in list(self._open):
            self._grow(key, self._ends[key])
        # Windows of one word; a level takes pairs of windows of the level below.
        below, first = np.concatenate((self._words, mix(words.astype(np.uint64) + np.uint64(1)))), old - len(self._words)
        self._words = below[-1:]
        size = 1
        for depth in range(self.n.bit_length()):
            if depth == len(self._levels):
                self._levels.append(_Level(2 * size))
            level = self._levels[depth]
            skip = level.end - first  # windows already hashed
            fresh = below[skip : len(below) - size] if len(below) - size > skip else below[:0]
            if len(fresh):
                fresh = mix(fresh * _LEFT + (below[skip + size : skip + size + len(fresh)] ^ _RIGHT))
            held, first_held = level.hashes, level.first
            found = level.append(fresh)
            self._take(level.size, found[0], -found[1])
            self._take(level.size, found[2], found[3])
            if level.end < 2 * size:
                break
            size *= 2
            # The next level needs the last ``size`` windows seen before and the new ones.
            below, first = np.concatenate((held, fresh)), first_held

    def _take(self, size: int, blocks: np.ndarray, distances: np.ndarray) -> None:
        """Merge catches (blocks ascending, distance to the nearest copy, negative for before) into runs."""
        done = np.zeros(len(blocks), dtype=bool)
        starts = blocks * size
        for i in range(len(blocks)):
            if done[i]:
                continue
            at, d = int(starts[i]), int(distances[i])
            low, high, period = min(at, at + d), max(at, at + d) + size, abs(d)
            if not np.array_equal(self.text[low : high - period], self.text[low + period : high]):
                raise AssertionError("two windows of one hash differ")
            start = low - self._agree_back(low, period)
            key = (period, start)
            end = self._ends.get(key)
            if end is None or end < high:
                end = self._grow(key, high)
            # The catches that follow inside the same run say nothing new.
            stop = int(np.searchsorted(starts, end - size, side="right"))
            rest = slice(i + 1, max(i + 1, stop))
            inside = (distances[rest] == d) & (starts[rest] + min(d, 0) >= start) & (starts[rest] + max(d, 0) + size <= end)
            done[rest] |= inside

    def _agree_back(self, low: int, period: int) -> int:
        """How many words before ``low`` equal the word one period after them."""
        agree, step = 0, 8
        while agree < low:
            take = min(step, low - agree)
            a = self.text[low - agree - take : low - agree]
            b = self.text[low - agree - take + period : low - agree + period]
            different = np.flatnonzero(a != b)
            if len(different):
                return agree + take - 1 - int(different[-1])
            agree, step = agree + take, step * 2
        return agree

    def _grow(self, key: tuple[int, int], end: int) -> int:
        """Extend a run to the right as far as the text goes now."""
        period, step = key[0], 8
        while end < self.n:
            take = min(step, self.n - end)
            different = np.flatnonzero(self.text[end : end + take] != self.text[end - period : end - period + take])
            if len(different):
                end += int(different[0])
                break
            end, step = end + take, step * 2
        self._ends[key] = end
        (self._open.add if end == self.n else self._open.discard)(key)
        return end

    def runs(self, least: int = LEAST_WORDS, power: int = LEAST_POWER) -> list[tuple[int, int, int]]:
        """(start, length, period) of the runs so far, by start, then period; ``power`` is at least 4."""
        found = ((start, end - start, period) for (period, start), end in self._ends.items())
        return sorted(((s, n, q) for s, n, q in found if n >= max(least, power * q)), key=lambda r: (r[0], r[2]))


def runs_of(words: list[bytes], least: int = LEAST_WORDS, power: int = LEAST_POWER) -> list[tuple[int, int, int]]:
    """Runs of a list of words."""
    if power < LEAST_POWER:
        raise ValueError("runs of fewer than four periods are not all caught")
    names: dict[bytes, int] = {}
    codes = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    catcher = SquareCatcher()
    for k in range(0, len(codes), APPEND_WORDS):
        catcher.append(codes[k : k + APPEND_WORDS])
    return catcher.runs(least, power)


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(depth[:-1]) == 0)
    return [words[k] for k in kept]


RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_NEW = ("n_words", "runs", "collapsed")


def find_runs(docs: DataFrame, *, text: str = "text", least: int = LEAST_WORDS, power: int = LEAST_POWER) -> DataFrame:
    """``docs`` with ``n_words`` (long), ``runs`` (start, length, period; by start, then period) and ``collapsed``.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. ``collapsed`` is the text
    whose words are in no run after that run's first period, joined by one
    space. A null or empty text has no words, no runs and an empty ``collapsed``.
    Rows are handled one by one in the task that reads them, so repeated rows,
    null ids and ids of any type are fine; input columns with the names of the
    three new ones are replaced. Runs that begin at one word differ in period.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in _NEW]
    wide = docs.select(
        *kept, F.lit(0).cast("long").alias("n_words"), F.array().cast(RUNS).alias("runs"), F.lit("").alias("collapsed"),
        text_bytes(text).alias("_bytes_of_text"),
    )
    schema = wide.drop("_bytes_of_text").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found, texts = [], [], []
            for raw in batch.column(batch.num_columns - 1):
                words = raw.as_py().split()
                runs = runs_of(words, least, power)
                counts.append(len(words))
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                texts.append(b" ".join(collapse(words, runs)).decode())
            old = batch.schema
            made = [pa.array(counts, pa.int64()), pa.array(found, old.field("runs").type), pa.array(texts, old.field("collapsed").type)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *made], names=old.names[:-1])

    return wide.mapInArrow(run, schema)


def plant_period(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Repeat a stretch of words to the end of the text in the rows whose crc32 of the id is divisible by 10.

    With n words, h that crc32 and g = h div 10, words from a = g mod n on repeat
    with a period of 1 + (n - a) div (3 + g mod 8). The words are then joined by
    one space. Rows with a null id, and texts without words, stay as they are.
    """
    h = F.crc32(F.col(doc).cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    chosen = docs.withColumn("_w", F.when(h % 10 == 0, words))
    n = F.size("_w")
    begin = F.when(n > 0, (g % n).cast("int"))
    chosen = chosen.withColumns({"_a": begin, "_p": (1 + F.floor((n - begin) / (3 + g % 8))).cast("int")})
    copies = F.ceil((F.size("_w") - F.col("_a")) / F.col("_p")).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("_w", F.col("_a") + 1, F.col("_p")), copies))
    planted = F.array_join(F.slice(F.concat(F.slice("_w", F.lit(1), F.col("_a")), tail), F.lit(1), F.size("_w")), " ")
    return chosen.withColumn(text, F.when(F.col("_a").isNotNull(), planted).otherwise(F.col(text))).drop("_w", "_a", "_p")


def _strongest() -> Column:
    """The run of the greatest length / period, compared exactly; runs come by start, then period, and the first of equals stays."""
    nothing = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    better = lambda a, b: a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"])
    return F.aggregate("runs", nothing, lambda a, b: F.when(better(a, b), b).otherwise(a))


def digest(found: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One row per document: number of runs, its strongest run, and hashes of its runs and of the collapsed text."""
    best = found.select(doc, "runs", "collapsed", _strongest().alias("_best"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    start, length, period = (F.col(f"_best.{c}") for c in ("start", "length", "period"))
    return best.select(
        doc,
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
