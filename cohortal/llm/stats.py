"""Counts over whole texts, vectorised over the documents of a piece."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortal.llm.words import LEAD, NOT_SPACE, Piece, map_batches, mix, per_document, pieces, span_hashes, spans, table, text_bytes, windows

_SYMBOL = table(lambda b: chr(b) in "#*$%&|<>")
_LINE = table(lambda b: b != 0x0A)
_UPPER = table(lambda b: 0x41 <= b <= 0x5A)
_LETTER = table(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0xC0)
_DIGIT = table(lambda b: 0x30 <= b <= 0x39)
_STOP = table(lambda b: chr(b) in ".!?")
_COMMA = table(lambda b: chr(b) in ",;:")
_MARK = table(lambda b: chr(b) in "!?")

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_chars",
    "n_upper", "n_letters", "n_digits", "n_stops", "n_commas", "n_marks", "n_long_words", "n_short_words",
    "n_capital_words", "n_stop_words", "n_same_as_before", "longest_line",
)


def _repeats(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For keys, each in a document: whether it occurs there twice or more, and whether it is not the first there."""
    n = len(keys)
    both = mix(keys + mix(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(both, kind="stable")
    ranked = both[order]
    same = ranked[1:] == ranked[:-1]
    twice, later = np.zeros(n, bool), np.zeros(n, bool)
    later[order[1:][same]] = True
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice, later


def piece_counts(piece: Piece) -> dict[str, np.ndarray]:
    """All counts of ``COUNTS``, one number per document."""
    data, offsets = piece.data, piece.offsets
    starts, ends, first = spans(piece, NOT_SPACE)
    n_words = np.diff(first)
    owner = np.repeat(np.arange(piece.n), n_words)
    hashes = span_hashes(data, starts, ends)
    of = lambda flags: per_document(flags, offsets)
    in_words = lambda flags: per_document(flags, first)
    lead = LEAD[data]
    code_points = np.concatenate(([0], np.cumsum(lead)))
    lengths = code_points[ends] - code_points[starts]

    window, place = windows(hashes, first, 3)
    twice, _ = _repeats(window, owner[place])
    covered = np.zeros(len(hashes), bool)
    for j in range(3):
        covered[place[twice] + j] = True
    _, seen = _repeats(hashes, owner)
    before = np.zeros(len(hashes), bool)
    before[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])

    line_starts, line_ends, line_first = spans(piece, _LINE)
    line_owner = np.repeat(np.arange(piece.n), np.diff(line_first))
    solid = np.concatenate(([0], np.cumsum(NOT_SPACE[data])))
    full = solid[line_ends] > solid[line_starts]
    _, again = _repeats(span_hashes(data, line_starts, line_ends), line_owner)
    line_lengths = code_points[line_ends] - code_points[line_starts]
    longest = np.zeros(piece.n, np.int64)
    np.maximum.at(longest, line_owner, line_lengths)

    return {
        "n_words": n_words,
        "word_chars": in_words(lengths),
        "n_symbols": of(_SYMBOL[data]),
        "n_dup_lines": per_document(full & again, line_first),
        "n_repeat_words": in_words(covered),
        "n_lines": per_document(full, line_first),
        "n_distinct_words": in_words(~seen),
        "n_chars": of(lead),
        "n_upper": of(_UPPER[data]),
        "n_letters": of(_LETTER[data]),
        "n_digits": of(_DIGIT[data]),
        "n_stops": of(_STOP[data]),
        "n_commas": of(_COMMA[data]),
        "n_marks": of(_MARK[data]),
        "n_long_words": in_words(lengths > 12),
        "n_short_words": in_words(lengths < 4),
        "n_capital_words": in_words(_UPPER[data[starts]]) if len(starts) else n_words,
        "n_stop_words": in_words(_STOP[data[ends - 1]]) if len(starts) else n_words,
        "n_same_as_before": in_words(before),
        "longest_line": longest,
    }


def with_counts(docs: DataFrame, keep: list[str], names: tuple[str, ...] = COUNTS, text: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` and the named counts of the whole ``text`` (long); a null text counts as empty."""
    inner = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], text_bytes(text).alias("bytes"))
    schema = ", ".join([f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)] + [f"{n} long" for n in names])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [piece_counts(p) for p in pieces(batch.column(batch.num_columns - 1))]
        arrays = [pa.array(np.concatenate([x[n] for x in found]).astype(np.int64)) for n in names]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=[*batch.schema.names[:-1], *names])

    out = map_batches(inner, run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *names)
