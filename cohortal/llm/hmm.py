"""Language-model scores from a hidden Markov model trained by Baum-Welch.

Documents are packed into shards. Words are counted over all training shards;
the most frequent words are classes of their own and every other word belongs to
a class of words with the same last two bytes, so the emission table of the
latent states is bounded while the counts behind it follow the corpus:
P(word | state) = P(class | state) P(word | class). Each Baum-Welch pass sums the
expected counts of all shards. The scaled forward recursion gives each text's
exact likelihood.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from cohortal.llm.blocks import key_totals, pack, shard_totals, unpack
from cohortal.llm.words import LOWER, NOT_SPACE, Piece, mix, per_document, pieces, small_batches, span_hashes, spans, text_bytes

SHARD_BYTES = 6 << 20  # text of one shard; a longer text is a shard of its own
STATES = 4
HEAD_WORDS = 4096  # frequent words with a class of their own
TAIL_CLASSES = 1024  # classes of the other words
PASSES = 8  # Baum-Welch passes, each over all training shards
STEP_TOKENS = 1 << 20  # tokens of the shards that go through one recursion together
FAN_IN = 32  # partial sums added in one task
ADD = 0.1  # smoothing of counts

CLASSES = 1 + HEAD_WORDS + TAIL_CLASSES  # class 0 is the end


def _blob(values: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(values).tobytes()], pa.binary())


SHARD_SCHEMA = "shard long, docs array<long>, held array<boolean>, n_words binary, ids binary, order binary, keys binary, extra binary, counts binary, n_keys long"


def encode(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per shard: document ids, words by their rank in the shard, and the shard's sorted vocabulary with training counts."""
    held = F.crc32(F.coalesce(F.col(doc).cast("string"), F.lit("")).cast("binary")) % 10 == 0
    rows = docs.select(F.col(doc).cast("long").alias("doc"), held.alias("held"), text_bytes(text).alias("bytes"))
    small_batches(docs.sparkSession)

    def shard(number: int, ids: list, held: list, parts: list) -> pa.RecordBatch:
        hashes = np.concatenate([p[0] for p in parts])
        suffix = np.concatenate([p[1] for p in parts])
        counts = np.concatenate([p[2] for p in parts])
        keys, place, inverse, everywhere = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        train = np.repeat(~np.array(held, dtype=bool), counts)
        own = np.bincount(inverse[train], minlength=len(keys)).astype(np.int32)
        # Frequent words get small numbers, which compress well.
        order = np.argsort(-everywhere, kind="stable").astype(np.int32)
        rank = np.empty(len(keys), np.int32)
        rank[order] = np.arange(len(keys), dtype=np.int32)
        arrays = [pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_()))]
        packed = [pack(counts.astype(np.int32)), pack(rank[inverse]), pack(order), pack(keys, True), pack(suffix[place]), pack(own)]
        arrays += [pa.array([p], pa.binary()) for p in packed] + [pa.array([len(keys)], pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=["shard", "docs", "held", "n_words", "ids", "order", "keys", "extra", "counts", "n_keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, held, parts, size = [], [], [], 0
        for batch in batches:
            names, flags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for piece in pieces(batch.column(2)):
                if ids and size + len(piece.data) > SHARD_BYTES:
                    yield shard(number, ids, held, parts)
                    number, ids, held, parts, size = number + 1, [], [], [], 0
                low = Piece(piece.first, LOWER[piece.data], piece.offsets)
                starts, ends, first = spans(low, NOT_SPACE)
                last = low.data[ends - 1].astype(np.int16) if len(ends) else np.zeros(0, np.int16)
                if len(ends):
                    last = last * 128 + np.where(ends - starts > 1, low.data[np.maximum(ends - 2, 0)], 0) % 128
                parts.append((span_hashes(low.data, starts, ends), last, np.diff(first)))
                ids += names[piece.first : piece.first + piece.n]
                held += flags[piece.first : piece.first + piece.n]
                size += len(piece.data)
        if ids:
            yield shard(number, ids, held, parts)

    return rows.mapInArrow(run, SHARD_SCHEMA)


def _summary(words: np.ndarray, totals: np.ndarray, suffixes: np.ndarray) -> list[tuple]:
    """What the classes need of a bucket: its most frequent training words, and sums by suffix."""
    seen = totals > 0
    words, totals, suffixes = words[seen], totals[seen], suffixes[seen]
    top = np.lexsort((words.view(np.int64), -totals))[:HEAD_WORDS]
    out = [(int(w), int(c), int(s), None) for w, c, s in zip(words[top].view(np.int64), totals[top], suffixes[top])]
    kinds, inverse, n = np.unique(suffixes, return_inverse=True, return_counts=True)
    sums = np.bincount(inverse, totals, minlength=len(kinds)).astype(np.int64)
    return out + [(None, int(c), int(s), int(k)) for s, c, k in zip(kinds, sums, n)]


@dataclass
class Vocabulary:
    """Totals over the training texts and what the classes need; bounded by the number of classes."""

    n_tokens: int
    n_words: int
    n_ends: int
    head: np.ndarray  # sorted hashes of the frequent words
    class_tokens: np.ndarray
    class_words: np.ndarray

    def classes(self, words: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
        tail = 1 + HEAD_WORDS + (mix(suffixes.astype(np.int64).view(np.uint64) + np.uint64(7)) % np.uint64(TAIL_CLASSES)).astype(np.int64)
        if not len(self.head):
            return tail
        place = np.minimum(np.searchsorted(self.head, words), len(self.head) - 1)
        return np.where(self.head[place] == words, 1 + place, tail)

    def within(self, counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """log10 P(word | class); a class of the head has one word."""
        share = (counts + ADD) / (self.class_tokens[classes] + ADD * (self.class_words[classes] + 1))
        return np.where(classes <= HEAD_WORDS, 0.0, np.log10(share))

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + ADD) / (self.n_tokens + ADD * (self.n_words + 1)))


def learn_vocabulary(totals: DataFrame, n_ends: int) -> Vocabulary:
    """From the buckets' summaries: head candidates (key, total, extra) and sums by suffix (total, extra, n)."""
    by_suffix = totals.where("n is not null").groupBy("extra").agg(F.sum("total").alias("c"), F.sum("n").alias("n")).collect()
    head_rows = totals.where("key is not null").orderBy(F.desc("total"), "key").limit(HEAD_WORDS).select("key", "total", "extra").collect()
    head = np.sort(np.array([r["key"] for r in head_rows], dtype=np.int64).view(np.uint64))
    none = np.zeros(1, np.uint64)
    tail = Vocabulary(0, 0, 0, none[:0], none, none)
    tokens, words = np.zeros(CLASSES), np.zeros(CLASSES)
    for sign, rows in ((1, [(r["extra"], r["c"], r["n"]) for r in by_suffix]), (-1, [(r["extra"], r["total"], 1) for r in head_rows])):
        for suffix, c, n in rows:
            k = int(tail.classes(none, np.array([suffix], np.int16))[0])
            tokens[k] += sign * c
            words[k] += sign * n
    n_tokens, n_words = sum(r["c"] for r in by_suffix), sum(r["n"] for r in by_suffix)
    return Vocabulary(n_tokens + n_ends, n_words + (1 if n_ends else 0), n_ends, head, tokens, words)


CLASS_SCHEMA = "shard long, docs array<long>, held array<boolean>, n_tokens binary, classes binary, n_known array<long>, base array<double>, within array<double>"


def to_classes(shards: DataFrame, answers: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Per shard the class of every token (ends included) and, per document, what is already known of its scores."""
    shared = shards.sparkSession.sparkContext.broadcast(vocabulary)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        vocab: Vocabulary = shared.value
        out = []
        for row in left.to_pylist():
            words, suffixes = unpack(row["keys"], np.uint64, True), unpack(row["extra"], np.int16)
            totals, order = shard_totals(right), unpack(row["order"], np.int32)
            counts, ids = unpack(row["n_words"], np.int32).astype(np.int64), unpack(row["ids"], np.int32)
            kinds, totals = vocab.classes(words, suffixes)[order], totals[order]
            n = len(counts)
            first = np.concatenate(([0], np.cumsum(counts)))
            total = lambda values: np.add.reduceat(np.append(values[ids], 0.0), first[:-1]) * (counts > 0)
            end = vocab.base(np.array([float(vocab.n_ends)]))[0]
            tokens = np.zeros(len(ids) + n, np.int16)
            tokens[np.arange(len(ids)) + np.repeat(np.arange(n), counts)] = kinds[ids]
            known = per_document((totals > 0)[ids], first) + (1 if vocab.n_ends else 0)
            out.append({
                "shard": row["shard"], "docs": row["docs"], "held": row["held"], "n_tokens": pack((counts + 1).astype(np.int32)), "classes": pack(tokens),
                "n_known": known.tolist(), "base": (total(vocab.base(totals)) + end).tolist(), "within": total(vocab.within(totals, kinds)).tolist(),
            })
        schema = pa.schema([("shard", pa.int64()), ("docs", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("n_tokens", pa.binary()), ("classes", pa.binary()), ("n_known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64())), ("within", pa.list_(pa.float64()))])
        return pa.Table.from_pylist(out, schema)

    asked = shards.select("shard", "docs", "held", "n_words", "ids", "order", "keys", "extra")
    return asked.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(run, CLASS_SCHEMA)


@dataclass
class Model:
    """Start, transition and emission probabilities."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # classes x states

    @classmethod
    def first(cls, vocabulary: Vocabulary, states: int = STATES) -> Model:
        """Nearly equal states, told apart by fixed pseudorandom factors."""
        noise = np.random.default_rng(7)
        emit = noise.uniform(0.5, 1.5, (CLASSES, states))
        move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(axis=0))

    @classmethod
    def of(cls, counts: np.ndarray, states: int = STATES) -> Model:
        """The M step: smoothed shares of the expected counts."""
        start, move, emit = np.split(counts, [states, states + states * states])
        start, move, emit = start + ADD, move.reshape(states, states) + ADD, emit.reshape(CLASSES, states) + ADD
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _steps(first: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of the chosen documents step by step, longest document first, so that each step is one stretch.

    Returns the documents in that order, the bounds of the steps, the token at
    each place, and per token (document by document) its document and place.
    """
    lengths = np.diff(first)[chosen]
    order = np.argsort(-lengths, kind="stable")
    lengths, begin = lengths[order], first[:-1][chosen[order]]
    running = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), side="right")
    bounds = np.concatenate(([0], np.cumsum(running)))
    step = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    place = bounds[step] + owner
    at = np.empty(len(place), np.int64)
    at[place] = np.repeat(begin, lengths) + step
    return chosen[order], bounds, at, owner, place


def forward(model: Model, classes: np.ndarray, first: np.ndarray, chosen: np.ndarray, keep: bool = False):
    """log10 likelihood of each chosen document by the scaled forward recursion; with ``keep`` also the steps with all alphas and scales."""
    order, bounds, at, owner, place = _steps(first, chosen)
    classes = classes[at]
    alpha = model.emit[classes]
    scales = np.empty(len(classes))
    ones, now = np.ones(len(model.start)), None
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        before, now = now, alpha[low:high]
        now *= model.start if before is None else before[: high - low] @ model.move
        scale = np.matmul(now, ones, out=scales[low:high])
        now /= scale[:, None]
    out = np.zeros(len(first) - 1)
    out[order] = np.bincount(owner, np.log10(scales[place]), minlength=len(order))
    return (out, bounds, classes, alpha, scales) if keep else out


def expected_counts(model: Model, classes: np.ndarray, first: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The E step over the chosen documents: start, transition and emission counts in one vector."""
    states = len(model.start)
    _, bounds, classes, alpha, scales = forward(model, classes, first, chosen, keep=True)
    move, back = np.zeros((states, states)), np.ascontiguousarray(model.move.T)
    gamma, beta, bounds = alpha, None, bounds.tolist()  # becomes the posterior, from the last step back
    for t in range(len(bounds) - 2, -1, -1):
        low, high = bounds[t], bounds[t + 1]
        ahead, beta = beta, np.ones((high - low, states))
        if ahead is not None:
            end = bounds[t + 2]
            weight = model.emit[classes[high:end]]
            weight *= ahead
            weight /= scales[high:end, None]
            move += alpha[low : low + end - high].T @ weight
            np.matmul(weight, back, out=beta[: end - high])
        gamma[low:high] *= beta
    start = gamma[: bounds[1]].sum(axis=0) if len(bounds) > 1 else np.zeros(states)
    emit = np.stack([np.bincount(classes, gamma[:, k], minlength=CLASSES) for k in range(states)], axis=1)
    return np.concatenate([start, (move * model.move).ravel(), emit.ravel()])


def _starts(lengths: bytes) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(unpack(lengths, np.int32), dtype=np.int64)))


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Held-out flags, starts and classes of whole shards, put together up to ``STEP_TOKENS``."""
    flags, lengths, classes = [], [], []

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = np.concatenate(flags), np.concatenate(([0], np.cumsum(np.concatenate(lengths), dtype=np.int64))), np.concatenate(classes)
        flags.clear(), lengths.clear(), classes.clear()
        return out

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            own = unpack(row[2], np.int16)
            if flags and sum(map(len, classes)) + len(own) > STEP_TOKENS:
                yield joined()
            flags.append(np.array(row[0], dtype=bool))
            lengths.append(unpack(row[1], np.int32))
            classes.append(own)
    if flags:
        yield joined()


def sum_vectors(parts: DataFrame) -> np.ndarray | None:
    """Add float vectors (column v) over all rows in steps of ``FAN_IN``, the last few on the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for v in batch.column(0).to_pylist():
                v = np.frombuffer(v, np.float64)
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([_blob(total)], names=["v"])

    while (n := parts.rdd.getNumPartitions()) > FAN_IN:
        parts = parts.repartition(-(-n // FAN_IN)).mapInArrow(add, "v binary")
    rows = parts.collect()
    return sum((np.frombuffer(bytes(r["v"]), np.float64) for r in rows[1:]), np.frombuffer(bytes(rows[0]["v"]), np.float64)) if rows else None


def baum_welch(encoded: DataFrame, model: Model, passes: int) -> Model:
    """``passes`` times: expected counts of the training documents of all shards, summed, then new probabilities."""
    for _ in range(passes):
        shared = encoded.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = None
            for held, first, classes in _together(batches):
                chosen = np.flatnonzero(~held)
                if len(chosen):
                    part = expected_counts(shared.value, classes, first, chosen)
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([_blob(total)], names=["v"])

        counts = sum_vectors(encoded.select("held", "n_tokens", "classes").mapInArrow(run, "v binary"))
        if counts is None:
            return model
        model = Model.of(counts)
    return model


def score_documents(encoded: DataFrame, model: Model, vocabulary: Vocabulary) -> DataFrame:
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    n_tokens = vocabulary.n_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                first, classes = _starts(row["n_tokens"]), unpack(row["classes"], np.int16)
                n = len(first) - 1
                latent = forward(shared.value, classes, first, np.arange(n))
                arrays = [
                    pa.array(row["docs"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(np.diff(first)), pa.array(row["n_known"], pa.int64()),
                    pa.array(np.full(n, n_tokens, np.int64)), pa.array(row["base"], pa.float64()), pa.array(latent + np.array(row["within"])),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return encoded.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_texts(docs: DataFrame, settle, *, doc: str = "doc_id", text: str = "text", passes: int = PASSES) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose crc32(doc_id) mod 10 is 0 are scored but not learned from.
    A null or empty text is its end alone; a null id counts as the empty text
    (held out). Repeated rows count each. Word identity is a 64-bit hash. With no
    training text at all, scores come from the smoothing alone.
    """
    shards = settle(encode(docs, doc, text), "hmm-shards")
    totals = key_totals(shards, settle, "hmm-totals", _summary, "extra")
    trained = F.size(F.filter("held", lambda h: ~h))
    n_ends = shards.select(F.sum(trained)).first()[0] or 0
    vocabulary = learn_vocabulary(totals, int(n_ends))
    answers = totals.where("shard is not null").select("shard", "bucket", "totals")
    encoded = settle(to_classes(shards, answers, vocabulary), "hmm-classes")
    model = baum_welch(encoded, Model.first(vocabulary), passes)
    return score_documents(encoded, model, vocabulary)
