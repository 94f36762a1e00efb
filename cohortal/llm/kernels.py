"""Language identification by string kernels: Nyström landmarks and one-versus-rest kernel ridge regression.

The kernel of two texts is the number of n-grams (one to three bytes of the
lower-cased text, other characters than letters as one space) that both have,
over the geometric mean of how many each has. A text is mapped to its kernel
values with a few landmark texts; only n-grams of landmarks count there, so a
batch of texts is scored by products of small matrices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortal.llm.sampling import bounded_sample
from cohortal.llm.words import Piece, pieces, small_batches, table, text_bytes

LANDMARKS = 24  # texts per language
ALL_LANDMARKS = 768  # with more languages each has fewer, but one at least
LANDMARK_BYTES = 4_000  # longer texts are landmarks only where a language has no others
TRAINING = 1_500  # texts per language that the regression is fitted on
ALL_VALUES = 16_000_000  # kernel values that are fitted; with more languages each has fewer texts
RIDGE = 1e-3
UNKNOWN = "und"

_LETTER = table(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
_FOLD = np.array([(b + 32 if 0x41 <= b <= 0x5A else b) if _LETTER[b] else 0x20 for b in range(256)], dtype=np.uint8)


def ngrams(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, n-gram) pairs of a piece: owners and codes. Lengths have separate code ranges."""
    folded = _FOLD[piece.data]
    blank = folded == 0x20
    again = np.zeros(len(folded), bool)
    again[1:] = blank[1:] & blank[:-1]
    inner = piece.offsets[1:-1]
    again[inner[inner < len(folded)]] = False
    sizes = np.diff(np.concatenate(([0], np.cumsum(~again)))[piece.offsets])
    codes = folded[~again].astype(np.int64)
    owner = np.repeat(np.arange(piece.n, dtype=np.int64), sizes)
    parts = [(owner << 26) + codes]
    two = (codes[:-1] << 8) + codes[1:]
    same = owner[:-1] == owner[1:]
    parts.append(((owner[:-1] << 26) + (1 << 25) + two)[same])
    three = (two[:-1] << 8) + codes[2:]
    same = owner[:-2] == owner[2:]
    parts.append(((owner[:-2] << 26) + (1 << 24) + three)[same])
    # Few distinct n-grams per text: one sort for all.
    found = np.unique(np.concatenate(parts))
    return found >> 26, found & ((1 << 26) - 1)


@dataclass
class Kernel:
    """Landmark n-grams (sorted codes) and which landmark has which, scaled by the landmarks' norms."""

    codes: np.ndarray
    weights: np.ndarray  # n-grams x landmarks

    @classmethod
    def of(cls, landmarks: list[bytes]) -> Kernel:
        sets = []
        for text in landmarks:
            data = np.frombuffer(text, np.uint8)
            sets.append(ngrams(Piece(0, data, np.array([0, len(data)])))[1])
        codes = np.unique(np.concatenate(sets))
        weights = np.zeros((len(codes), len(sets)), np.float32)
        for k, own in enumerate(sets):
            weights[np.searchsorted(codes, own), k] = 1 / np.sqrt(max(1, len(own)))
        return cls(codes, weights)

    def values(self, piece: Piece) -> np.ndarray:
        """Kernel of every document of a piece with every landmark."""
        owner, codes = ngrams(piece)
        norms = np.sqrt(np.maximum(1, np.bincount(owner, minlength=piece.n)))
        place = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        known = self.codes[place] == codes
        present = np.zeros((piece.n, len(self.codes)), np.float32)
        present[owner[known], place[known]] = 1
        return (present @ self.weights) / norms[:, None].astype(np.float32)


def fit(values: np.ndarray, among: np.ndarray, labels: np.ndarray, n_labels: int, ridge: float = RIDGE) -> np.ndarray:
    """Coefficients on kernel values (landmarks x labels, and a constant row last).

    The Nyström map is the inverse square root of the landmarks' own kernel;
    ridge regression of +1 / -1 targets is solved in the mapped space.
    """
    power, vectors = np.linalg.eigh(among.astype(np.float64))
    good = power > 1e-6 * power.max()
    nystrom = vectors[:, good] / np.sqrt(power[good])
    mapped = np.concatenate([values.astype(np.float64) @ nystrom, np.ones((len(values), 1))], axis=1)
    targets = np.where(labels[:, None] == np.arange(n_labels)[None, :], 1.0, -1.0)
    # Languages count alike, however many texts each has.
    weight = 1 / np.bincount(labels, minlength=n_labels)[labels]
    weight *= len(labels) / weight.sum()
    gram = (mapped * weight[:, None]).T @ mapped + ridge * len(labels) * np.diag(np.append(np.ones(mapped.shape[1] - 1), 0.0))
    solved = np.linalg.lstsq(gram, (mapped * weight[:, None]).T @ targets, rcond=None)[0]
    return np.concatenate([nystrom @ solved[:-1], solved[-1:]]).astype(np.float32)


def kernel_rows(texts: DataFrame, kernel: Kernel) -> DataFrame:
    """(label, values): kernel values of labelled texts (columns label, bytes)."""
    shared = texts.sparkSession.sparkContext.broadcast((kernel.codes, kernel.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Kernel(*shared.value)
        for batch in batches:
            values = [v.tobytes() for piece in pieces(batch.column(1)) for v in own.values(piece)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.binary())], names=["label", "values"])

    return texts.mapInArrow(run, "label string, values binary")


@dataclass
class LanguageModel:
    labels: list[str]
    kernel: Kernel | None
    coefficients: np.ndarray | None

    def decide(self, piece: Piece) -> tuple[np.ndarray, np.ndarray]:
        """Best label number and its score (0 to 1) per document."""
        found = self.kernel.values(piece) @ self.coefficients[:-1] + self.coefficients[-1]
        return found.argmax(axis=1), np.clip((found.max(axis=1) + 1) / 2, 0, 1)


def sample_sizes(n_labels: int) -> tuple[int, int]:
    """Landmarks and fitted texts per language, so that both tables stay bounded for any number of languages."""
    marks = max(1, min(LANDMARKS, ALL_LANDMARKS // max(1, n_labels)))
    return marks, max(2 * marks, min(TRAINING, ALL_VALUES // (marks * max(1, n_labels) ** 2)))


def learn(train: DataFrame, settle) -> LanguageModel:
    """``train`` has label (never null) and bytes. Every label is learned, from bounded samples of distinct texts."""
    small_batches(train.sparkSession)
    short = train.withColumns({"size": F.length("bytes"), "hash": F.xxhash64("bytes")})
    # Copies of a text count once: 16 bytes a text are shuffled, the texts stay where they are.
    known = settle(short.select("label", "hash", "size").distinct(), "language-texts")
    every = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not every:
        return LanguageModel([], None, None)
    labels = sorted(every)
    marks, training = sample_sizes(len(labels))
    order = F.col("hash")
    chosen = bounded_sample(known.where(F.col("size") <= LANDMARK_BYTES), "label", marks, order, len(labels)).select("label", "hash")
    # A language of long texts only gives its shortest few.
    long_only = known.join(chosen.select("label").distinct(), "label", "left_anti")
    shortest = long_only.groupBy("label").agg(F.min(F.struct("size", "hash"))["hash"].alias("hash"))
    fitted = bounded_sample(known, "label", training, order, len(labels)).select("label", "hash")
    picked = settle(
        chosen.union(shortest).withColumn("mark", F.lit(True)).unionByName(fitted.withColumn("mark", F.lit(False))).groupBy("label", "hash").agg(F.max("mark").alias("mark"), F.min("mark").alias("only")),
        "language-picked",
    )
    # A bounded table; of the copies of a text the first one found stays.
    texts = short.join(F.broadcast(picked), ["label", "hash"]).groupBy("label", "hash").agg(F.first("bytes").alias("bytes"), F.max("mark").alias("mark"), F.min("only").alias("only"))
    texts = settle(texts, "language-sample")
    found = sorted((r["label"], bytes(r["bytes"])) for r in texts.where("mark").select("label", "bytes").collect())
    kernel = Kernel.of([b for _, b in found])
    rows = kernel_rows(texts.where("not only").select("label", "bytes"), kernel).collect()
    values = np.stack([np.frombuffer(bytes(r["values"]), np.float32) for r in rows])
    data = np.frombuffer(b"".join(b for _, b in found), np.uint8)
    among = kernel.values(Piece(0, data, np.cumsum([0, *[len(b) for _, b in found]])))
    place = {label: k for k, label in enumerate(labels)}
    numbers = np.array([place[r["label"]] for r in rows])
    return LanguageModel(labels, kernel, fit(values, (among + among.T) / 2, numbers, len(labels)))


def identify_languages(docs: DataFrame, settle, *, doc: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Documents whose crc32(doc_id) mod 4 is 2 are never learned from. Every
    label of the others is learned, however many there are; of equal scores the
    first label by name wins. A null
    text and a text without a letter are ``und`` with score 0, as is every text
    where nothing could be learned. Whole texts are read. Repeated rows and null
    ids (not held out) are scored row by row.
    """
    held = F.crc32(F.coalesce(F.col(doc).cast("string"), F.lit("")).cast("binary")) % 4 == 2
    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    train = docs.where(~held & lettered & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("label"), text_bytes(text).alias("bytes"))
    model = learn(train, settle)
    rows = docs.select(F.col(doc).alias("doc_id"), held.alias("held_out"), lettered.alias("lettered"), text_bytes(text).alias("bytes"))
    parts = (model.labels, model.kernel and (model.kernel.codes, model.kernel.weights), model.coefficients)
    shared = docs.sparkSession.sparkContext.broadcast(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, kernel, coefficients = shared.value
        own = LanguageModel(labels, kernel and Kernel(*kernel), coefficients)
        for batch in batches:
            names, scores = [], []
            lettered = batch.column(2).to_pylist()
            for piece in pieces(batch.column(3)):
                best, score = own.decide(piece) if labels else (np.zeros(piece.n, int), np.zeros(piece.n))
                for k in range(piece.n):
                    known = bool(labels) and lettered[piece.first + k]
                    names.append(labels[best[k]] if known else UNKNOWN)
                    scores.append(float(score[k]) if known else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {docs.schema[doc].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
