"""Secret scans with probabilistic automata inferred from labelled credentials.

Values found by the base patterns are labelled credentials of three kinds. For
each kind a prefix tree over character classes is built and its statistically
compatible states are merged (ALERGIA with Hoeffding bounds). Other tokens that
could be secrets give a background automaton in the same way. Every candidate
token of every text is scored by how much likelier its format is under a kind's
automaton than under the background.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from cohortal.llm.words import small_batches

KINDS = ("assign", "access", "hex")
#: Base patterns: fixed values of the query's contract.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SAMPLE = 2_000  # distinct formats of each kind that an automaton is learned from, lowest hashes first
MERGE_ALPHA = 0.05  # Hoeffding level of the compatibility test
MIN_VALUES = 20  # a kind with fewer labelled values has no automaton
THRESHOLD = 0.7  # mean log-likelihood gain per character, in nats, from which a candidate is a secret
BACKGROUND = "background"

# Long runs of hex digits are rare in prose: a cheap test before the exact pattern.
_LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")


def _letters(name: str, chars: str) -> dict[str, str]:
    return {c: name for c in chars}


CLASSES = (
    _letters("d", "0123456789") | _letters("h", "abcdef") | _letters("l", "ghijklmnopqrstuvwxyz")
    | _letters("H", "ABCDEF") | _letters("L", "GHIJKLMNOPQRSTUVWXYZ") | {c: c for c in "+/_.=-"}
)
_SIZE = Counter(CLASSES.values())
_TRANSLATE = str.maketrans(CLASSES)


def classes_of(value: str) -> str:
    """The value with each character replaced by its class."""
    return value.translate(_TRANSLATE)


class Automaton:
    """A deterministic automaton with counts: per state its visits, its ends and its counted transitions."""

    def __init__(self, counted: dict[str, int], alpha: float = MERGE_ALPHA):
        self.visits: list[int] = []
        self.ends: list[int] = []
        self.moves: list[dict[str, list[int]]] = []  # symbol: [count, state]
        self._add()
        for word in sorted(counted):
            n, state = counted[word], 0
            self.visits[0] += n
            for symbol in word:
                move = self.moves[state].get(symbol)
                if move is None:
                    move = self.moves[state][symbol] = [0, self._add()]
                move[0] += n
                state = move[1]
                self.visits[state] += n
            self.ends[state] += n
        self._level = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()
        self._finish()

    def _add(self) -> int:
        self.visits.append(0)
        self.ends.append(0)
        self.moves.append({})
        return len(self.visits) - 1

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        return bool(n and m) and abs(a / n - b / m) > self._level * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, one: int, two: int) -> bool:
        work = [(one, two)]
        while work:
            p, q = work.pop()
            n, m = self.visits[p], self.visits[q]
            if self._differ(self.ends[p], n, self.ends[q], m):
                return False
            for symbol in self.moves[p].keys() | self.moves[q].keys():
                a, b = self.moves[p].get(symbol), self.moves[q].get(symbol)
                if self._differ(a[0] if a else 0, n, b[0] if b else 0, m):
                    return False
                if a and b:
                    work.append((a[1], b[1]))
        return True

    def _fold(self, into: int, tree: int) -> None:
        work = [(into, tree)]
        while work:
            p, q = work.pop()
            self.visits[p] += self.visits[q]
            self.ends[p] += self.ends[q]
            for symbol, (n, target) in self.moves[q].items():
                move = self.moves[p].get(symbol)
                if move is None:
                    self.moves[p][symbol] = [n, target]
                else:
                    move[0] += n
                    work.append((move[1], target))

    def _merge(self) -> None:
        """Red states are final; each blue one (a child of a red state) joins the first compatible red state or turns red."""
        red, blue = [0], [(0, s) for s in sorted(self.moves[0])]
        while blue:
            parent, symbol = blue.pop(0)
            state = self.moves[parent][symbol][1]
            for r in red:
                if self._compatible(r, state):
                    self.moves[parent][symbol][1] = r
                    self._fold(r, state)
                    break
            else:
                red.append(state)
            blue = [(r, s) for r in red for s in sorted(self.moves[r]) if self.moves[r][s][1] not in red]
        self.red = red

    def _finish(self) -> None:
        symbols = len(_SIZE) + 1
        self._step: dict[int, dict[str, tuple[float, int]]] = {}
        self._end: dict[int, float] = {}
        self._miss: dict[int, float] = {}
        for state in self.red:
            n = self.visits[state] + 0.5 * symbols
            self._end[state] = math.log((self.ends[state] + 0.5) / n)
            self._miss[state] = math.log(0.5 / n)
            self._step[state] = {s: (math.log((c + 0.5) / n / _SIZE[s]), t) for s, (c, t) in self.moves[state].items()}

    def score(self, word: str) -> float:
        """Log-likelihood of a class string; an unseen move costs its smoothed share and starts again at the root."""
        state, total = 0, 0.0
        for symbol in word:
            step = self._step[state].get(symbol)
            if step is None:
                total += self._miss[state] - math.log(_SIZE[symbol])
                state = 0
            else:
                total += step[0]
                state = step[1]
        return total + self._end[state]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The base matches as (start, kind number, end), sorted."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(out)


def _mixed(token: str) -> bool:
    """Letters and digits: numbers, words and joined words are no secrets."""
    kinds = set(classes_of(token))
    return "d" in kinds and bool(kinds & {"h", "l", "H", "L"})


def candidates(text: str) -> Iterator[tuple[int, int, str]]:
    """Tokens that are more than letters."""
    for m in CANDIDATE.finditer(text):
        if not m[0].isalpha():
            yield m.start(), m.end(), m[0]


def value_of(text: str, start: int, kind: int, end: int) -> str:
    """The secret itself in a base span."""
    return ASSIGN.match(text, start)[2] if kind == 0 else text[start:end]


def labelled_values(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, value, n) over all texts: the values of the base spans, and the other candidates as background."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for body in batch.column(0).to_pylist():
                if not body:
                    continue
                taken = base_spans(body)
                for start, kind, end in taken:
                    counts[KINDS[kind], classes_of(value_of(body, start, kind, end))] += 1
                for start, end, token in candidates(body):
                    if not any(a < end and start < b for a, _, b in taken):
                        counts[BACKGROUND, classes_of(token)] += 1
            if counts:
                kinds, values = zip(*counts)
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(values), pa.array(list(counts.values()), pa.int64())], names=["kind", "value", "n"])

    small_batches(docs.sparkSession)
    found = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "kind string, value string, n long")
    return found.groupBy("kind", "value").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, settle, text: str = "text") -> dict[str, Automaton]:
    """One automaton per kind and the background, from at most ``SAMPLE`` distinct formats of each."""
    values = settle(labelled_values(docs, text), "secret-values")
    counted: dict[str, dict[str, int]] = {}
    for kind in (*KINDS, BACKGROUND):
        lowest = values.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(SAMPLE)
        counted[kind] = {r["value"]: r["n"] for r in lowest.select("value", "n").collect()}
    out = {k: Automaton(v) for k, v in counted.items() if k != BACKGROUND and sum(v.values()) >= MIN_VALUES}
    # Unlabelled secrets among the other tokens must not teach the background their format.
    plain = {w: n for w, n in counted[BACKGROUND].items() if all(a.score(w) < len(w) * (THRESHOLD - math.log(len(CLASSES))) for a in out.values())}
    out[BACKGROUND] = Automaton(plain or {"lhlhl": 1})
    return out


def method_spans(text: str, taken: list[tuple[int, int, str]], automata: dict[str, Automaton]) -> list[tuple[int, int, int]]:
    """Further spans: candidates outside the base spans whose format fits a kind better than the background."""
    out = []
    for start, end, token in candidates(text):
        if not _mixed(token) or any(a < end and start < b for a, _, b in taken):
            continue
        word = classes_of(token)
        plain = automata[BACKGROUND].score(word)
        best = max(((a.score(word) - plain) / len(word), -KINDS.index(k)) for k, a in automata.items() if k != BACKGROUND) if len(automata) > 1 else (0.0, 0)
        if best[0] >= THRESHOLD:
            out.append((start, -best[1], end))
    return out


SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("kind", StringType()), StructField("end", LongType()), StructField("base", LongType())]))


def find_secrets(docs: DataFrame, settle, *, text: str = "text") -> DataFrame:
    """``docs`` with ``secrets``: spans (start, kind, end, base) in code points, end exclusive, sorted by start and kind.

    ``base`` is 1 for spans of the base patterns and 0 for those the automata
    add. All rows and whole texts are scanned; a null or empty text has no
    spans. Repeated rows and null ids are kept; a column named ``secrets`` is
    replaced.
    """
    columns = [c for c in docs.columns if c != "secrets"]
    automata = docs.sparkSession.sparkContext.broadcast(learn(docs, settle, text))
    schema = StructType([*docs.select(*columns).schema.fields, StructField("secrets", SPANS)])
    place = columns.index(text)
    kind_type = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("base", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for body in batch.column(place).to_pylist():
                base = base_spans(body) if body else []
                more = method_spans(body, base, automata.value) if body else []
                both = sorted([(s, k, e, 1) for s, k, e in base] + [(s, k, e, 0) for s, k, e in more])
                found.append([{"start": s, "kind": KINDS[k], "end": e, "base": b} for s, k, e, b in both])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind_type)], names=[*batch.schema.names, "secrets"])

    small_batches(docs.sparkSession)
    return docs.select(*columns).mapInArrow(run, schema)


def digest(found: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One row per document: base counts by kind, the hash of the base spans, all spans as text."""
    base = F.filter("secrets", lambda s: s["base"] == 1)
    of = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(doc, *[of(k) for k in KINDS], F.sha2(said(base), 256).alias("base_sha256"), said(F.col("secrets")).alias("spans"))


def redact(found: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Texts with every secret span replaced by ``mark``; overlapping spans become one. ``secrets`` goes."""
    columns = [c for c in found.columns if c != "secrets"]
    place = found.columns.index(text)
    spot = found.columns.index("secrets")

    def cut(body: str, spans: list[dict]) -> str:
        parts, at = [], 0
        merged: list[list[int]] = []
        for s in spans:
            if merged and s["start"] < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], s["end"])
            else:
                merged.append([s["start"], s["end"]])
        for a, b in merged:
            parts += [body[at:a], mark]
            at = b
        return "".join([*parts, body[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place)
            spans = batch.column(spot).to_pylist()
            if any(spans):
                texts = pa.array([cut(t, s) if s else t for t, s in zip(texts.to_pylist(), spans)], texts.type)
            arrays = [texts if k == place else c for k, c in enumerate(batch.columns) if k != spot]
            yield pa.RecordBatch.from_arrays(arrays, names=[n for k, n in enumerate(batch.schema.names) if k != spot])

    return found.mapInArrow(run, found.select(*columns).schema)
