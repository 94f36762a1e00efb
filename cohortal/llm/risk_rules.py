"""Quality rules whose cut-offs are chosen under a controlled risk of rejecting good documents.

Each rule rejects documents in which one ratio exceeds a cut-off. The rules are
tightened together along one path of steps that is fixed before any label is
seen. Labelled good documents are the holdout: a step is certified for a stratum
if the exact binomial (Clopper-Pearson) upper bound of the share of good
documents that any rule rejects there is at most ``risk``. Steps are tested from
the loosest to the strictest and testing stops at the first failure (fixed
sequence), and the error level is divided by the strata that are tested
(Bonferroni), so that all bounds hold together with probability 1 - ``delta``.
Strata whose good documents are too few for any certificate are not tested and
have no cut-offs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from cohortal.llm.stats import with_counts

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COUNTED = (*BASE, "n_lines", "n_marks", "n_distinct_words", "n_same_as_before", "n_upper", "n_letters")
RISK = 0.02  # share of good documents that all rules together may reject, per stratum
DELTA = 0.05  # chance that any certified bound does not hold
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

STEPS = 16

# Ratio with its loosest and strictest cut-off; the steps between are geometric.
RULES: dict[str, tuple[tuple[str, str], float, float]] = {
    "symbols": (("n_symbols", "n_words"), 5.0, 0.05),
    "dup_lines": (("n_dup_lines", "n_lines"), 0.95, 0.1),
    "marks": (("n_marks", "n_words"), 5.0, 0.4),
    "repeated_words": (("n_repeat_words", "n_words"), 0.95, 0.2),
    "stutter": (("n_same_as_before", "n_words"), 0.95, 0.05),
}


def cut(rule: str, step: int) -> float:
    _, loose, strict = RULES[rule]
    return loose * (strict / loose) ** (step / (STEPS - 1))


def ratio(rule: str) -> Column:
    above, below = RULES[rule][0]
    return F.coalesce(F.col(above) / F.nullif(F.col(below), F.lit(0)), F.lit(0.0))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p), summed exactly in logarithms."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def certified(rejected: list[int], n: int, risk: float, level: float) -> int:
    """How many steps, from the loosest, have an upper bound of at most ``risk``."""
    for place, k in enumerate(rejected):
        if n == 0 or k > n * risk or binomial_tail(k, n, risk) > level:
            return place
    return len(rejected)


def fewest_good(risk: float, level: float) -> int:
    """How many good documents a certificate needs if none of them is rejected."""
    return math.ceil(math.log(level) / math.log1p(-risk))


def fails(step: int) -> Column:
    """Whether any rule rejects a document at a step."""
    out = F.lit(False)
    for rule in RULES:
        out = out | (ratio(rule) > cut(rule, step))
    return out


@dataclass
class Cutoffs:
    """Per stratum the chosen step; strata without one reject nothing."""

    chosen: dict[str, int]

    def stratum(self, column: Column) -> Column:
        return F.coalesce(column.cast("string"), F.lit(""))

    def rejects(self, stratum: Column) -> Column:
        out = F.lit(False)
        for step in sorted(set(self.chosen.values())):
            out = out | (stratum.isin([s for s, own in self.chosen.items() if own == step]) & fails(step))
        return out


def learn_cutoffs(counts: DataFrame, labels: DataFrame, *, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> Cutoffs:
    """Cut-offs from documents with a label.

    ``labels`` has doc_id and quality; documents with several different labels,
    and null labels or ids, are left out. Only strata with enough good documents
    reach the driver, one narrow row each. Which strata are tested depends on
    how many labels they have, never on what is rejected there. Among certified
    steps the loosest that rejects at least 99 % of the bad documents that the
    strictest rejects is taken (of equal ones the loosest).
    """
    clear = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("_good"), F.max("quality").alias("_top"))
        .where("_good = _top")
        .select(F.col("doc_id").alias("_doc"), "_good")
    )
    named = counts.withColumn("_stratum", Cutoffs({}).stratum(F.col(stratum)))
    held = named.join(clear, named["doc_id"] == clear["_doc"])
    hit = {step: fails(step) for step in range(STEPS)}
    sums = [F.count_if(hit[step] & (F.col("_good") == good)).alias(f"{name}_{step}") for step in range(STEPS) for name, good in (("good", 1), ("bad", 0))]
    table = held.groupBy("_stratum").agg(F.count_if(F.col("_good") == 1).alias("n_good"), *sums)
    rows = table.where(F.col("n_good") >= fewest_good(risk, delta)).collect()
    # The more strata are tested, the more good documents each of them needs.
    rows.sort(key=lambda r: (-r["n_good"], r["_stratum"]))
    while rows and rows[-1]["n_good"] < fewest_good(risk, delta / len(rows)):
        rows.pop()
    chosen = {}
    for r in rows:
        passed = certified([r[f"good_{p}"] for p in range(STEPS)], r["n_good"], risk, delta / len(rows))
        caught = [r[f"bad_{p}"] for p in range(passed)]
        if passed and caught[-1] > 0:
            chosen[r["_stratum"]] = next(p for p in range(passed) if caught[p] >= 0.99 * caught[-1])
    return Cutoffs(chosen)


def judge(counts: DataFrame, cutoffs: Cutoffs, stratum: str = "lang") -> DataFrame:
    """Adds base_failed and kept to a table of counts."""
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counts.withColumn("base_failed", base_failed).withColumn(
        "kept", ~F.col("base_failed") & ~cutoffs.rejects(cutoffs.stratum(F.col(stratum)))
    )


def quality_verdicts(docs: DataFrame, labels: DataFrame, settle, *, stratum: str = "lang") -> DataFrame:
    """One row per document: doc_id, the five base counts, base_failed, kept.

    Whole texts are counted once, in one pass that is written down by
    ``settle``. A null or empty text has no words and fails the base rule.
    Repeated rows and null ids are judged row by row. Without labels no rule
    has a cut-off and only the base rule rejects. A ratio equal to its cut-off is kept.
    """
    counts = settle(with_counts(docs, ["doc_id", stratum], COUNTED), "rule-counts")
    cutoffs = learn_cutoffs(counts, labels, stratum=stratum)
    return judge(counts, cutoffs, stratum).select("doc_id", *BASE, "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, settle, *, stratum: str = "lang", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    inner = plain.withColumns({"doc_id": F.col(names[docs.columns.index("doc_id")]), "_lang": F.col(names[docs.columns.index(stratum)])})
    counts = settle(with_counts(inner, ["doc_id", "_lang"], COUNTED, names[docs.columns.index(text)]), "rule-counts")
    cutoffs = learn_cutoffs(counts, labels, stratum="_lang")
    judged = judge(with_counts(inner, [*names, "_lang"], COUNTED, names[docs.columns.index(text)]), cutoffs, "_lang")
    return judged.where("kept").select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
