import collections
import random
import re

import pyarrow as pa
import pytest

from cohortal.core.settle import settle
from cohortal.llm import risk_rules, stats
from cohortal.llm.words import pieces
from tests.llm.helpers import empty_table, odd_rows, odd_table, prose, words


def base(text):
    w = words(text)
    seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines, again = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            again += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered)


@pytest.mark.parametrize("limit", [50, 5000])
def test_counts_equal_brute_force(limit):
    rng = random.Random(6)
    parts = ["a", "bé", "#", "| ", "X! ", " ", "\n", "\x0b", "a a a ", "\nfoo bar\n", "\x85", "　"]
    docs = ["".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 5, 40, 200]))) for _ in range(150)]
    for piece in pieces(pa.array([d.encode() for d in docs], pa.binary()), limit):
        found = stats.piece_counts(piece)
        for k in range(piece.n):
            assert tuple(int(found[n][k]) for n in risk_rules.BASE) == base(docs[piece.first + k])


def test_binomial_tail_is_exact():
    from math import comb

    for k, n, p in ((0, 10, 0.2), (3, 40, 0.1), (7, 7, 0.5)):
        assert risk_rules.binomial_tail(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
    assert risk_rules.certified([0, 0, 1, 90, 0], 2000, 0.01, 0.001) == 3
    assert risk_rules.certified([0, 0], 50, 0.01, 0.001) == 0


def test_cutoffs_keep_the_risk_and_catch_the_bad(spark):
    rows, labels = [], []
    for i in range(6000):
        bad = i % 6 == 0
        text = " ".join(w + ("###" if bad else "") for w in prose(i % 500, 60).split())
        rows.append((i, text, "en"))
        if i % 2 == 0:
            labels.append((i, 0 if bad else 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = spark.createDataFrame([*labels, (1, 0), (1, 1), (None, 1), (3, None)], "doc_id long, quality int")
    out = {r.doc_id: r for r in risk_rules.quality_verdicts(docs, known, settle).collect()}
    assert all(out[i].kept == (i % 6 != 0) for i in range(6000))
    assert not any(r.base_failed for r in out.values())


def test_cutoffs_equal_brute_force(spark):
    """Every stratum's step from its labelled rows, tested one by one; strata with few good labels have none."""
    rng = random.Random(8)
    kinds = {"aa": 900, "bb": 400, "cc": 90, None: 300}
    counts, labels = [], []
    for lang, n in kinds.items():
        for i in range(n):
            good = int(rng.random() < 0.85)
            symbols = rng.choice([0, 0, 0, 1, 2]) if good else rng.choice([0, 40, 90, 300])
            doc = len(counts)
            counts.append((doc, lang, 100, 500, symbols, 0, int(rng.random() < 0.3), 10, 5, 90, 0, 1, 400))
            labels.append((doc, good))
    table = spark.createDataFrame(counts, "doc_id long, lang string, " + ", ".join(f"{c} long" for c in risk_rules.COUNTED))
    found = risk_rules.learn_cutoffs(table, spark.createDataFrame(labels, "doc_id long, quality int")).chosen
    good = {lang: [r for r, (_, q) in zip(counts, labels) if q and r[1] == lang] for lang in kinds}
    bad = {lang: [r for r, (_, q) in zip(counts, labels) if not q and r[1] == lang] for lang in kinds}
    at = {c: 2 + i for i, c in enumerate(risk_rules.COUNTED)}

    def rejected(rows, step):
        return sum(any(r[at[x]] / r[at[y]] > risk_rules.cut(name, step) for name, ((x, y), _, _) in risk_rules.RULES.items()) for r in rows)

    tested = [lang for lang in kinds if len(good[lang]) >= 217]  # 0.98 ** 217 is the first below 0.05 / 4
    level = 0.05 / len(tested)
    want = {}
    for lang in tested:
        passed = 0
        while passed < risk_rules.STEPS and risk_rules.binomial_tail(rejected(good[lang], passed), len(good[lang]), 0.02) <= level:
            passed += 1
        top = rejected(bad[lang], passed - 1)
        want[lang or ""] = min(p for p in range(passed) if rejected(bad[lang], p) >= 0.99 * top)
    assert found == want and set(found) == {"aa", "bb", ""}


def test_forty_strata_and_one_without_labels(spark):
    """No stratum is folded into another, and one without labels rejects nothing."""
    langs = [f"l{k:02d}" for k in range(41)]
    rows = [(k * 600 + i, lang, 100, 500, 80 if i % 3 == 0 else 0, 0, 0, 10, 5, 90, 0, 1, 400) for k, lang in enumerate(langs) for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, lang string, " + ", ".join(f"{c} long" for c in risk_rules.COUNTED))
    labels = spark.createDataFrame([(r[0], 0 if r[4] else 1) for r in rows if r[1] != "l40"], "doc_id long, quality int")
    judged = risk_rules.judge(table, risk_rules.learn_cutoffs(table, labels))
    lost = {r.lang: r["count"] for r in judged.where("not kept").groupBy("lang").count().collect()}
    assert lost == {lang: 200 for lang in langs[:40]}


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    out = risk_rules.quality_verdicts(odd_table(spark), labels, settle).collect()
    assert sorted(map(str, [tuple(r)[1:6] for r in out])) == sorted(str(base(r[1])) for r in odd_rows())
    for r in out:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    kept = risk_rules.keep_good(odd_table(spark), labels, settle)
    assert kept.columns == odd_table(spark).columns and [r.doc_id for r in kept.collect()] == [7]
    assert risk_rules.quality_verdicts(empty_table(spark), labels.limit(0), settle).count() == 0
