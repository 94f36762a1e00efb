import collections
import itertools
import math

import numpy as np
import pytest

from cohortal.core.settle import settle
from cohortal.llm import hmm
from tests.llm.helpers import crc, empty_table, lower, odd_rows, odd_table, prose, words


def model(states=3):
    rng = np.random.default_rng(0)
    out = hmm.Model.first(None, states)
    return hmm.Model(rng.dirichlet([1] * states), rng.dirichlet([1] * states, states), out.emit)


def paths(m, sequence):
    """Likelihood and expected counts by summing over all state paths."""
    k = len(m.start)
    total, visits, moves = 0.0, np.zeros((len(sequence), k)), np.zeros((k, k))
    for p in itertools.product(range(k), repeat=len(sequence)):
        w = m.start[p[0]] * m.emit[sequence[0], p[0]]
        for a, b, c in zip(p, p[1:], sequence[1:]):
            w *= m.move[a, b] * m.emit[c, b]
        total += w
        for t, s in enumerate(p):
            visits[t, s] += w
        for a, b in zip(p, p[1:]):
            moves[a, b] += w
    return math.log10(total), visits / total, moves / total


def test_forward_and_counts_equal_all_paths():
    m, first = model(), np.array([0, 4, 5, 11])
    classes = np.random.default_rng(1).integers(0, 50, 11).astype(np.int16)
    scores = hmm.forward(m, classes, first, np.arange(3))
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((hmm.CLASSES, 3))
    for d in range(3):
        own = classes[first[d] : first[d + 1]]
        likelihood, visits, moves = paths(m, own)
        assert scores[d] == pytest.approx(likelihood)
        if d != 1:
            start += visits[0]
            move += moves
            for c, v in zip(own, visits):
                emit[c] += v
    found = hmm.expected_counts(m, classes, first, np.array([0, 2]))
    assert np.allclose(found, np.concatenate([start, move.ravel(), emit.ravel()]))


def test_passes_never_lower_the_likelihood():
    rng = np.random.default_rng(2)
    classes = np.concatenate([rng.integers(0, 20, 300), rng.integers(20, 40, 300)]).astype(np.int16)
    first = np.arange(0, 601, 60)
    m, before = hmm.Model.first(None, 2), -np.inf
    for _ in range(6):
        now = hmm.forward(m, classes, first, np.arange(10)).sum()
        assert now >= before - 1e-6
        before, counts = now, hmm.expected_counts(m, classes, first, np.arange(10))
        start, move, emit = np.split(counts, [2, 6])
        m = hmm.Model(start / start.sum(), move.reshape(2, 2) / move.reshape(2, 2).sum(1, keepdims=True), emit.reshape(-1, 2) / emit.reshape(-1, 2).sum(0))


def brute_base(rows):
    counts, tokens = collections.Counter(), []
    for doc, text in rows:
        own = [*words(lower(text)), None]
        tokens.append((doc, own))
        if crc(doc) % 10:
            counts.update(own)
    n, v = sum(counts.values()), len(counts)
    score = lambda w: math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1)))
    return [(doc, crc(doc) % 10 == 0, len(own), sum(counts[w] > 0 for w in own), n, round(sum(map(score, own)), 4)) for doc, own in tokens]


def test_base_equals_brute_force_and_the_model_beats_it(spark):
    rows = [(k, " ".join(f"{'x' if k % 2 else 'y'}{w}" for w in prose(k, 80, 60).split())) for k in range(200)]
    out = hmm.score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), settle).collect()
    assert sorted(tuple(r)[:5] + (round(r.base_score, 4),) for r in out) == sorted(brute_base(rows))
    held = [r for r in out if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_do_not_depend_on_how_rows_are_dealt(spark):
    """Every pass reads all shards, so no shard decides where the model starts."""
    rows = [(k, prose(k, 60 if k % 3 else 20, 80)) for k in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    deals = [docs.repartition(n, "doc_id") for n in (2, 7)]
    one, other = ({r.doc_id: r.score for r in hmm.score_texts(d, settle).collect()} for d in deals)
    assert one == pytest.approx(other, rel=1e-9)


def test_classes_share_one_distribution(spark, monkeypatch):
    """Words of a class and its unknown word have probabilities that add up to one."""
    vocabulary = hmm.Vocabulary(100, 10, 5, np.zeros(0, np.uint64), np.full(hmm.CLASSES, 30.0), np.full(hmm.CLASSES, 3.0))
    shares = 10 ** vocabulary.within(np.array([10.0, 15.0, 5.0, 0.0]), np.full(4, hmm.HEAD_WORDS + 1))
    assert shares.sum() == pytest.approx(1.0)


def test_odd_rows(spark):
    out = hmm.score_texts(odd_table(spark), settle).collect()
    got = sorted(map(str, (tuple(r)[:5] + (round(r.base_score, 4),) for r in out)))
    assert got == sorted(map(str, brute_base([(r[0], r[1]) for r in odd_rows()])))
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)
    assert hmm.score_texts(empty_table(spark), settle).count() == 0
    alone = spark.createDataFrame([(k, "a b") for k in range(200) if crc(k) % 10 == 0], "doc_id long, text string")
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in hmm.score_texts(alone, settle).collect())
