import numpy as np

from cohortal.core.settle import settle
from cohortal.llm import gam
from tests.llm.helpers import crc, empty_table, odd_rows, odd_table, prose


def test_tables_learn_steps_and_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = gam.fit(x[:3000], y[:3000], np.ones(3000))
    right = (model.score(x[3000:]) > 0.5) == (y[3000:] > 0.5)
    assert right.mean() > 0.9 and (0, 1) in {(a, b) for a, b, _ in model.pairs}
    step = (x[:, 2] > 0.3).astype(float)
    assert (((gam.fit(x[:3000], step[:3000], np.ones(3000)).score(x[3000:]) > 0.5) == (step[3000:] > 0.5)).mean()) > 0.97


def test_shallow_tree_is_the_best_single_cut():
    rng = np.random.default_rng(2)
    g, h = rng.normal(size=12), rng.uniform(0.5, 1, 12)
    gains = [g[:k].sum() ** 2 / (h[:k].sum() + 1) + g[k:].sum() ** 2 / (h[k:].sum() + 1) for k in range(1, 12)]
    k = int(np.argmax(gains)) + 1
    assert np.allclose(gam._tree(g, h, 2), np.where(np.arange(12) < k, g[:k].sum() / (h[:k].sum() + 1), g[k:].sum() / (h[k:].sum() + 1)))


def test_held_out_accuracy(spark):
    rows, labels = [], []
    for k in range(800):
        bad = k % 4 == 0
        text = prose(k, 40 + k % 60)
        rows.append((k, " ".join(w.upper() + "!!" for w in text.split()) if bad and k % 8 else (text.replace(" ", " | ") if bad else text)))
        labels.append((k, int(not bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([*labels, (5, 0), (None, 1), (6, None)], "doc_id long, quality int")
    out = gam.score_quality(docs, known, settle).collect()
    assert len(out) == 800 and all(r.held_out == (crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    held = [r for r in out if r.held_out]
    assert held and np.mean([r.predicted == int(r.doc_id % 4 != 0) for r in held]) > 0.97


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    out = gam.score_quality(odd_table(spark), labels, settle).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r[0]) for r in odd_rows()) and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in gam.score_quality(odd_table(spark), labels.limit(0), settle).collect()} == {0.5}
    assert gam.score_quality(empty_table(spark), labels, settle).count() == 0
