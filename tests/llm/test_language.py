import numpy as np
import pyarrow as pa
import pytest

from cohortal.core.settle import settle
from cohortal.llm import kernels
from cohortal.llm.words import pieces
from tests.llm.helpers import crc, empty_table, odd_rows, odd_table


def grams(text):
    folded = " ".join("".join(c.lower() if c.isascii() and c.isalpha() or ord(c) > 127 else " " for c in text).split(" "))
    raw, out = folded.encode(), []
    for b in raw:
        if not (b == 32 and out and out[-1] == 32):
            out.append(b)
    raw = bytes(out)
    return {raw[i : i + n] for n in (1, 2, 3) for i in range(len(raw) - n + 1)}


@pytest.mark.parametrize("limit", [20, 4000])
def test_kernel_equals_brute_force(limit):
    texts = ["The cat, the HAT", "été à la plage", "", "x", "12  34", "the  the", "über alles die Straße", "Ä"]
    marks = ["the cat sat", "la plage été", "die straße"]
    kernel = kernels.Kernel.of([m.encode() for m in marks])
    for piece in pieces(pa.array([t.encode() for t in texts], pa.binary()), limit):
        found = kernel.values(piece)
        for k in range(piece.n):
            own = grams(texts[piece.first + k])
            for j, mark in enumerate(marks):
                other = grams(mark)
                assert found[k, j] == pytest.approx(len(own & other) / (max(1, len(own)) ** 0.5 * len(other) ** 0.5), abs=1e-5)


def test_all_landmarks_give_plain_kernel_ridge_regression():
    """With every training text a landmark, the Nyström form equals the exact solution."""
    rng = np.random.default_rng(1)
    a = rng.normal(size=(12, 30))
    kernel = a @ a.T
    labels = np.array([0, 1, 2] * 4)
    found = kernel @ kernels.fit(kernel, kernel, labels, 3, ridge=0.1)[:-1] + kernels.fit(kernel, kernel, labels, 3, ridge=0.1)[-1]
    targets = np.where(labels[:, None] == np.arange(3), 1.0, -1.0)
    center = np.eye(12) - np.ones((12, 12)) / 12
    alpha = np.linalg.solve(center @ kernel @ center + 1.2 * np.eye(12), center @ targets)
    exact = center @ kernel @ center @ alpha + targets.mean(axis=0)
    assert np.allclose(found, exact, atol=1e-3)


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    out = [r for r in kernels.identify_languages(docs, settle).collect() if r.held_out]
    assert out and np.mean([r.lang_pred == truth[r.doc_id] for r in out]) > 0.95


def test_odd_rows(spark):
    out = kernels.identify_languages(odd_table(spark), settle).collect()
    assert len(out) == len(odd_rows())
    for r in out:
        assert r.held_out == (crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1
        if r.doc_id in (2, 3, 4, 9):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert kernels.identify_languages(empty_table(spark), settle).count() == 0
    nothing = odd_table(spark).selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r.lang_pred for r in kernels.identify_languages(nothing, settle).collect()} == {"und"}


def test_seventy_languages_and_a_hot_text(spark):
    """No label is left out, and copies of one text do not push the others out of its language's sample."""
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for k in range(70):
        letters = rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6, replace=False)
        stems = ["".join(rng.choice(letters, 5)) for _ in range(12)]
        for _ in range(12):
            rows.append((n, " ".join(rng.choice(stems, 30)), f"l{k:02d}"))
            n += 1
    rows += [(n + i, "hot hot hot text", "l00") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in kernels.identify_languages(docs.repartition(4), settle).collect()}
    held = [r for r in rows[:n] if out[r[0]].held_out]
    assert {out[r[0]].lang_pred for r in rows} == {f"l{k:02d}" for k in range(70)}
    assert np.mean([out[r[0]].lang_pred == r[2] for r in held]) > 0.9


def test_sizes_stay_bounded():
    assert kernels.sample_sizes(4) == (kernels.LANDMARKS, kernels.TRAINING)
    for n in (1, 32, 70, 200, 700):
        marks, texts = kernels.sample_sizes(n)
        assert marks * n <= kernels.ALL_LANDMARKS and marks * n * texts * n <= kernels.ALL_VALUES


def test_equal_scores_take_the_first_language(spark):
    rows = [(i, "same words here", "b" if i % 2 else "a") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len({(r.lang_pred, r.score) for r in kernels.identify_languages(docs, settle).collect()}) == 1
