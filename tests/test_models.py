import threading

import pytest
from pyspark.sql import functions as F

from cohortal.core import settle
from cohortal.models import stacking
from cohortal.models.buyer import load_classifier, train_classifier
from cohortal.models.calibration import fit_calibrator, load_calibrator
from cohortal.models.distill import load_student, load_teacher, train_student, train_teacher
from cohortal.models.revenue import OBJECTIVES, load_revenue, train_revenue
from cohortal.models.stacking import load_stacking, train_stacking
from cohortal.plans.scoring import evaluate_holdout, score_table
from cohortal.plans.training import Settings, load_run, train_run
from cohortal.sources.files import read_predictions
from cohortal.sources.views import impressions, scored, wide_impressions
from cohortal.streaming.scoring import score_arriving

COLUMNS = ["hour", "value", "k", "wifi_ratio", "release_msrp"]


@pytest.fixture(scope="module")
def imp(spark, sf_dir):
    return impressions(spark, sf_dir)


def same(a, b, column):
    joined = a.select("row_id", F.col(column).alias("a")).join(b.select("row_id", F.col(column).alias("b")), "row_id")
    return joined.where(F.abs(F.col("a") - F.col("b")) > 1e-9).count() == 0 and joined.count() > 0


def test_classifier_scores_and_reloads(spark, imp, tmp_path):
    model = train_classifier(imp, imp.where("row_id % 5 = 0"), COLUMNS, "buyer_d7", maxIter=3, maxDepth=3)
    out = model.score(imp)
    assert out.where("buyer_proba < 0 OR buyer_proba > 1").count() == 0 and set(imp.columns) < set(out.columns)
    found = {r["metric"]: r["value"] for r in model.metrics(imp, "buyer_d7").collect()}
    assert found["roc_auc"] > 0.5
    model.calibrator = fit_calibrator(model.score(imp, "p", raw=True), "p", "buyer_d7", "beta")
    model.save(str(tmp_path / "m"))
    assert same(model.score(imp), load_classifier(spark, str(tmp_path / "m")).score(imp), "buyer_proba")
    assert model.importance(spark).count() == len(COLUMNS)


def test_classifier_keeps_its_best_round(spark, imp, tmp_path):
    val = imp.where("row_id % 5 = 0")
    model = train_classifier(imp.where("row_id % 5 <> 0"), val, COLUMNS, "buyer_d7", patience=2, rounds=6, depth=3, rate=1.5, min_rows=2)
    curve = [c[0] for c in model.model.curve]
    assert model.model.best_rounds == [curve.index(min(curve)) + 1]
    out = model.score(imp)
    assert out.where("NOT buyer_proba BETWEEN 0 AND 1").count() == 0
    model.save(str(tmp_path / "m"))
    assert same(out, load_classifier(spark, str(tmp_path / "m")).score(imp), "buyer_proba")
    assert model.importance(spark).count() == len(COLUMNS)


@pytest.mark.parametrize("method", ["platt", "isotonic", "beta", "none"])
def test_calibrators(spark, sf_dir, tmp_path, method):
    df = scored(spark, sf_dir).select("row_id", "buyer_d7", "buyer_proba")
    fitted = fit_calibrator(df, "buyer_proba", "buyer_d7", method)
    out = fitted.apply(df, "buyer_proba")
    assert out.columns == df.columns and out.where("NOT buyer_proba BETWEEN 0 AND 1").count() == 0
    fitted.save(str(tmp_path / method))
    assert same(out, load_calibrator(spark, str(tmp_path / method)).apply(df, "buyer_proba"), "buyer_proba")


def test_one_class_gives_identity(spark):
    df = spark.createDataFrame([(0.2, 1), (0.9, 1)], "p double, y int")
    assert fit_calibrator(df, "p", "y", "platt").method == "none"
    with pytest.raises(ValueError):
        fit_calibrator(df, "p", "y", "other")


@pytest.mark.parametrize("objective", OBJECTIVES)
def test_revenue_objectives(spark, imp, tmp_path, objective):
    payers = imp.where("iap_revenue_d14 > 0")
    small = {"log_trees": dict(maxIter=3, maxDepth=3), "tweedie": dict(rounds=3, depth=2, rate=0.2), "huber": dict(rounds=3, depth=2)}
    params = small.get(objective, {})
    model = train_revenue(payers, None, COLUMNS, (7, 14), objective, **params)
    out = model.score(imp)
    assert out.where("pred_d7 < 0 OR pred_d7 > pred_d14 OR isnan(pred_d7)").count() == 0
    model.save(str(tmp_path / objective))
    assert same(out, load_revenue(spark, str(tmp_path / objective)).score(imp), "pred_d14")


def test_stacking(spark, sf_dir, tmp_path):
    df = scored(spark, sf_dir)
    model = train_stacking(df, ["buyer_proba", "pred_d7"], folds=2, rounds=2, depth=2)
    out = model.score(df)
    assert out.where("stacked < 0").count() == 0 and set(out.columns) == {*df.columns, "stacked"}
    model.save(str(tmp_path / "s"))
    assert same(out, load_stacking(spark, str(tmp_path / "s")).score(df), "stacked")


def test_stacking_fits_bases_side_by_side(spark, sf_dir, monkeypatch):
    """Every base fit begins together with another one, and scores are those of fits one after the other."""
    df = settle(scored(spark, sf_dir))
    size = dict(folds=3, rounds=2, depth=2)
    monkeypatch.setattr(stacking, "AT_ONCE", 1, raising=False)
    alone = train_stacking(df, ["buyer_proba", "pred_d7"], **size).score(df)
    monkeypatch.undo()
    both, inner = threading.Barrier(2), stacking.base_estimators

    class Meeting:
        def __init__(self, estimator):
            self.estimator = estimator

        def fit(self, data):
            both.wait(60)
            return self.estimator.fit(data)

    monkeypatch.setattr(stacking, "base_estimators", lambda *a: {n: Meeting(e) for n, e in inner(*a).items()})
    assert same(alone, train_stacking(df, ["buyer_proba", "pred_d7"], **size).score(df), "stacked")


@pytest.fixture(scope="module")
def run(spark, sf_dir):
    raw = settle(wide_impressions(spark, sf_dir))
    settings = Settings(reference="2024-01-31", rounds=2, depth=2, folds=2, oof_folds=2, horizons=(7, 14))
    return train_run(raw.where("datetime < '2024-01-22-00-00'"), settings), raw.where("datetime >= '2024-01-22-00-00'")


def test_run_scores_any_batch_alike(spark, run, tmp_path):
    model, late = run
    whole = settle(model.score(late))
    assert whole.columns == ["row_id", "iap_revenue_d7"] and whole.count() == late.count()
    assert whole.where("iap_revenue_d7 < 0 OR iap_revenue_d7 IS NULL").count() == 0
    part = model.score(late.where("row_id % 3 = 0"))
    assert same(whole, part, "iap_revenue_d7")
    model.save(str(tmp_path / "run"))
    assert same(whole, load_run(spark, str(tmp_path / "run")).score(late), "iap_revenue_d7")


def test_labels_do_not_change_the_score(run):
    model, late = run
    bare = late.drop(*[c for c in late.columns if c.startswith(("iap_revenue_d", "buyer_d"))])
    assert same(model.score(late), model.score(bare), "iap_revenue_d7")


def test_scoring_plan_has_no_shuffle(run):
    model, late = run
    plan = model.score(late)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


def test_score_table_and_holdout(spark, run, tmp_path):
    model, late = run
    score_table(model, late, str(tmp_path / "out"), rows=50)
    assert read_predictions(spark, str(tmp_path / "out")).count() == 50
    metrics, diagnostics = evaluate_holdout(model, late, sample_frac=0.5)
    assert metrics.first()["rmsle"] >= 0 and 0 < diagnostics.first()["rows"] < late.count()


def test_stream_scores_like_the_batch(spark, run, tmp_path):
    model, late = run
    rows = late.where("row_id % 2 = 0")
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    rows.repartition(3).write.parquet(source)
    query = score_arriving(spark, model, source, rows.schema, sink, str(tmp_path / "cp"), files_per_batch=1)
    query.awaitTermination(240)
    assert query.exception() is None
    assert same(model.score(rows), read_predictions(spark, sink, "row_id bigint, iap_revenue_d7 double"), "iap_revenue_d7")


def test_wide_categories_and_reload(spark, tmp_path):
    """2,000 values of a category are encoded each by its own labels; a saved pair scores like the fitted one."""
    rows = [(i, float(i % 7), f"device{i % 2000}", float(i % 5 == 0), float(i % 3), 0.2, 1.0) for i in range(4000)]
    df = spark.createDataFrame(rows, "row_id long, x double, device string, buyer_d7 double, iap_revenue_d7_log double, p_teacher_buy double, rev_teacher_expected double")
    plain = df.drop("p_teacher_buy", "rev_teacher_expected")
    teacher = train_teacher(plain, plain.where("buyer_d7 = 1"), ["x"], ["device"], rounds=1, depth=2)
    student = train_student(df, ["x"], ["device"], rounds=1, depth=2)
    assert teacher.classifier.encoder.tables["device"].count() == 2000
    teacher.save(str(tmp_path / "t"))
    student.save(str(tmp_path / "s"))
    again = load_teacher(spark, str(tmp_path / "t"))
    assert same(teacher.score(plain), again.score(plain), "rev_teacher_expected")
    assert same(student.score(df), load_student(spark, str(tmp_path / "s")).score(df), "rev_student")
