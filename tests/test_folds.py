"""Fits of all folds and labels in common passes against one MLlib fit each."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaystone.operators import folds as fo
from quaystone.operators import learning as le
from quaystone.operators import models as ml
from quaystone.plans import registry

NAMES, LABELS = ("a", "b", "c", "d"), ("label_up", "label_drawdown", "label_one")


@pytest.fixture(scope="module")
def planted(spark):
    """``c`` varies only late, ``d`` never; ``label_one`` has one class."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 3)) * [1, 5, 2] + [0, 10, -3]
    up = rng.random(4000) < 1 / (1 + np.exp(-(2.5 * x[:, 0] - 0.2 * (x[:, 1] - 10))))
    dd = rng.random(4000) < 1 / (1 + np.exp(-(-3 - x[:, 0])))
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=k // 4), float(x[k, 0]), float(x[k, 1]), float(x[k, 2]) if k > 1500 else 0.1, 7.0, float(up[k]), float(dd[k]), 1.0) for k in range(4000)]
    return spark.createDataFrame(rows, "date date, a double, b double, c double, d double, label_up double, label_drawdown double, label_one double").cache()


def test_common_passes_equal_single_fits(planted):
    got = le.walk_forward_counts(planted, LABELS, features=NAMES, gap_days=30).toPandas()
    for label in LABELS:
        want = le.walk_forward(planted, label, features=NAMES, gap_days=30).toPandas()
        mine = got[got.label == label]
        for fold, w in want.groupby("fold"):
            g = mine[mine.fold == fold].sort_values("p")
            assert (g.n.sum(), g.pos.sum()) == (len(w), w.y.sum())
            np.testing.assert_allclose(np.repeat(g.p, g.n), np.sort(w.p), atol=2e-4)


def test_stored_panel_gives_the_same(planted, tmp_path):
    planted.repartition(3).write.parquet(f"{tmp_path}/p")
    fit = lambda df, **how: {tuple(r) for r in le.walk_forward_counts(df, LABELS, features=NAMES, gap_days=30, **how).collect()}
    stored = planted.sparkSession.read.parquet(f"{tmp_path}/p")
    assert fit(stored, stored=True) == fit(stored)


def test_start_does_not_decide(planted, monkeypatch):
    fit = lambda: fo.FoldModels(planted, list(NAMES), list(LABELS), fo.fold_cuts(planted), 30).coefficients
    want = fit()
    monkeypatch.setattr(fo, "START_ROWS", 400)
    got = fit()
    assert set(got) == set(want) == {(i, k) for i in (0, 1) for k in range(5)}
    for key, b in want.items():
        np.testing.assert_allclose(got[key], b, atol=1e-5)


def test_metrics_from_counts(planted):
    counts = le.walk_forward_counts(planted, LABELS[:2], features=NAMES)
    pred = counts.select("label", "fold", "p", F.explode(F.expr("transform(sequence(1, cast(n as int)), i -> int(i <= pos))")).alias("y"))
    keys = ["label", "fold"]
    for one, other in ((ml.evaluate_counts(counts, keys), ml.evaluate(pred, keys)), (ml.calibration_error_counts(counts, keys), ml.calibration_error(pred, keys))):
        a, b = (x.toPandas().set_index(keys).sort_index() for x in (one, other))
        assert len(a) == 10
        np.testing.assert_allclose(a[list(b.columns)].astype(float), b.astype(float), rtol=1e-9)


def test_walk_forward_metrics_fit_no_fold_alone(spark, monkeypatch):
    def alone(*args):
        raise AssertionError("a fit of one fold")

    monkeypatch.setattr(le, "probability_model", alone)
    got = registry.QUERIES["walk_forward_metrics"](spark, "/root/testdata/sf0.001").toPandas()
    assert set(got.label) == set(le.TARGETS) and got.n.min() > 0
