"""The registered model scores against a direct solution of the same problem."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from courierworks.catalog import REPORTS, model_reports
from courierworks.plans import training
from courierworks.session import stage


def solved(x, y, weight, c):
    """Coefficients of the standardised, L2-penalised, weighted logistic regression by Newton's method."""
    n = len(x)
    mean, std = x.mean(0), x.std(0, ddof=1)
    std[std < 1e-9] = np.inf  # a constant column has no say
    z = np.column_stack([np.ones(n), (x - mean) / std])
    total = weight.sum()
    penalty = np.eye(z.shape[1]) / (c * total)
    penalty[0, 0] = 0
    beta = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ beta))
        slope = z.T @ (weight * (p - y)) / total + penalty @ beta
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z / total + penalty
        step = np.linalg.lstsq(curve, slope, rcond=None)[0]
        beta -= step
        if np.abs(step).max() < 1e-12:
            break
    return lambda rows: 1 / (1 + np.exp(-np.column_stack([np.ones(len(rows)), (rows - mean) / std]) @ beta))


def arrays(df):
    pdf = df.select("offer_id", "label", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in training.FEATURES],
                    *(["weight"] if "weight" in df.columns else [])).toPandas()
    return pdf["offer_id"].tolist(), pdf[training.FEATURES].to_numpy(float), pdf["label"].to_numpy(float), pdf["weight"].to_numpy(float) if "weight" in pdf else None


def test_scores_of_the_newer_offers(views):
    rows = stage(model_reports.frame(views))
    _, metrics = training.train_model(rows)
    train, test = training.temporal_split(rows)
    _, x, y, weight = arrays(training.with_weights(train)[0])
    model = solved(x, y, weight, metrics["best_logreg_c"])
    ids, x, y, _ = arrays(test)
    want = dict(zip(ids, model(x)))
    got = REPORTS["model_scores"](views).collect()
    assert {r.offer_id for r in got} == set(want) and {r.offer_id: r.label for r in got} == dict(zip(ids, y))
    assert max(abs(r.p - want[r.offer_id]) for r in got) < 2e-3


def test_scores_of_all_offers_and_importance(views):
    weighted, _ = training.with_weights(model_reports.frame(views))
    _, x, y, weight = arrays(weighted)
    model = solved(x, y, weight, 0.75)
    scored = {r.offer_id: r for r in REPORTS["model_offers"](views).collect()}
    assert len(scored) == views.offers.count() and {r.model_used for r in scored.values()} == {"ml"}
    from courierworks.functions.scoring import add_features

    features = add_features(model_reports.inputs(views)).select("offer_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in training.FEATURES]).toPandas()
    for offer_id, p in zip(features["offer_id"], model(features[training.FEATURES].to_numpy(float))):
        assert scored[offer_id].accept_score == pytest.approx(min(0.99, max(0.01, p)), abs=1e-2)
    names = [r[0] for r in REPORTS["model_importance"](views).collect()]
    assert sorted(names) == sorted(training.FEATURES)
