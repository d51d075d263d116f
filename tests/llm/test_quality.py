"""The quality classifier minimises the published risk."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tiepoint.llm import quality, words


def risk(w, b, p, u, prior):
    """Non-negative risk with the logistic loss, written out."""
    loss = lambda z: np.log1p(np.exp(-z))
    positive, negative = loss(p @ w + b).mean(), loss(-(u @ w + b)).mean() - prior * loss(-(p @ w + b)).mean()
    return prior * positive + max(0.0, negative), negative


def test_the_fit_lowers_the_written_out_risk():
    rnd = np.random.default_rng(3)
    truth = rnd.normal(size=quality.FEATURES) * (rnd.random(quality.FEATURES) < 0.1)
    x = rnd.normal(size=(1500, quality.FEATURES)).astype(np.float32)
    good = x @ truth + rnd.normal(size=1500) > 0
    p, u = x[:700][good[:700]], x[700:]
    model = quality.fit(p, u)
    ps, us = ((v - model.mean) / model.scale for v in (p, u))
    got, negative = risk(model.weights, model.bias, ps, us, model.prior)
    assert got < 0.6 * risk(np.zeros(quality.FEATURES), 0.0, ps, us, model.prior)[0]
    for _ in range(20):  # no step nearby does much better
        other, _ = risk(model.weights + rnd.normal(size=quality.FEATURES) * 0.02, model.bias, ps, us, model.prior)
        assert other > got - 0.01
    assert abs(model.prior - good[700:].mean()) < 0.15


def test_scoring_holds_the_features_of_one_piece():
    """Memory follows the piece, not the batch; scores are those of each text by itself."""
    rnd = np.random.default_rng(5)
    texts = pa.array([" ".join(rnd.choice(["Ab", "cd,", "12", "\n", "é"], 900)) for _ in range(3_000)] + [None, ""])
    model = quality.Model(np.zeros(quality.FEATURES), np.ones(quality.FEATURES), rnd.normal(size=quality.FEATURES), 0.1, 0.5)
    alone = [quality.scores_of(texts.slice(k, 1), model)[0].as_py() for k in (0, 1_500, 3_000, 3_001)]
    assert texts.nbytes > 8_000_000
    tracemalloc.start()
    got = quality.scores_of(texts, model)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose([got[k].as_py() for k in (0, 1_500, 3_000, 3_001)], alone) and len(got) == 3_002
    assert most < 100 * words.PIECE


def test_only_texts_travel_to_python(spark):
    rows = spark.createDataFrame([(1, "a b", "en"), (2, None, None), (None, "", "de")], "doc_id long, text string, lang string")
    model = quality.Model(np.zeros(quality.FEATURES), np.ones(quality.FEATURES), np.zeros(quality.FEATURES), 1.0, 0.5)
    scored = quality.score(rows, model, *rows.columns)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "ArrowEvalPython" in plan
    assert sorted((r.doc_id or 0, r.text, round(r._q_score, 6)) for r in scored.collect()) == [(0, "", 0.731059), (1, "a b", 0.731059), (2, None, 0.731059)]
