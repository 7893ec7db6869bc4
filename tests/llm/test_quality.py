import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL

from awkward import none, odd  # noqa: F401
from docquarry.llm import quality as q


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL.replace('0.001', '0.1')}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL.replace('0.001', '0.1')}/labels.parquet")
    held = q.quality_scores(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    assert len(held) > 500
    assert np.mean([r.predicted == r.quality for r in held]) > 0.99
    good, bad = ([r.score for r in held if r.quality == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.995


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 1), (7, None), (None, 1)], "doc_id long, quality int")
    for some in (labels, labels.limit(0)):
        rows = q.quality_scores(odd, some).collect()
        assert len(rows) == odd.count()
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert q.quality_scores(none, labels).count() == 0


def risk_of(w, pos, every, prior):
    """The stated risk on the data itself, with the ridge that the fit adds."""
    ridge = q.RIDGE * (w[1:] @ w[1:]) / 4 + 1e-9 * w[0] ** 2 / 4
    negative = (((1 + every @ w) ** 2).mean() - prior * ((1 + pos @ w) ** 2).mean()) / 4
    return prior * ((1 - pos @ w) ** 2).mean() / 4 + max(0, negative) + ridge


@pytest.mark.parametrize("seed, prior, gap", [(0, 0.95, 0.1), (1, 0.9, 0.0), (2, 0.5, 2.0), (3, 0.99, -0.5)])
def test_least_risk(seed, prior, gap):
    """No descent from any start gets lower, whether or not the negative part is below 0."""
    pick = np.random.default_rng(seed)
    pos = np.column_stack([np.ones(50), pick.normal(2, 1, (50, 8))])
    every = np.column_stack([np.ones(60), pick.normal(2 - gap, 1, (60, 8))])
    p, u = pos.T @ pos / 50, every.T @ every / 60
    found = risk_of(q.fit(p, u, prior), pos, every, prior)
    best = np.inf
    for start in range(4):
        w, step = pick.normal(0, start, 9), 0.5 / np.linalg.eigvalsh(u + p).max()
        for n in range(40_000):
            below = ((1 + every @ w) ** 2).mean() < prior * ((1 + pos @ w) ** 2).mean()
            slope = prior * (p @ w - p[:, 0]) if below else u @ w + u[:, 0] - 2 * prior * p[:, 0]
            w = w - step / (1 + n / 200) ** 0.5 * slope / 2
            if n % 50 == 0:
                best = min(best, risk_of(w, pos, every, prior))
    assert found <= best * 1.001 + 1e-9


def test_measures_of_nothing():
    assert (q.measure(pa.array(["", " \n", None], pa.string()).fill_null("")) == 0).all()
    m = q.measure(pa.array(["LOUD!! WORDS!!", "a a a a"]))
    at = dict(zip(q.MEASURES, m.T))
    assert at["caps_words"].tolist() == [1, 0] and at["next_alike"].tolist() == [0, 0.75]
