"""The ordinal model against a plain optimiser of its likelihood, and the stage with labels against plain scoring."""

import math
import random

import numpy as np

import corpus_pipeline
from lectern.llm import quality


def objective(weights, thresholds, rows, grades):
    """Penalised log-likelihood, row by row."""
    cdf = lambda z: 1 / (1 + math.exp(-z))
    total = -quality.SHRINK / 2 * float(np.sum(weights**2))
    for buckets, g in zip(rows, grades, strict=True):
        s = sum(weights[b] for b in buckets)
        high = cdf(thresholds[g] - s) if g < len(thresholds) else 1.0
        low = cdf(thresholds[g - 1] - s) if g else 0.0
        total += math.log(max(high - low, 1e-12))
    return total


def plain_fit(rows, grades, n):
    """Coordinate ascent with shrinking steps on weights and thresholds; slow and simple."""
    x, cuts = np.zeros(n), [-0.5, 0.5]
    best, step = objective(x, cuts, rows, grades), 0.8
    while step > 0.004:
        moved = False
        for k in range(n + 2):
            for by in (step, -step):
                y, c = x.copy(), list(cuts)
                if k < n:
                    y[k] += by
                else:
                    c[k - n] += by
                if c[0] < c[1] and (now := objective(y, c, rows, grades)) > best + 1e-9:
                    x, cuts, best, moved = y, c, now, True
                    break
        step *= 1.0 if moved else 0.5
    return best


def test_fit_reaches_the_optimum():
    rng = random.Random(3)
    true, n = [1.5, -1.2, 0.8, -0.4, 0.0, 2.0], 6
    rows, grades = [], []
    for _ in range(250):
        own = [k for k in range(n) if rng.random() < 0.5]
        z = sum(true[k] for k in own) + math.log((u := rng.uniform(0.01, 0.99)) / (1 - u))
        rows.append(np.array(own, np.int32))
        grades.append(0 if z < 0 else 1 if z < 1.5 else 2)
    model = quality.fit(rows, np.array(grades), least_signal=0.0)
    got, want = objective(model.weights[:n], list(model.thresholds), rows, grades), plain_fit(rows, grades, n)
    assert not model.weights[n:].any() and model.thresholds[0] < model.thresholds[1]
    assert abs(got - want) < 0.05, (got, want)


def test_stage_with_labels(spark, documents, tmp_path):
    """Rows stay exactly where the plain probability of the best grade reaches the bar; the labels decide which those are."""
    rng = random.Random(5)
    good, bad = [f"calm{k}" for k in range(30)], [f"vile{k}" for k in range(30)]
    texts = {i: " ".join(rng.choice(bad if i % 3 == 0 else good) for _ in range(rng.choice([20, 60]))) for i in range(240)}
    rows = [(i, t) for i, t in texts.items()] + [(900, None), (901, ""), (None, texts[3]), (None, texts[4])]
    df = documents(rows)
    marks = [(i, int(i % 3 != 0), int(i % 3 == 0)) for i in range(0, 200)] + [(5, None, 1), (None, 1, 0)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = [(r["doc_id"], r["text"]) for r in dict(corpus_pipeline.STAGES)["quality"](spark, df, str(tmp_path)).collect()]
    model = quality.fit_model(df, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    tail = lambda t: 1 / (1 + math.exp(model.thresholds[-1] - sum(model.weights[b] for b in quality.features(t or ""))))
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(out, key=key) == sorted((r for r in rows if tail(r[1]) >= quality.KEEP_FROM), key=key)
    kept = {i for i, _ in out}
    assert all((i in kept) == (i % 3 != 0) for i in range(240))  # those without labels are judged alike
