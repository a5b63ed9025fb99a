import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainlake.llm import mixing as x


def table(spark, n=400, seed=1):
    r = np.random.default_rng(seed)
    p = r.dirichlet([0.5, 0.4, 0.3], n)
    t = r.integers(0, 500, n)
    return spark.createDataFrame([(i, int(a), [float(v) for v in b]) for i, (a, b) in enumerate(zip(t, p, strict=True))], "id long, n_tokens long, p array<double>"), t, p


def by_hand(t, p, target, steps=x.STEPS):
    rate = np.ones(len(t))
    inverse = np.linalg.pinv((p * t[:, None]).T @ p)
    for _ in range(steps):
        gap = (rate * t) @ p - target
        if np.abs(gap).max() <= x.TOLERANCE * target.sum():
            break
        rate = np.maximum(0, rate - p @ (inverse @ gap))
    return rate


@pytest.mark.parametrize("share", [(0.2, 0.2, 0.6), (0.75, 0.15, 0.1)])
def test_rates_meet_targets_and_equal_plain_steps(spark, share):
    df, t, p = table(spark)
    target = t.sum() * np.array(share)
    rate, totals = x.fit_rates(df, list(target))
    got = np.array([r.rate for r in df.select("id", rate.alias("rate")).orderBy("id").collect()])
    assert (got >= 0).all() and np.allclose(got, by_hand(t, p, target), atol=1e-9)
    assert np.allclose(totals, target, rtol=1e-4)


def test_unreachable_targets_get_no_worse(spark):
    df, t, p = table(spark)
    target = np.array([1e9, 0.0, 0.0])
    rate, totals = x.fit_rates(df, list(target))
    assert np.isfinite(totals).all() and df.where(rate < 0).count() == 0


def test_whole_operator(spark):
    r = random.Random(0)
    vocabulary = {"a": "abcde", "b": "vwxyz"}
    rows, labels = [], []
    for i in range(400):
        d = r.choice("ab")
        rows.append((i, " ".join("".join(r.choice(vocabulary[d]) for _ in range(2)) for _ in range(r.randint(5, 50))), 1.0))
        labels.append((i, d))
    rows += [(1000, None, 1.0), (1001, "", 1.0), (1002, "ab " * 40_000, 1.0), (5, rows[5][1], 1.0), (None, "ab", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rate double").repartition(3)
    known = spark.createDataFrame([*labels[:200], (3, None), (None, "a"), (7, "other")], "doc_id long, domain string")
    got = x.mix(docs, known, {"a": 0.7, "b": 0.3}, tokens=20_000.0)
    assert got.count() == len(rows)
    out = {g.doc_id: g for g in got.collect()}
    assert sum((out[i].p_a > 0.5) == (d == "a") for i, d in labels[200:]) >= 195
    sums = got.agg(*[F.sum(F.col("rate") * F.col("n_tokens") * F.col(f"p_{d}")) for d in "ab"]).first()
    assert np.allclose(list(sums), [14_000, 6_000], rtol=1e-3)
    assert out[1000].n_tokens == out[1001].n_tokens == 0 and out[1000].rate == out[1001].rate
    flat = x.mix(docs, known.limit(0), {"a": 1.0, "b": 1.0}).first()
    assert flat.p_a == flat.p_b == 0.5
    assert x.mix(docs.limit(0), known, {"a": 1.0, "b": 1.0}).count() == 0


def test_corpus_is_read_in_as_many_tasks_as_it_has_and_columns_are_carried(spark):
    docs = spark.createDataFrame([(i, "ab " * (i % 7 + 1), "s", [i], "clash") for i in range(300)], "doc_id long, text string, source string, p array<int>, rate string").repartition(17)
    known = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(100)], "doc_id long, domain string")
    tracker, group = spark.sparkContext.statusTracker(), "mix-tasks"
    spark.sparkContext.setJobGroup(group, group)
    out = x.mix(docs, known, {"a": 1.0, "b": 1.0}, carry=docs.columns)
    rows = out.collect()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert tasks.count(17) >= 3  # labelled texts, posteriors, and the rows with them
    assert out.columns[:5] == [*docs.columns[:4], "n_tokens"] and len(rows) == 300 and all(r.p == [r.doc_id] for r in rows)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
