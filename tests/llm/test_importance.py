import math
import random

import pytest

from chainlake.llm import importance as x


def corpus(n=900):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        good = r.random() < 0.8
        w = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) + ("" if good else r.choice(["###", "$$$"])) for _ in range(r.randint(5, 60))]
        rows.append((i, " ".join(w), "en"))
        labels.append((i, int(good)))
    return rows, labels


def test_junk_goes_and_good_texts_stay(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = x.importance_sample(docs, spark.createDataFrame([a for a in labels if a[0] % 2], "doc_id long, quality int")).collect()
    unseen = [(g.kept, labels[g.doc_id][1]) for g in got if g.doc_id % 2 == 0]
    assert len(got) == len(rows)
    assert sum(k for k, q in unseen if q) / sum(q for _, q in unseen) > 0.97
    assert sum(k for k, q in unseen if not q) / sum(not q for _, q in unseen) < 0.3


def test_size_ties_and_odd_rows(spark):
    rows, labels = corpus(60)
    odd = [(100, None, None), (101, "", None), (102, "\n\t ", None), (103, "w " * 50_000, None), (7, rows[7][1], None), (None, "a b", None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, kept string")
    known = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, quality int")
    got = x.importance_sample(docs, known, size=20).collect()
    assert len(got) == len(rows) + len(odd)
    keys = sorted((g.key for g in got), reverse=True)
    assert all(g.kept == (g.key >= keys[19]) for g in got)
    by = {g.doc_id: g for g in got}
    assert by[100].log_weight == by[101].log_weight == by[102].log_weight == 0 and by[100].n_features == 0
    assert len({(g.key, g.kept) for g in got if g.doc_id == 7}) == 1
    assert not any(g.kept for g in x.importance_sample(docs, known, size=0).collect())
    assert all(g.kept and g.log_weight == 0 for g in x.importance_sample(docs, known.limit(0)).collect())
    assert x.importance_sample(docs.limit(0), known).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_kth_largest(spark, seed):
    r = random.Random(seed)
    values = [r.choice([r.gauss(0, 1), 0.0, 1e-300, 1e9, -math.pi]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 7, 250, 500):
        assert x.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]


def test_weights_equal_plain_models(spark):
    """Counts, smoothing, ratios and sums once more in plain Python."""
    from collections import Counter

    import pyarrow as pa

    from chainlake.llm.words import utf8

    rows, labels = corpus(200)
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, kept string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {g.doc_id: g for g in x.importance_sample(docs.repartition(3), known, size=50).collect()}
    good = [i for i, q in labels if q == 1]
    fitted = {r.i for r in spark.createDataFrame([(i,) for i in good], "i long").selectExpr("i", f"pmod(xxhash64(i, {x.SEED}), 4) > 0 AS f").where("f").collect()}
    features = {i: x._buckets(*utf8(pa.array([t])))[1].tolist() for i, t, _ in rows}
    raw, target = Counter(f for v in features.values() for f in v), Counter(f for i in fitted for f in features[i])
    kind = lambda f: f // x.BUCKETS
    total = lambda c: [sum(n for f, n in c.items() if kind(f) == k) for k in range(3)]
    all_raw, all_target, weight = total(raw), total(target), x.SMOOTHING * x.BUCKETS

    def ratio(f):
        q = (raw[f] + x.SMOOTHING) / (all_raw[kind(f)] + weight)
        return math.log((target[f] + weight * q) / (all_target[kind(f)] + weight) / q)

    for i, v in features.items():
        want = sum(map(ratio, v))
        assert math.isclose(got[i].log_weight, want, rel_tol=1e-9, abs_tol=1e-9) and got[i].n_features == len(v)


def test_sampling_rates_follow_the_weights(spark):
    """Gumbel top-k takes rows as often as drawing one after the other in proportion to the weights does."""
    weights, k, trials = [1.0, 2.0, 4.0, 8.0], 2, 4000
    df = spark.range(trials).selectExpr("id AS trial").crossJoin(spark.createDataFrame([(i, math.log(w)) for i, w in enumerate(weights)], "i int, lw double"))
    key = df.selectExpr("trial", "i", "lw", "trial * 10 + i AS id").withColumn("key", x.F.col("lw") + x.gumbel("id"))
    taken = key.groupBy("trial").agg(x.F.slice(x.F.sort_array(x.F.collect_list(x.F.struct("key", "i")), False), 1, k).alias("top")).select(x.F.explode("top.i").alias("i")).groupBy("i").count().collect()
    got = {r.i: r["count"] / trials for r in taken}
    total = sum(weights)
    for i, w in enumerate(weights):
        want = w / total + sum(v / total * w / (total - v) for j, v in enumerate(weights) if j != i)
        assert abs(got[i] - want) < 0.03


def test_noise_decides_among_texts_of_like_weight_only(spark):
    """A sample of half the good texts: junk stays out, and which good texts are in changes with the seed in part, as their weights differ by more than the noise in part."""
    rows, labels = corpus(600)
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, kept string"), spark.createDataFrame(labels, "doc_id long, quality int")
    good = sum(q for _, q in labels)
    first, again = ({g.doc_id for g in x.importance_sample(docs, known, size=good // 2, seed=seed).where("kept").collect()} for seed in (17, 18))
    plain = {g.doc_id for g in x.importance_sample(docs, known, size=good // 2).orderBy(x.F.desc("log_weight")).limit(good // 2).collect()}
    assert len(first) == len(again) == good // 2 and all(dict(labels)[i] for i in first | again)
    assert 0.01 < len(first - plain) / len(plain) < 0.5 and first != again


def test_rows_equal_the_samples_and_keep_their_columns(spark):
    rows, labels = corpus(80)
    docs = spark.createDataFrame([*rows, (None, None, "x")], "doc_id long, text string, kept string").withColumn("key", x.F.array(x.F.lit(1)))
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    got = x.important_rows(docs, known, size=30)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == {r.doc_id for r in x.importance_sample(docs, known, size=30).where("kept").collect()}
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
