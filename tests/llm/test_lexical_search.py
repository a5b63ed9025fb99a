import math
import random
import re
from collections import Counter

import pytest

from chainlake.llm import lexical_search as module
from chainlake.llm.lexical_search import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, queries, k):
    counts = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in queries:
        asked = {t for t in TERM.findall((text or "").translate(LOWER)) if df[t]}
        scores = []
        for i, c in counts:
            m = 50 + (50 * sum(c.values()) * n_docs) // max(n_terms, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in asked if t in c)
            if s > 0:
                scores.append((-s, i is None, i if i is not None else 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return out


def texts(rng, n):
    words = [f"w{i}" for i in range(60)] + ["Über", "naïve", "東京", "X9"]
    topics = [rng.sample(words, 12) for _ in range(6)]
    made = []
    for _ in range(n):
        topic = rng.choice(topics)
        made.append(rng.choice([" ", ", ", "-"]).join(rng.choice(topic if rng.random() < 0.8 else words) for _ in range(rng.randint(1, 60))))
    return made


@pytest.fixture
def small_blocks(monkeypatch):
    """Shards of 150 documents and blocks of 8, so that small tables have many of both."""
    monkeypatch.setattr(module, "BLOCK", 8)
    monkeypatch.setattr(module, "SHARD_DOCS", 150)


def test_equals_brute_force_with_copies_ties_and_odd_texts(spark, small_blocks):
    rng = random.Random(3)
    made = texts(rng, 700)
    made += [made[5]] * 120 + [None, "", "\x00\x1f -- !", "w1" * 3, "w1 " * 5000, "ÜBER über Über", "w3\x00w4"]
    docs = [(i * 7 % 2003, t) for i, t in enumerate(made)] + [(None, made[8]), (11, made[5]), (11, made[5])]
    queries = [(i, t) for i, t in enumerate(texts(rng, 25))] + [(100, made[5]), (101, None), (102, "nowhere"), (103, "W1 w1 W1"), (None, "w2 東京"), (7, "w2"), (105, "")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, terms string, n int").repartition(2)
    asked = spark.createDataFrame([(i, t, 5) for i, t in queries], "item_id long, text string, rank int")
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    want = sorted(brute(docs, queries, 50), key=key)
    for at_once in (10_000, 40):
        got = sorted(map(tuple, lexical_search(table, asked, terms_at_once=at_once).collect()), key=key)
        assert [(r[0], r[1], r[3]) for r in got] == [(r[0], r[1], r[3]) for r in want]
        assert Counter(got) == Counter(want)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def test_blocks_are_passed_over_only_below_the_bound(spark, small_blocks):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(4)
    places = [sorted(rng.sample(range(40), rng.randint(1, 12))) for _ in range(900)]
    table = pa.table({"_id": pa.array(range(900)), "n": pa.array([len(p) for p in places]), "terms": pa.array(places, pa.list_(pa.int32())), "counts": pa.array([[rng.randint(1, 4) for _ in p] for p in places], pa.list_(pa.int32()))})
    questions = [np.array(sorted(rng.sample(range(40), 5))) for _ in range(30)]
    shard = module._Shard(table, np.arange(40) * 30, 900, int(sum(map(len, places))), lambda t: np.unique(np.concatenate([q for q in questions if t in q])))
    visited = 0
    for q in questions:
        everything, scores = shard.best(q, 1, 900, 900)
        docs, best = shard.best(q, int(scores[9]), 900, 10)
        assert best.tolist() == scores[:10].tolist() and docs.tolist() == everything[:10].tolist()
        for t in q.tolist():
            members, of, largest, begin = shard.blocks(t)
            assert sorted(np.concatenate(members).tolist()) == sorted(shard.posted[shard.first[t] : shard.first[t + 1]].tolist())
            asked = np.zeros(40, np.int64)
            asked[q] = shard.weights[q]
            bounds = np.add.reduceat(asked[of] * largest, begin)
            score = dict(zip(everything.tolist(), scores.tolist(), strict=True))
            assert all(score.get(d, 0) <= b for docs_of, b in zip(members, bounds, strict=True) for d in docs_of.tolist())
            visited += int((bounds >= scores[9]).sum()) < len(members)
    assert visited > 50  # lists of which some blocks are passed over


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search(docs.limit(0), asked).count() == 0
    assert lexical_search(docs, asked.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert [tuple(r)[:3] for r in lexical_search(docs, asked).collect()] == [(1, 1, 1)]
