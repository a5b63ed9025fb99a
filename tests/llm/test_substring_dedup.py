import hashlib
import random
import re

from chainlake.llm.substring_dedup import SubstringIndex, digests, substring_dedup


def brute(rows, n=13):
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in split:
        for i in range(len(w) - n + 1 if d is not None else 0):
            k = tuple(w[i : i + n])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - n + 1 if d is not None else 0):
            if first[tuple(w[i : i + n])] < d:
                gone |= set(range(i, i + n))
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abé漢") for _ in range(r.randint(1, 4)))
    passage = [word() for _ in range(60)]
    rows = [(100, None), (101, ""), (102, " \t\n"), (103, "x " * 3000), (104, "x " * 40), (None, " ".join(passage)), (105, "z" * 100_000)]
    for i in range(60):
        w = [word() for _ in range(r.randint(0, 80))]
        if i % 3 == 0:
            a = r.randint(0, 40)
            w[len(w) // 2 : len(w) // 2] = passage[a : a + r.randint(5, 20)]
        rows.append((i, "\n ".join(w)))
    return [*rows, (7, rows[14][1]), (200, rows[10][1]), (201, rows[10][1])]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n_words int, prints string")


def test_equals_brute_force(spark):
    rows = corpus()
    got = digests(substring_dedup(frame(spark, rows).repartition(3))).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_batches_and_compaction_equal_one_call(spark):
    rows = sorted((x for x in corpus() if x[0] is not None), key=lambda x: x[0])
    cuts = [0, 3, 20, 45, len(rows)]
    rows = [x for i, x in enumerate(rows)]
    index, got = SubstringIndex(3, most_runs=1), []
    for a, b in zip(cuts, cuts[1:]):
        got += map(tuple, digests(index.ingest(frame(spark, rows[a:b]))).collect())
    assert sorted(got, key=str) == brute(rows)
    assert len(index.runs) == 1


def test_empty_table(spark):
    assert substring_dedup(frame(spark, [])).count() == 0


def test_a_later_session_goes_on(spark, tmp_path):
    rows = sorted((x for x in corpus() if x[0] is not None), key=lambda x: x[0])
    index = SubstringIndex(3, most_runs=2, folder=f"file://{tmp_path}/index")
    got = []
    for a, b in ((0, 10), (10, 25), (25, 40), (40, len(rows))):
        got += map(tuple, digests(index.ingest(frame(spark, rows[a:b]))).collect())
        for stored in (*index.runs, *index.texts):
            spark.sql(f"DROP TABLE {stored.name}")  # as in a session that hasn't seen them
        index = SubstringIndex.open(spark, f"file://{tmp_path}/index")
    assert sorted(got, key=str) == brute(rows) and len(index.runs) == 2 and len(index.texts) == 4


def test_words_decide_where_fingerprints_clash(spark, monkeypatch):
    """Fingerprints of 9 bits stand for many windows each."""
    from chainlake.llm import substring_dedup as x

    monkeypatch.setattr(x, "PRINT_BITS", 9)
    monkeypatch.setattr(x, "_prints", lambda w, n: (lambda at, p: (at, p >> x.np.uint64(55)))(*w.windows(n, 1)))
    rows = [r for r in corpus() if r[0] is None or r[0] != 103]
    got = x.digests(x.substring_dedup(frame(spark, rows).repartition(3), batches=3)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_older_runs_are_not_shuffled(spark):
    rows = sorted((x for x in corpus() if x[0] is not None), key=lambda x: x[0])
    index = SubstringIndex(3)
    index.ingest(frame(spark, rows[:30]))
    a, b = index.runs[0], index.runs[0]
    joined = a.rows.groupBy("bucket").cogroup(b.rows.groupBy("bucket")).applyInArrow(lambda x, y: x, a.rows.schema)
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()


def test_runs_have_small_rows_and_merge_in_order(spark, monkeypatch):
    """A bucket's fingerprints aren't one value of any length; pieces are put in order again where runs meet."""
    from chainlake.llm import substring_dedup as x

    monkeypatch.setattr(x, "PIECE", 5, raising=False)
    rows = sorted((r for r in corpus() if r[0] is not None), key=lambda r: r[0])
    index, got = SubstringIndex(3, most_runs=2), []
    for a, b in ((0, 10), (10, 25), (25, 40), (40, len(rows))):
        got += map(tuple, digests(index.ingest(frame(spark, rows[a:b]))).collect())
        for run in index.runs:
            assert run.rows.where("kind = 0").selectExpr("max(length(prints)) <= 40 and max(length(docs)) <= 40").first()[0]
    assert sorted(got, key=str) == brute(rows) and len(index.runs) == 2


def test_digests_need_no_further_python_worker(spark):
    kept = substring_dedup(frame(spark, corpus()[:9]), batches=1)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(digests(kept)).count("MapInArrow") == plan(kept).count("MapInArrow")
