import random
import re
from collections import Counter

from chainlake.llm import quality_rules as q


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(wins)
    covered = {i + j for i, x in enumerate(wins) if n[x] > 1 for j in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_base_metrics_equal_brute_force(spark):
    r = random.Random(3)
    texts = [None, "", " \n\t", "a b c d", "a " * 30, "é漢🙂 #$ <x>\n\nline\nline \nline", "\x0b\x0c\r a\x1cb \xa0c", "w" * 50_000, "x y " * 20_000]
    texts += ["".join(r.choice(["a", "b", "cc", " ", "\n", "#", " ", "!"]) for _ in range(r.randint(0, 400))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, None if i % 7 == 0 else "en", "s", 1.0) for i, t in enumerate(texts)] + [(0, texts[0], None, "s", 1.0)], "doc_id long, text string, lang string, source string, kept double")
    got = q.quality_rules(df).collect()
    assert len(got) == len(texts) + 1
    for x in got:
        n, chars, symbols, dups, repeats = brute(texts[x.doc_id])
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (n, chars, symbols, dups, repeats)
        assert x.base_failed == (n < 10 or 100 * repeats > 20 * n)
        assert x.kept == (not x.base_failed and all(x[k] <= x[f"{k}_fence"] for k in q.RATIOS))


def test_fences_follow_their_group(spark):
    rows = [(i, "word " * 3 + " ".join(f"w{i}x{j}" + ("#" if i % 2 else "") for j in range(20)), "en", "marked" if i % 2 else "plain") for i in range(400)]
    rows += [(1000, " ".join(f"qqqqqq{j}#" for j in range(20)), "en", "plain"), (1001, " ".join(f"qqqqqq{j}#" for j in range(20)), "en", "marked")]
    got = {x.doc_id: x.kept for x in q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[1001] and not got[1000] and got[0] and got[1]


def test_empty_table(spark):
    assert q.quality_rules(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a", "en", "s")], "doc_id long, text string, lang string, source string")
    plan = q.base_metrics(df, ["doc_id"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_length_alone_changes_no_verdict(spark):
    """A few symbols in a long clean text are let through, and a text twice as long with the same ratios has the same verdict."""
    own = lambda i, n, every: " ".join(f"w{i}x{j}" + ("%" if every and j % every == 0 else "") for j in range(n))
    rows = [(i, own(i, 20 + i % 400, 0), "en", "a") for i in range(300)]
    rows += [(1000 + k, own(1000 + k, 20_000, 20_000 // k), "en", "a") for k in (1, 4, 5, 6, 50)]
    rows += [(2000 + n, own(2000 + n, 400 * n, 2), "en", "a") for n in (1, 2, 4, 8)] + [(3000 + n, own(3000 + n, 400 * n, 400), "en", "a") for n in (1, 2, 4, 8)]
    got = {x.doc_id: x.kept for x in q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[1000 + k] for k in (1, 4, 5, 6, 50)) and all(got[i] for i in range(300))
    assert not any(got[2000 + n] for n in (1, 2, 4, 8)) and all(got[3000 + n] for n in (1, 2, 4, 8))


def test_fences_carry_signal(spark):
    found = q.fences(q.base_metrics(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), ["lang", "source"])).toPandas()
    for r in q.RATIOS:
        assert found[f"{r}_fence"].nunique() > 10 and (found[f"{r}_fence"] > 0).all()
