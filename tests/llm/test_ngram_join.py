import random
import re

from chainlake.llm import ngram_join as x


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    ids = [i for i, _ in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                root[max(p, q, key=lambda k: ids[k])] = min(p, q, key=lambda k: ids[k])
    copies = [[j for j in range(len(rows)) if sets[j] == sets[a] and sets[a]] or [a] for a in range(len(rows))]
    return {ids[a]: (ids[find(a)], min(ids[j] for j in copies[a]), len(copies[a]), links[a]) for a in range(len(rows))}


def corpus(seed, groups=12):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdef") for _ in range(r.randint(2, 5)))
    texts = [None, "", "  \n", "one", "one", "two words", "a b c d", "a b c d", "a b c d e", "x " * 3000]
    for _ in range(groups):
        base = [word() for _ in range(r.randint(20, 300))]
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 8)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 40))):
                copy[r.randrange(len(copy))] = word()
            texts.append("  ".join(copy))
    r.shuffle(texts)
    return list(enumerate(texts, 10))


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, class_id int, rep string").repartition(3)
    return {g.doc_id: (g.class_id, g.copy_of, g.n_copies, g.n_links) for g in x.ngram_join(df).collect()}


def test_equals_brute_force(spark):
    rows = corpus(1)
    assert run(spark, rows) == brute(rows)


def test_large_buckets_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(x, "SMALL", 6)
    monkeypatch.setattr(x, "BLOCK", 8)
    r = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = corpus(2, 3)
    for i in range(40):
        copy = list(base)
        for _ in range(r.randint(0, 3)):
            copy[r.randrange(len(copy))] = f"v{r.randrange(10_000)}"
        rows.append((500 + i, " ".join(copy)))
    assert run(spark, rows) == brute(rows)


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    got = sorted(map(tuple, x.ngram_join(df).collect()), key=str)
    assert got == [(3, 3, 3, 2, 1), (3, 3, 3, 2, 1), (None, None, None, 1, 0)]
    assert x.ngram_join(df.limit(0)).count() == 0


def test_runs_for_recall():
    assert x.runs_needed(0.8, 0.995) > x.runs_needed(0.8, 0.9) > x.runs_needed(0.95, 0.9)


def test_recall_at_the_threshold_in_hot_buckets(spark, monkeypatch):
    """Pairs of similarity 0.8 to 0.83 among texts that share a boilerplate, all walked to the deepest level."""
    monkeypatch.setattr(x, "SMALL", 2)
    r = random.Random(12)
    shared = [f"s{i}" for i in range(60)]
    rows = []
    for i in range(250):
        base = shared + [f"t{i}x{j}" for j in range(140)]
        copy = list(base)
        for j in range(4):
            copy[70 + 30 * j] = f"u{i}x{j}"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
    a, b = shingles(rows[0][1]), shingles(rows[1][1])
    assert 0.8 <= len(a & b) / len(a | b) < 0.83
    got = run(spark, rows)
    assert sum(got[2 * i + 1][0] == 2 * i for i in range(250)) >= 0.985 * 250
    assert all(got[k][0] // 2 == k // 2 for k in got)


def test_expected_recall_is_that_of_the_deepest_level():
    n = x.runs_needed()
    assert x.expected_recall(n) >= x.RECALL > x.expected_recall(n - 1)
    assert x.neighbour_share(0.6) < 0.6 - 0.15 and x.second_chance(0.5) == 1.0
