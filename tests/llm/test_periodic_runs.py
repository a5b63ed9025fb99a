import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from chainlake.llm.periodic_runs import _runs, digests, periodic_runs, with_planted_repeats


def brute(ws):
    """Every maximal stretch with its smallest period, by trying all periods."""
    n, found = len(ws), []
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and ws[j] == ws[j + p]:
                j += 1
            if j - i + p >= max(6, 4 * p):
                part = ws[i : j + p]
                if not any(all(part[k] == part[k + q] for k in range(len(part) - q)) for q in range(1, p)):
                    found.append((i, j - i + p, p))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def made(rng):
    alphabet = rng.choice(["ab", "abc", "abcdefgh", [f"w{i}" for i in range(200)]])
    ws = []
    for _ in range(rng.randint(0, 6)):
        block = [rng.choice(alphabet) for _ in range(rng.randint(1, 12))]
        ws += block * rng.randint(1, 9)
        ws += block[: rng.randint(0, len(block))]
    return ws


def test_runs_equal_trying_all_periods():
    rng = random.Random(5)
    for _ in range(600):
        ws = made(rng)
        own = {}
        x = np.array([own.setdefault(w, len(own)) for w in ws], np.int64)
        assert _runs(x, np.full(len(x), len(x)), 6, 4) == brute(ws), ws


def expected(doc_id, text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(ws)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = ws[:a] + [ws[a + (i - a) % p] for i in range(a, n)]
    runs = brute(ws)
    gone = {k for s, length, p in runs for k in range(s + p, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, sha("".join(f"{s},{length},{p}\n" for s, length, p in runs)), sha(" ".join(w for k, w in enumerate(ws) if k not in gone)))


def test_digests_equal_brute_force_on_odd_texts(spark):
    rng = random.Random(9)
    texts = [" ".join(made(rng)) for _ in range(150)]
    texts += [None, "", " \t\n", "a", "ü ü ü ü ü ü ü ü", "\x1cx " * 9, "x y " * 8, "same " * 3000, ("one two three\n" * 700).strip(), " ".join(f"w{i % 997}" for i in range(6000))]
    texts += ["same " * 40, "same " * 40]
    rows = [(i, t, "clash", [1]) for i, t in enumerate(texts)] + [(None, "b a " * 9, "x", None), (7, "again " * 8, "y", [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words array<int>")
    got = digests(periodic_runs(with_planted_repeats(docs)))
    key = lambda r: (r[0] is None, r[0] or 0, r[7])
    assert sorted(map(tuple, got.collect()), key=key) == sorted((expected(r[0], r[1]) for r in rows), key=key)
    assert digests(periodic_runs(with_planted_repeats(docs.limit(0)))).count() == 0


def test_collapsed_texts_and_spans_are_real_outputs(spark):
    docs = spark.createDataFrame([("k", "go on and on and on and on and on stop")], "name string, body string")
    row = periodic_runs(docs, "name", "body").first()
    assert [tuple(r) for r in row.runs] == [(1, 9, 2)] and row.collapsed == "go on and stop" and row.n_words == 11
    with pytest.raises(ValueError):
        periodic_runs(docs, "name", "body", periods=3)
