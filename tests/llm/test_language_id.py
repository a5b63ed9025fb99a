import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from chainlake.llm.language_id import LONGEST, fit, language_id

SYLLABLES = {"xa": ["ka", "to", "mi", "ru", "ne"], "yb": ["str", "och", "ung", "ei", "pf"], "zc": ["ção", "ñe", "lla", "ío", "rá"]}


def text(rng, lang, n=40):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def table(spark, n=600, seed=1):
    rng = random.Random(seed)
    rows = [(i, text(rng, lang, rng.randint(1, 60)), lang) for i in range(n) for lang in [rng.choice(list(SYLLABLES))]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_texts_get_their_language(spark):
    docs = table(spark)
    got = language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert 60 < len(held) < 200 and {r.doc_id for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got) and np.mean([r.score for r in held]) > 0.8


def test_held_out_rows_and_other_columns_decide_nothing(spark):
    docs = table(spark, 200)
    plain = {r.doc_id: (r.lang_pred, r.score) for r in language_id(docs).collect()}
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    changed = docs.withColumn("lang", F.when(out, "wrong").otherwise(F.col("lang"))).withColumn("source", F.lit("s")).withColumn("score", F.lit("clash"))
    assert plain == {r.doc_id: (r.lang_pred, r.score) for r in language_id(changed).collect()}


def test_words_first_then_longest_known_ngrams(spark):
    rows = [(1, "banana banana banda", "a"), (2, "kiwi kiwi kilo", "b")]
    model = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["a", "b"] and model.known("banana") == (model.tables[0]["banana"],)
    found = model.known("bananas")
    assert {g for g, at in model.tables[LONGEST].items() if at in found} == {"<bana", "banan", "anana"} and len(found) == 3
    assert model.known("xaq") == (model.tables[1]["a"],) and model.known("東") == ()
    # by hand: banana twice of 3 words and 2 kinds in a, never in b
    n, rows = model.scores(["banana", "Bananas, banana!", None], {})
    assert n.tolist() == [1, 2, 0] and np.allclose(rows[0], np.log([3 / (3 + 2 + 1), 0.5 / (3 + 2 + 1)])) and not rows[2].any()
    counts = {"a": {"<bana": 2, "banan": 2, "anana": 2}, "b": {}}
    totals = {"a": (2 * 4 + 3, 4 + 3), "b": (2 * 2 + 2, 2 + 2)}
    by_hand = [np.mean([np.log((counts[k].get(g, -0.5) + 1) / (sum(totals[k]) + 1)) for g in counts["a"]]) for k in "ab"]
    assert np.allclose(rows[1] - rows[0], by_hand)


def test_odd_rows(spark):
    docs = table(spark, 60)
    long = "katomi " * 300_000
    odd = [(1000, None, "xa"), (1001, "", "xa"), (1002, " 12 !! ", None), (None, "katomi rune", "xa"), (1003, long, None), (1004, "kato", None), (1004, "kato", None), (1005, "東京", "yb"), (1006, "x" * 3_000_000, None)]
    got = language_id(docs.unionByName(spark.createDataFrame(odd, docs.schema))).where("doc_id >= 1000 or doc_id is null").collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(odd) and [by_id[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by_id[1000].score == 0
    assert by_id[None].held_out and by_id[None].lang_pred == by_id[1003].lang_pred == by_id[1004].lang_pred == "xa"
    assert by_id[1005].lang_pred in SYLLABLES and language_id(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
