import random
import zlib

from chainlake.llm import toxicity as x


def corpus(n=1500, seed=4):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(r.randint(0, 60))]
        bad = r.random() < 0.3
        for _ in range(r.randint(1, 3) if bad else 0):
            w.insert(r.randint(0, len(w)), r.choice(["idiot", "STUPID!", "you m0ron", "zorkling", "zorkling"]))
        rows.append((i, " ".join(w), "en"))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    odd = [(5000, None, "en"), (5001, "", None), (5002, "you idiot " * 20_000, "en"), (5003, "idiot", "en"), (5003, "idiot", "en"), (None, "x", "en")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, score string").repartition(3)
    got = x.toxicity(docs, spark.createDataFrame(labels + [(3, None), (None, 1)], "doc_id long, toxic int")).collect()
    assert len(got) == len(rows) + len(odd)
    assert all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.5) for g in got)
    for g in got:
        if g.doc_id is not None:
            assert g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 5 == 0)
    right = dict(labels)
    held = [g for g in got if g.held_out and g.doc_id in right]
    assert len(held) > 200 and sum(g.predicted == right[g.doc_id] for g in held) / len(held) > 0.95
    by = {g.doc_id: g for g in got}
    assert by[5002].predicted == by[5003].predicted == 1 and by[5000].score == by[5001].score < 0.5


def test_without_usable_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    got = x.toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert got[0].score == 0.5
    assert x.toxicity(docs.limit(0), spark.createDataFrame([(1, 0)], "doc_id long, toxic int")).count() == 0


def test_words_are_found_beside_any_mark_and_in_any_case(spark):
    texts = ["¡Idiota!", "“idiot”", "ESTÚPIDO", "„Trottel“…", "eres un idiota", "you IDIOT!!", "«imbécile»", "M0R0N", "a house by the sea"]
    got = x.features(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), [], ["i"]).collect()
    hit, disguised = x.FEATURES.index("hit_rate"), x.FEATURES.index("obfuscated_rate")
    by = {g.i: g.features for g in got}
    assert [i for i in range(7) if by[i][hit] == 0] == [] and by[7][disguised] > 0 and by[8][hit] == by[8][disguised] == 0
