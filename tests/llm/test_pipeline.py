import corpus_pipeline
from pyspark.sql import functions as F
from test_ngram_join import brute

from chainlake.llm import shared, surrogates
from chainlake.llm.importance import importance_sample

SF = "/root/testdata/sf0.001"


def plain(t):
    return [w for w in ("".join(c for c in x.lower() if c.isalnum()) for x in t.split()) if w]


def test_each_stage_against_its_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(w[i : i + 13]) for w in items for i in range(len(w) - 12)}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = shared.stored(stage(spark, before, SF), "test")
        old, new = ({r.doc_id: r for r in df.collect()} for df in (before, after))
        if name == "quality classifier":
            kept = importance_sample(before, spark.read.parquet(f"{SF}/labels.parquet")).where("kept")
            assert set(new) == {r.doc_id for r in kept.collect()} and len(new) > 0.7 * len(old)
        elif name == "n-gram Jaccard join":
            want = brute([(r.doc_id, r.text) for r in old.values()])
            assert set(new) == {i for i, x in want.items() if x[0] == i}
        elif name == "benchmark decontamination":
            held = {i for i, r in old.items() if any(tuple(w[k : k + 13]) in grams for w in [plain(r.text)] for k in range(len(w) - 12))}
            assert set(old) - set(new) == held
        elif name == "PII":
            assert set(new) == set(old)
            for i, r in old.items():
                values = [r.text[a:b] for _, a, b in surrogates.entities(r.text)]
                assert not any(v in new[i].text for v in values) and (values or new[i].text == r.text) and new[i].n_chars == len(new[i].text)
        else:
            assert set(new) == set(old) and all(r.rate >= 0 and r.text == old[r.doc_id].text for r in new.values())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
        before = after


def test_run_on_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, "no id", None, None, None), (9001, None, "en", "src1", None), (9002, "", None, None, 0), (9002, "", None, None, 0)], docs.schema)
    docs.unionByName(odd).write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.where(F.col("rate").isNull()).count() == 0 and out.count() > 30
    empty = tmp_path / "empty"
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{t}.parquet")).limit(0).write.parquet(str(empty / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
