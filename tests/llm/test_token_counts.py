import public_tokenizers
from tokenizers import Tokenizer

from chainlake.llm.token_counts import token_counts

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


def test_equals_the_library(spark):
    texts = [None, "", " ", "  a  b\n\n c ", "I'll we're 12 abc123 ###$$ é ñandú ßtraße", "x<|endoftext|>y <|endoftext|>", "the " * 5000, "q" * 70000, "\t\r\n mixed 漢字 かな 🙂🙂", "same", "same"]
    df = spark.createDataFrame([(i, t, "extra", 3) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, over_limit int")
    got = {r.doc_id: r for r in token_counts(df, PATH, top=3).collect()}
    t = Tokenizer.from_file(PATH)
    for i, text in enumerate(texts):
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 1024)


def test_empty_table(spark):
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_null_ids_and_other_vocabularies(spark, tmp_path):
    import json

    import pytest

    from chainlake.llm import token_counts as x

    df = spark.createDataFrame([(None, "a b"), (None, None), (1, "a b")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in token_counts(df, PATH).collect()) == [(0, 0), (0, 2), (1, 2)]
    made = json.load(open(PATH, encoding="utf-8"))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": made["pre_tokenizer"] | {"add_prefix_space": True}}):
        other = tmp_path / f"{len(list(tmp_path.iterdir()))}.json"
        other.write_text(json.dumps(made | change), encoding="utf-8")
        with pytest.raises(ValueError):
            x._tokenizer(str(other))


def test_table_of_the_vocabulary_and_a_sample(spark):
    """Each entry of the table is one token or as many as the library says; a text of 8 MB counts whole; the plan has no shuffle."""
    from chainlake.llm import token_counts as x

    pieces = x.vocabulary_pretokens(PATH)
    assert len(pieces) > 20_000 and " the" in pieces and "é" in pieces
    t = Tokenizer.from_file(PATH)
    assert x._lengths(PATH, pieces[::97]) == [len(t.encode(p, add_special_tokens=False).ids) for p in pieces[::97]]
    long = "naïve zebra12 " * 600_000
    df = spark.createDataFrame([(1, long), (2, "zebra12 zebra12")], "doc_id long, text string")
    assert set(x.frequent_pretokens(df, top=3)) == {" zebra", "12", " naïve"} or len(x.frequent_pretokens(df, top=3)) == 3
    got = {r.doc_id: r.n_tokens for r in token_counts(df, PATH).collect()}
    one = len(t.encode("naïve zebra12", add_special_tokens=False).ids), len(t.encode(" naïve zebra12", add_special_tokens=False).ids)
    assert got[1] == one[0] + 599_999 * one[1] + len(t.encode("a ", add_special_tokens=False).ids) - 1
    assert "Exchange" not in token_counts(spark.range(3).selectExpr("id AS doc_id", "'a' AS text"), PATH)._jdf.queryExecution().executedPlan().toString()
