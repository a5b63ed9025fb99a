import random

import pytest
from pyspark.sql import functions as F

from chainlake.functions import abi_words as abi
from chainlake.functions import wide
from chainlake.operators import decode, filters
from chainlake.operators.filters import Rule
from chainlake.sources.abi import event_registry, find, function_registry, head_words, resolve_slots, snake_case
from chainlake.sources.keccak import keccak256

LARGEST = 2**256 - 1


def numbers(n, seed=1):
    r = random.Random(seed)
    return [0, 1, 10**9, 10**18, 2**63, 2**64 - 1, 2**64, 10**38 - 1, 10**38, LARGEST, *[r.getrandbits(r.randint(1, 256)) for _ in range(n)]]


def test_known_hashes():
    assert keccak256(b"") == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert keccak256(b"Transfer(address,address,uint256)").startswith("ddf252ad")
    assert keccak256(b"x" * 500) != keccak256(b"x" * 501)


def test_decimal_text_and_sign(spark):
    values = numbers(300)
    df = spark.createDataFrame([(f"{v:064x}",) for v in values], "h string")
    got = df.select("h", wide.to_decimal_text(F.col("h")).alias("d"), wide.signed_text(F.col("h")).alias("s"), wide.fits38(F.col("h")).alias("f")).collect()
    for r in got:
        v = int(r.h, 16)
        assert r.d == str(v) and r.s == str(v - 2**256 if v >> 255 else v)
        assert (r.f is None) == (v >= 10**38) and (r.f is None or int(r.f) == v)


def test_aggregates(spark):
    values = numbers(200, 2)
    df = spark.createDataFrame([(i % 3, f"{v:064x}") for i, v in enumerate(values)] + [(9, None)], "g int, h string").repartition(4)
    h = F.col("h")
    for r in df.groupBy("g").agg(wide.wide_sum(h).alias("s"), wide.wide_avg(h).alias("a"), wide.wide_min(h).alias("l"), wide.wide_max(h).alias("m")).collect():
        own = [v for i, v in enumerate(values) if i % 3 == r.g]
        if not own:
            assert (r.s, r.a, r.l, r.m) == (None, None, None, None)
        else:
            assert (int(r.s), int(r.a), int(r.l), int(r.m)) == (sum(own), sum(own) // len(own), min(own), max(own))


def test_integer_order(spark):
    r = random.Random(3)
    values = [r.choice([-1, 1]) * v for v in numbers(60, 3)]
    df = spark.createDataFrame([(str(v), str(w)) for v in values for w in r.sample(values, 5)] + [("-0", "0"), ("007", "7")], "a string, b string")
    for x in df.select("a", "b", (wide.order_key(F.col("a")) < wide.order_key(F.col("b"))).alias("lt"), (wide.order_key(F.col("a")) == wide.order_key(F.col("b"))).alias("eq")).collect():
        assert (x.lt, x.eq) == (int(x.a) < int(x.b), int(x.a) == int(x.b))
        assert (wide.integer_key(x.a) < wide.integer_key(x.b)) == x.lt
    assert wide.integer_key("1.5") is None


def word(v):
    return f"{v % 2**256:064x}"


ABI = {
    "Desk": [
        {"type": "event", "name": "Mixed", "inputs": [{"type": t, "name": n} for n, t in [("a", "uint8"), ("b", "int24"), ("c", "int128"), ("d", "uint64"), ("pair", "uint256[2]"), ("text", "string"), ("raw", "bytes"), ("list", "int16[]"), ("flag", "bool"), ("who", "address"), ("tag", "bytes3"), ("e", "int64")]]},
        {"type": "event", "name": "Hidden", "anonymous": True, "inputs": []},
    ]
}
MIXED = find(event_registry(ABI), "Desk", "Mixed")


def log(a=7, b=-5, c=-(2**100), d=2**63, text=b"h\xc3\xa9llo", text_at=None, n_list=3, cut=None):
    head = [a, b, c, d, 11, 12, None, None, None, 1, 0xABC, int("616263", 16) << 232, -(2**63)]
    at = len(head) * 32
    tails = [word(len(text)) + text.hex().ljust(-(-len(text) // 32) * 64, "0"), word(3) + "0a0b0c".ljust(64, "0"), word(n_list) + "".join(word(v) for v in (1, -2, 3))]
    places = []
    for t in tails:
        places.append(at)
        at += len(t) // 2
    for slot, place in zip((6, 7, 8), places):
        head[slot] = place
    if text_at is not None:
        head[6] = text_at
    body = "".join(word(v) for v in head) + "".join(tails)
    return "0x" + (body if cut is None else body[:cut])


def decoded(spark, *data):
    df = spark.createDataFrame([(1, i, MIXED.key, None, None, None, d) for i, d in enumerate(data)], "chain_id int, log_index int, topic0 string, topic1 string, topic2 string, topic3 string, data string")
    return decode.event_table(df, event_registry(ABI), "Desk", "Mixed").orderBy("log_index").collect()


def test_every_type(spark):
    (r,) = decoded(spark, log())
    assert (r.p_a, r.p_b, r.p_c, r.p_d, r.p_e) == (7, -5, str(-(2**100)), str(2**63), -(2**63))
    assert r.p_pair == word(11) + word(12) and r.p_text == "héllo" and r.p_raw == "0a0b0c" and r.p_list == [1, -2, 3]
    assert r.p_flag is True and r.p_who == "0x" + "abc".rjust(40, "0") and r.p_tag == "616263" and r.p_d_hex == word(2**63)


def test_damaged_data(spark):
    rows = decoded(spark, log(cut=64 * 3), log(text_at=10**6), log(text_at=2**255), log(n_list=2**40), log(n_list=4), log(text=b"\xff\xfe"), log(cut=0), log(n_list=0), "0x0", None)
    assert rows[0].p_a == 7 and rows[0].p_d is None and rows[0].p_text is None
    assert rows[1].p_text is None and rows[2].p_text is None and rows[1].p_list == [1, -2, 3]
    assert rows[3].p_list is None and rows[4].p_list is None and rows[7].p_list == []
    assert rows[5].p_text == "fffe" and rows[6].p_a is None and rows[8].p_a is None and rows[9].p_a is None


def test_registry():
    assert [d.name for d in event_registry(ABI)] == ["Mixed"]
    assert snake_case("ERC20") == "e_r_c20" and snake_case("amount0In") == "amount0_in"
    assert head_words("uint256[2]") == 2 and head_words("(address,uint8[3])") == 4 and head_words("(string,bool)") is None
    swap = function_registry({"R": [{"type": "function", "name": "swapExactTokensForTokens", "inputs": [{"type": t, "name": ""} for t in ("uint256", "uint256", "address[]", "address", "uint256")], "outputs": [{"type": "uint256[]", "name": ""}]}]})[0]
    assert swap.key == "0x38ed1739" and swap.outputs[0].name == "output_0"
    with pytest.raises(KeyError):
        resolve_slots(MIXED, ["absent"])


def test_spark_types():
    kinds = {"uint24": "int", "uint32": "bigint", "uint56": "bigint", "uint64": "string", "int32": "int", "int64": "bigint", "int72": "string", "bool": "boolean", "address[]": "array<string>", "int8[]": "array<int>", "string[]": "string", "what": "string"}
    assert {k: abi.spark_type(k).simpleString() for k in kinds} == kinds


def test_quantities(spark):
    cases = {"0x10": 16, "0x": 0, "0x7fffffffffffffff": 2**63 - 1, "0x8000000000000000": 0, "0xzz": 0, "12": 12, "": 0, "99999999999999999999": 0, "0x" + "0" * 40 + "1": 1}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.q for r in df.select("t", abi.hex_quantity(F.col("t")).alias("q")).collect()} == cases


def test_filters(spark):
    df = spark.createDataFrame([(1, str(2**200), "abc"), (2, "-5", "ABC"), (3, "10", ""), (4, None, None)], "id int, p_value string, p_memo string")
    ids = lambda *rules: sorted(r.id for r in filters.apply_filters(df, list(rules), "C", "E").collect())
    one = lambda f, op, v: Rule("E", ((f, op, v),))
    assert ids(one("value", "gt", "9")) == [1, 3, 4] and ids(one("value", "lte", "-5")) == [2, 4] and ids(one("value", "eq", str(2**200))) == [1, 4]
    assert ids(one("memo", "contains", "b")) == [1, 4] and ids(one("memo", "contains", "")) == [1, 2, 3, 4] and ids(one("memo", "lt", "a")) == [2, 3, 4]
    assert ids(one("memo", "strange", "x")) == ids(one("absent", "eq", "x")) == ids() == ids(Rule("Other", (("value", "eq", "1"),))) == [1, 2, 3, 4]
    assert ids(one("value", "eq", "10"), one("memo", "eq", "abc")) == [1, 3, 4] and ids(Rule("E", (("value", "gt", "0"), ("memo", "neq", "abc")))) == [3, 4]
    assert ids(Rule("E", (("value", "eq", "1"),), contract="D")) == [1, 2, 3, 4]


def test_rebuild_is_needed_where_logs_have_no_decoded_rows(spark):
    registry = event_registry({"A": [{"type": "event", "name": n, "inputs": []} for n in ("One", "Two", "Three")]})
    raw = spark.createDataFrame([(registry[0].key,), (registry[0].key,), (registry[1].key,), ("0xother",), (None,)], "topic0 string")
    counts = spark.createDataFrame([("event_a_one", 1), ("event_a_one", 1), ("event_a_two", 0), ("gone", 7)], "table_name string, decoded_rows long")
    got = {tuple(r) for r in decode.rebuild_needed(raw, registry, counts).collect()}
    assert got == {("event_a_one", 2, 2, False), ("event_a_two", 1, 0, True), ("event_a_three", 0, 0, False)}
    none = decode.rebuild_needed(raw.limit(0), registry, counts.limit(0)).collect()
    assert len(none) == 3 and not any(r.needed for r in none)
