"""ABI words to typed values, as Column expressions. Damaged or short data gives null."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainlake.functions import wide
from chainlake.sources.abi import Definition, Param, head_words, split_array

WORD = 64
#: Larger offsets and lengths than this can't lie within a text column.
LARGEST_OFFSET_DIGITS = 8


def spark_type(kind: str) -> T.DataType:
    """Spark type of a Solidity type."""
    array = split_array(kind)
    if array and array[1] is None and head_words(array[0]) == 1:
        return T.ArrayType(spark_type(array[0]))
    if m := re.fullmatch(r"(u?)int(\d+)", kind):
        bits = int(m[2])
        if bits <= (24 if m[1] else 32):
            return T.IntegerType()
        if bits <= (56 if m[1] else 64):
            return T.LongType()
        return T.StringType()
    return T.BooleanType() if kind == "bool" else T.StringType()


def strip(data: Column) -> Column:
    """Lower hex without 0x; null stays null."""
    return F.lower(F.when(F.substring(data, 1, 2).isin("0x", "0X"), F.substring(data, 3, 1 << 30)).otherwise(data))


def word(body: Column, i: int) -> Column:
    """The i-th word, null if the data ends before it does."""
    return F.when(F.length(body) >= (i + 1) * WORD, F.substring(body, i * WORD + 1, WORD))


def _small(w: Column) -> Column:
    """A word as an offset or length: null if it can't be one, so that nothing overflows."""
    return F.when(F.substring(w, 1, WORD - LARGEST_OFFSET_DIGITS) == "0" * (WORD - LARGEST_OFFSET_DIGITS), F.conv(F.substring(w, WORD - LARGEST_OFFSET_DIGITS + 1, LARGEST_OFFSET_DIGITS), 16, 10).cast("bigint"))


def address(w: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.right(w, F.lit(40))))


def _integer(kind: str, w: Column) -> Column:
    signed, bits = not kind.startswith("u"), int(re.sub(r"\D", "", kind))
    digits = F.right(w, F.lit(bits // 4))
    target = spark_type(kind)
    if bits <= 64 and not isinstance(target, T.StringType):
        value = F.conv(digits, 16, 10).cast("decimal(20,0)")
        if signed:
            value = F.when(F.substring(digits, 1, 1) >= "8", value - F.lit(str(1 << bits)).cast("decimal(20,0)")).otherwise(value)
        return value.cast(target)
    if not signed:
        return wide.to_decimal_text(F.lpad(digits, WORD, "0"))
    fill = F.when(F.substring(digits, 1, 1) >= "8", F.lit("f" * (WORD - bits // 4))).otherwise(F.lit("0" * (WORD - bits // 4)))
    return wide.signed_text(F.concat(fill, digits))


def static(kind: str, w: Column) -> Column:
    """A value of one word."""
    if kind == "address":
        return address(w)
    if kind == "bool":
        return F.right(w, F.lit(1)) == "1"
    if re.fullmatch(r"u?int\d+", kind):
        return _integer(kind, w)
    if m := re.fullmatch(r"bytes(\d+)", kind):
        return F.substring(w, 1, 2 * int(m[1]))
    return w


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body).getItem(0)


def _tail(body: Column, offset_word: Column, use) -> Column:
    """`use(length, rest of the data)` of a dynamic value, null where its place or length can't be."""
    rest = lambda o: F.when(o + WORD <= F.length(body), F.substr(body, o + 1))
    split = lambda r: F.struct(_small(F.substring(r, 1, WORD)).alias("n"), F.substring(r, WORD + 1, 1 << 30).alias("r"))
    return _let(_small(offset_word) * 2, lambda o: _let(rest(o), lambda r: _let(split(r), lambda x: use(x["n"], x["r"]))))  # each step is computed once


def dynamic(kind: str, body: Column, offset_word: Column) -> Column:
    """A string, bytes, array of one-word elements; other dynamic types as the hex from their place on."""
    if kind in ("string", "bytes"):

        def cut(n: Column, r: Column) -> Column:
            hexed = F.when(F.length(r) >= n * 2, F.substr(r, F.lit(1), (n * 2).cast("int")))
            if kind == "bytes":
                return hexed
            return _let(hexed, lambda h: F.when(F.is_valid_utf8(F.unhex(h)), F.decode(F.unhex(h), "UTF-8")).otherwise(h))

        return _tail(body, offset_word, cut)
    array = split_array(kind)
    if array and array[1] is None and head_words(array[0]) == 1:

        def elements(n: Column, r: Column) -> Column:
            some = F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: static(array[0], F.substr(r, i * WORD + 1, F.lit(WORD))))
            return F.when(n == 0, F.array().cast(T.ArrayType(spark_type(array[0])))).when(n * WORD <= F.length(r), some)

        return _tail(body, offset_word, elements)
    at = _small(offset_word) * 2
    return F.when(at < F.length(body), F.substr(body, at + 1))


def value(param: Param, body: Column, topics: list[Column]) -> Column:
    """The typed value of a parameter; an indexed dynamic value is its hash."""
    size = head_words(param.kind)
    if param.indexed:
        w = strip(topics[param.slot])
        return static(param.kind, w) if size == 1 and not split_array(param.kind) and not param.kind.startswith("(") else F.concat(F.lit("0x"), w)
    w = word(body, param.slot)
    if size is None:
        return _let(body, lambda b: dynamic(param.kind, b, word(b, param.slot)))
    if size != 1 or split_array(param.kind) or param.kind.startswith("("):
        return F.when(F.length(body) >= (param.slot + size) * WORD, F.substring(body, param.slot * WORD + 1, size * WORD))
    return static(param.kind, w)


def values(definition: Definition, body: Column, topics: list[Column], params: tuple[Param, ...] | None = None) -> list[Column]:
    """A column p_<name> for each parameter, and p_<name>_hex (sortable) for unsigned integers that don't fit a long."""
    out = []
    for p in definition.params if params is None else params:
        out.append(value(p, body, topics).alias(p.column))
        if re.fullmatch(r"uint\d+", p.kind) and isinstance(spark_type(p.kind), T.StringType):
            out.append((strip(topics[p.slot]) if p.indexed else word(body, p.slot)).alias(f"{p.column}_hex"))
    return out


def hex_quantity(text: Column) -> Column:
    """0x-hex or decimal text to a long; 0 where it is neither or too large."""
    h = F.ltrim(strip(text), F.lit("0"))
    from_hex = F.when(h == "", F.lit(0)).when(h.rlike("^[0-9a-f]{1,15}$") | h.rlike("^[0-7][0-9a-f]{15}$"), F.conv(F.when(h.rlike("^[0-9a-f]{1,16}$"), h).otherwise("0"), 16, 10).cast("bigint")).otherwise(F.lit(0))
    return F.when(F.lower(text).startswith("0x"), from_hex).when(text.rlike("^[0-9]{1,18}$"), F.expr("0") + text.try_cast("bigint")).otherwise(F.lit(0)).cast("bigint")


def hex_u256(text: Column) -> Column:
    """0x-hex of up to 256 bits to decimal text; other text stays."""
    h = strip(text)
    return F.when(h.rlike("^[0-9a-f]{1,64}$") & F.lower(text).startswith("0x"), wide.to_decimal_text(F.lpad(h, WORD, "0"))).when(F.lower(text) == "0x", F.lit("0")).otherwise(text)


def valid_address(text: Column) -> Column:
    return text.rlike("^(0x)?[0-9a-fA-F]{40}$")


def valid_identifier(text: Column) -> Column:
    return text.rlike("^[A-Za-z_][A-Za-z0-9_]*$") & (F.length(text) <= 63)


def snake_name(param: Param) -> str:
    return param.column.removeprefix("p_")
