"""Exact 256-bit integers as Column expressions.

A value is 64 lower hex digits (which sort as the numbers do) or decimal text. Arithmetic works on
limbs of 32 bits held as BIGINT, most significant first, so every step stays below 2**63.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE = 1_000_000_000
MASK = (1 << 32) - 1
LARGEST_38 = f"{10**38 - 1:064x}"


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body).getItem(0)


def limb(hex64: Column, i: int) -> Column:
    """The i-th of eight 32-bit limbs, from the left."""
    return F.conv(F.substring(hex64, 8 * i + 1, 8), 16, 10).cast("bigint")


def limbs(hex64: Column) -> Column:
    return F.array(*[limb(hex64, i) for i in range(8)])


def _carried(big: Column, plus: int = 0) -> Column:
    """Limbs below 2**32, with one more in front, of limbs that may be larger."""
    start = F.struct(F.lit(plus).cast("bigint").alias("carry"), F.array().cast("array<bigint>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        total = x + a["carry"]
        return F.struct(F.shiftright(total, 32).alias("carry"), F.concat(F.array(total.bitwiseAND(F.lit(MASK))), a["out"]).alias("out"))

    return _let(F.aggregate(F.reverse(big), start, step), lambda s: F.concat(F.array(s["carry"]), s["out"]))


def _groups(small: Column) -> Column:
    """Base-1e9 digits, least significant first, of limbs below 2**32."""
    zeros = F.array_repeat(F.lit(0).cast("bigint"), 11)

    def add(digits: Column, x: Column) -> Column:
        start = F.struct(x.alias("carry"), F.array().cast("array<bigint>").alias("out"))

        def step(a: Column, d: Column) -> Column:
            total = d * F.lit(1 << 32) + a["carry"]
            return F.struct(F.call_function("div", total, F.lit(BASE)).alias("carry"), F.array_append(a["out"], total % BASE).alias("out"))

        return F.aggregate(digits, start, step, lambda a: a["out"])

    return F.aggregate(small, zeros, add)


def _text(groups: Column) -> Column:
    joined = F.array_join(F.transform(F.reverse(groups), lambda g: F.lpad(g.cast("string"), 9, "0")), "")
    return _let(F.ltrim(joined, F.lit("0")), lambda s: F.when(s == "", F.lit("0")).otherwise(s))


def to_decimal_text(hex64: Column) -> Column:
    """Decimal text of 64 hex digits; values below 2**64, and below 10**38, take shorter ways."""
    half = lambda at: F.conv(F.substring(hex64, at, 16), 16, 10).cast("decimal(20,0)")
    medium = (half(33) * F.lit(str(1 << 64)).cast("decimal(20,0)")).cast("decimal(38,0)") + half(49)
    short = F.when(F.substring(hex64, 1, 48) == "0" * 48, F.conv(F.substring(hex64, 49, 16), 16, 10))
    return short.when(hex64 <= LARGEST_38, medium.cast("string")).when(hex64.isNotNull(), _text(_groups(limbs(hex64))))


def negated_text(hex64: Column) -> Column:
    """Decimal text of 2**256 - value: the magnitude of a negative two's complement number."""
    turned = F.translate(hex64, "0123456789abcdef", "fedcba9876543210")
    return _text(_groups(_carried(limbs(turned), 1)))


def signed_text(hex64: Column) -> Column:
    return F.when(F.substring(hex64, 1, 1) >= "8", F.concat(F.lit("-"), negated_text(hex64))).otherwise(to_decimal_text(hex64))


def in_hex(value: int) -> str | None:
    """The 64 hex digits of a constant that has them."""
    return f"{value:064x}" if 0 <= value < 1 << 256 else None


def wide_sum(hex64: Column) -> Column:
    """Aggregate: decimal text of the exact sum, null over no rows. Partial sums per limb; up to 2**31 rows."""
    sums = [F.sum(limb(hex64, i)) for i in range(8)]
    return F.when(sums[0].isNotNull(), _text(_groups(_carried(F.array(*sums)))))


def wide_avg(hex64: Column) -> Column:
    """Aggregate: the average, rounded down, as decimal text."""
    n = F.count(hex64)
    sums = _groups(_carried(F.array(*[F.coalesce(F.sum(limb(hex64, i)), F.lit(0)) for i in range(8)])))
    start = F.struct(F.lit(0).cast("bigint").alias("rest"), F.array().cast("array<bigint>").alias("out"))

    def step(n: Column):
        def one(a: Column, d: Column) -> Column:
            t = a["rest"] * BASE + d
            return F.struct((t % n).alias("rest"), F.concat(F.array(F.call_function("div", t, n)), a["out"]).alias("out"))

        return one

    return F.when(n > 0, _let(F.greatest(n, F.lit(1)), lambda m: _text(F.aggregate(F.reverse(sums), start, step(m), lambda a: a["out"]))))


def wide_min(hex64: Column) -> Column:
    return to_decimal_text(F.min(hex64))


def wide_max(hex64: Column) -> Column:
    return to_decimal_text(F.max(hex64))


def fits38(hex64: Column) -> Column:
    """DECIMAL(38, 0), or null where the value has more digits."""
    return F.when(hex64 <= LARGEST_38, to_decimal_text(hex64).cast("decimal(38,0)"))


def order_key(text: Column) -> Column:
    """Text that sorts as the integers in decimal text do; null where the text is no integer."""

    def of(t: Column) -> Column:
        return _let(F.ltrim(F.ltrim(t, F.lit("+-")), F.lit("0")), lambda body: F.when(t.startswith("-") & (body != ""), _down(body)).otherwise(F.concat(F.lit("1"), F.lpad(F.length(body).cast("string"), 4, "0"), body)))

    return _let(text, lambda t: F.when(t.rlike(r"^[+-]?[0-9]+$"), of(t)))


def _down(body: Column) -> Column:
    return F.concat(F.lit("0"), F.lpad((F.lit(9999) - F.length(body)).cast("string"), 4, "0"), F.translate(body, "0123456789", "9876543210"))


def integer_key(text: str) -> str | None:
    """order_key of a constant."""
    if not re.fullmatch(r"[+-]?[0-9]+", text):
        return None
    body = re.sub("^[+-]", "", text).lstrip("0")
    if text.startswith("-") and body:
        return "0" + f"{9999 - len(body):04d}" + body.translate(str.maketrans("0123456789", "9876543210"))
    return "1" + f"{len(body):04d}" + body
