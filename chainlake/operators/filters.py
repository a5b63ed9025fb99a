"""Event filters: rules compiled to one boolean Column for each event."""

from __future__ import annotations

import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainlake.functions.wide import in_hex, integer_key, order_key
from chainlake.sources.abi import snake_case


@dataclass(frozen=True)
class Rule:
    """conditions: (field, op, value), all of which must hold; contract None is any contract."""

    event: str
    conditions: tuple[tuple[str, str, str], ...]
    contract: str | None = None


OPS = {
    "eq": operator.eq, "neq": operator.ne, "gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le,
}


#: Integers that fit a long, and are compared as such.
SHORT = r"^-?[0-9]{1,18}\z"


def compare(text: Column, op: str, value: str) -> Column:
    """Integers, of any size, as numbers; other text by bytes; unknown ops pass."""
    if op == "contains":
        return text.contains(value)
    if op not in OPS:
        return F.lit(True)
    key = integer_key(value)
    if key is None:
        return OPS[op](text, F.lit(value))
    pair = lambda t: F.struct(order_key(t).alias("number"), t.alias("text"))
    held = lambda p: F.when(p["number"].isNotNull(), OPS[op](p["number"], F.lit(key))).otherwise(OPS[op](p["text"], F.lit(value)))
    any_size = lambda t: F.transform(F.array(pair(t)), held).getItem(0)
    if abs(int(value)) < 10**18:
        return F.transform(F.array(text), lambda t: F.when(t.rlike(SHORT), OPS[op](t.cast("bigint"), F.lit(int(value)))).otherwise(any_size(t))).getItem(0)
    return any_size(text)  # a decoded value is computed once


def compare_hex(hex64: Column, op: str, value: int) -> Column:
    """An unsigned integer by its 64 hex digits, which sort as the numbers do."""
    if (constant := in_hex(value)) is not None:
        return OPS[op](hex64, F.lit(constant))
    return F.when(hex64.isNotNull(), F.lit(bool(OPS[op](0, value))))


def field(name: str, columns: list[str]) -> str | None:
    """The column of an ABI name or snake-case name, with or without p_."""
    return next((c for c in (name, f"p_{name}", f"p_{snake_case(name)}", snake_case(name)) if c in columns), None)


def condition(rules: list[Rule], contract: str, event: str, columns: list[str]) -> Column:
    """True where some rule of the event holds; without rules, and for null or absent fields, true."""
    own = [r for r in rules if r.event == event and r.contract in (None, contract)]
    if not own:
        return F.lit(True)
    out = F.lit(False)
    for r in own:
        holds = F.lit(True)
        for name, op, value in r.conditions:
            c = field(name, columns)
            if c and f"{c}_hex" in columns and op in OPS and integer_key(value):
                holds = holds & F.coalesce(compare_hex(F.col(f"{c}_hex"), op, int(value)), F.lit(True))
            elif c:
                holds = holds & F.coalesce(compare(F.col(c).cast("string"), op, value), F.lit(True))
        out = out | holds
    return out


def apply_filters(decoded: DataFrame, rules: list[Rule], contract: str, event: str) -> DataFrame:
    """Rows of an event's table that its rules let through."""
    return decoded.where(condition(rules, contract, event, decoded.columns))
