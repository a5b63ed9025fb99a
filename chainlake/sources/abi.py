"""Contract ABIs to small registries of events and functions, built on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from chainlake.sources.keccak import keccak256


def snake_case(name: str) -> str:
    """An underscore before every capital but a leading one: ERC20 gives e_r_c20."""
    return re.sub(r"(?<!^)([A-Z])", r"_\1", name).lower()


@dataclass(frozen=True)
class Param:
    """slot: the topic's number (1 to 3) if indexed, else the first word of the value in the head."""

    name: str
    kind: str
    indexed: bool
    slot: int

    @property
    def column(self) -> str:
        return f"p_{snake_case(self.name)}"


@dataclass(frozen=True)
class Definition:
    """An event (key: topic0) or a function (key: selector) of one contract."""

    key: str
    contract: str
    name: str
    signature: str
    params: tuple[Param, ...]
    outputs: tuple[Param, ...] = field(default=())
    prefix: str = "event"

    @property
    def table(self) -> str:
        return f"{self.prefix}_{snake_case(self.contract)}_{snake_case(self.name)}"


def canonical(item: dict) -> str:
    """The type as it stands in a signature; tuples are spelt out."""
    kind = item["type"]
    if kind.startswith("tuple"):
        return "(" + ",".join(canonical(c) for c in item.get("components", [])) + ")" + kind[5:]
    return {"uint": "uint256", "int": "int256"}.get(kind, kind)


def split_array(kind: str) -> tuple[str, int | None] | None:
    """(element, length or None for a dynamic array) of an array type, else None."""
    m = re.fullmatch(r"(.*)\[(\d*)\]", kind)
    return (m[1], int(m[2]) if m[2] else None) if m else None


def _members(kind: str) -> list[str]:
    out, depth, now = [], 0, ""
    for c in kind[1:-1]:
        if c == "," and not depth:
            out.append(now)
            now = ""
            continue
        depth += (c == "(") - (c == ")")
        now += c
    return [*out, now] if now else out


def head_words(kind: str) -> int | None:
    """Words that a static value takes in the head; None for a dynamic type."""
    if array := split_array(kind):
        inner = head_words(array[0])
        return None if array[1] is None or inner is None else inner * array[1]
    if kind.startswith("("):
        sizes = [head_words(m) for m in _members(kind)]
        return None if None in sizes else sum(sizes)
    return None if kind in ("string", "bytes") else 1


def _params(items: list[dict], unnamed: str) -> tuple[Param, ...]:
    out, word, topic = [], 0, 0
    for i, item in enumerate(items):
        kind, name = canonical(item), item.get("name") or f"{unnamed}_{i}"
        if item.get("indexed"):
            topic += 1
            out.append(Param(name, kind, True, topic))
        else:
            out.append(Param(name, kind, False, word))
            word += head_words(kind) or 1
    return tuple(out)


def event_registry(abis: dict[str, list[dict]]) -> list[Definition]:
    """Events of every contract, in order; anonymous ones have no topic0 and are left out."""
    out = []
    for contract, abi in abis.items():
        for item in abi:
            if item.get("type") == "event" and not item.get("anonymous"):
                signature = f"{item['name']}({','.join(canonical(i) for i in item['inputs'])})"
                out.append(Definition("0x" + keccak256(signature.encode()), contract, item["name"], signature, _params(item["inputs"], "param")))
    return out


def function_registry(abis: dict[str, list[dict]]) -> list[Definition]:
    """Functions of every contract; unnamed outputs are output_i."""
    out = []
    for contract, abi in abis.items():
        for item in abi:
            if item.get("type") == "function":
                signature = f"{item['name']}({','.join(canonical(i) for i in item.get('inputs', []))})"
                out.append(Definition("0x" + keccak256(signature.encode())[:8], contract, item["name"], signature, _params(item.get("inputs", []), "param"), _params(item.get("outputs", []), "output"), "trace"))
    return out


def find(registry: list[Definition], contract: str, name: str) -> Definition:
    for d in registry:
        if (d.contract, d.name) == (contract, name):
            return d
    raise KeyError(f"{contract}.{name} isn't in the registry")


def resolve_slots(definition: Definition, names: list[str]) -> list[Param]:
    """The named params (ABI or snake-case names); an unknown name is an error."""
    by = {p.name: p for p in definition.params} | {snake_case(p.name): p for p in definition.params}
    return [by[n] for n in names]


SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("key", "contract", "name", "table_name", "signature")] + [T.StructField("ordinal", T.IntegerType())])


def registry_frame(spark: SparkSession, registry: list[Definition]) -> DataFrame:
    """The registry as a small table, to be broadcast: its size is that of the ABIs."""
    return spark.createDataFrame([(d.key, d.contract, d.name, d.table, d.signature, i) for i, d in enumerate(registry)], SCHEMA)
