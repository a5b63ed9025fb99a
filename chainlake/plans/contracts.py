"""ABIs, factories, rules and constants that the registered queries use."""

from __future__ import annotations

from chainlake.operators.factory import Factory
from chainlake.operators.filters import Rule
from chainlake.sources.abi import event_registry, find, function_registry

GENESIS = 10000835


def _inputs(text: str, indexed: int = 0) -> list[dict]:
    return [{"type": kind, "name": name, "indexed": i < indexed} for i, (kind, name) in enumerate(part.split() for part in text.split(", "))]


def _event(name: str, inputs: str, indexed: int) -> dict:
    return {"type": "event", "name": name, "inputs": _inputs(inputs, indexed)}


ABIS = {
    "Token": [_event("Transfer", "address from, address to, uint256 value", 2), _event("Approval", "address owner, address spender, uint256 value", 2)],
    "Pair": [
        {"type": "event", "name": "Swap", "inputs": [*_inputs("address sender", 1), *_inputs("uint256 amount0In, uint256 amount1In, uint256 amount0Out, uint256 amount1Out"), *_inputs("address to", 1)]},
        _event("Transfer", "address from, address to, uint256 value", 2),
    ],
    "Board": [_event("Note", "int24 delta, string memo, bytes4 tag, bool flag, uint256[] xs", 0)],
    "Factory": [_event("PairCreated", "address token0, address token1, address pair, uint256 index", 2)],
}
FUNCTION_ABIS = {"Token": [{"type": "function", "name": "transfer", "inputs": _inputs("address to, uint256 amount"), "outputs": [{"type": "bool", "name": ""}]}]}
EVENTS = event_registry(ABIS)
FUNCTIONS = function_registry(FUNCTION_ABIS)
FACTORY_ADDRESS = "0x5c69bee701ef814a2b6a3edd4b1652cb9cc5aa6f"
FACTORIES = [Factory(FACTORY_ADDRESS, find(EVENTS, "Factory", "PairCreated"), ("pair",), "Pair")]
RULES = [
    Rule("Transfer", (("value", "gte", "10000"),)),
    Rule("Approval", (("p_value", "gt", "18446744073709551616"),)),
    Rule("Note", (("delta", "lt", "0"),)),
    Rule("Note", (("memo", "contains", "view-1"), ("nowhere", "eq", "1"))),
]
