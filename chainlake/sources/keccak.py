"""keccak-256, for the few event and function signatures of a registry. Runs on the driver only."""

from __future__ import annotations

_MASK = (1 << 64) - 1


def _constants() -> tuple[list[int], list[list[int]]]:
    """Round constants from the standard's shift register, and rotation offsets from its walk."""
    register, rounds = 1, []
    for _ in range(24):
        value = 0
        for j in range(7):
            value |= (register & 1) << ((1 << j) - 1)
            register = (register << 1) ^ (0x171 if register & 0x80 else 0)
        rounds.append(value)
    turns = [[0] * 5 for _ in range(5)]
    x, y = 1, 0
    for t in range(24):
        turns[x][y] = (t + 1) * (t + 2) // 2 % 64
        x, y = y, (2 * x + 3 * y) % 5
    return rounds, turns


_ROUNDS, _TURNS = _constants()


def _turn(v: int, n: int) -> int:
    return ((v << n) | (v >> (64 - n))) & _MASK if n else v


def _permute(a: list[list[int]]) -> list[list[int]]:
    for constant in _ROUNDS:
        c = [a[x][0] ^ a[x][1] ^ a[x][2] ^ a[x][3] ^ a[x][4] for x in range(5)]
        d = [c[x - 1] ^ _turn(c[(x + 1) % 5], 1) for x in range(5)]
        b = [[0] * 5 for _ in range(5)]
        for x in range(5):
            for y in range(5):
                b[y][(2 * x + 3 * y) % 5] = _turn(a[x][y] ^ d[x], _TURNS[x][y])
        a = [[b[x][y] ^ (~b[(x + 1) % 5][y] & _MASK & b[(x + 2) % 5][y]) for y in range(5)] for x in range(5)]
        a[0][0] ^= constant
    return a


def keccak256(data: bytes) -> str:
    """64 hex digits."""
    rate = 136
    padded = bytearray(data) + bytes(rate - len(data) % rate)
    padded[len(data)] ^= 1
    padded[-1] ^= 0x80
    state = [[0] * 5 for _ in range(5)]
    for block in range(0, len(padded), rate):
        for i in range(rate // 8):
            state[i % 5][i // 5] ^= int.from_bytes(padded[block + 8 * i : block + 8 * i + 8], "little")
        state = _permute(state)
    return b"".join(state[i % 5][i // 5].to_bytes(8, "little") for i in range(4)).hex()
