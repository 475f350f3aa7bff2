"""Hashes and deterministic draws that must come out the same everywhere: 64-bit cyclic redundancy, seeded permutations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the reflected polynomial of the 64-bit cyclic redundancy code.
POLYNOMIAL = 0xC96C5795D7870F42
_ALL = (1 << 64) - 1


def _table() -> np.ndarray:
    row = np.arange(256, dtype=np.uint64)
    for _ in range(8):
        row = np.where(row & np.uint64(1), (row >> np.uint64(1)) ^ np.uint64(POLYNOMIAL), row >> np.uint64(1))
    return row


_TABLE = _table()


def crc64(data: Column | str, salt: int) -> Column:
    """The code of a text's or binary's bytes, begun from a salt, as a long."""

    def run(s: pd.Series) -> pd.Series:
        raw = [None if v is None else v.encode() if isinstance(v, str) else bytes(v) for v in s]
        size = np.array([0 if r is None else len(r) for r in raw])
        order = np.argsort(-size, kind="stable")
        padded = np.zeros((len(raw), int(size.max(initial=0))), np.uint8)
        for i, r in enumerate(raw):
            if r:
                padded[i, : len(r)] = np.frombuffer(r, np.uint8)
        h = np.full(len(raw), salt & _ALL, np.uint64)
        for k in range(padded.shape[1]):  # a step for each place, over all rows that reach it
            live = order[: int(np.searchsorted(-size[order], -k, side="left"))]
            h[live] = (h[live] >> np.uint64(8)) ^ _TABLE[(h[live] & np.uint64(0xFF)).astype(np.int64) ^ padded[live, k]]
        return pd.Series([None if r is None else int(x) for r, x in zip(raw, h.view(np.int64))], dtype="Int64")

    return F.pandas_udf(run, "long")(data)


def _turn(x: int, n: int) -> int:
    return (x << n | x >> (64 - n)) & _ALL


class Draws:
    """A generator of 64-bit numbers with two words of state."""

    def __init__(self, first: int, second: int):
        self.state = first & _ALL, second & _ALL

    def draw(self) -> int:
        a, b = self.state
        out = (_turn((a + b) & _ALL, 17) + a) & _ALL
        b ^= a
        self.state = _turn(a, 49) ^ b ^ (b << 21 & _ALL), _turn(b, 28)
        return out


def first_draw(seed: Column | str, second: int) -> Column:
    """The first number that a seed draws, as a long."""

    def one(v: int) -> int:
        got = Draws(v, second).draw()
        return got - (1 << 64) if got >> 63 else got

    return F.pandas_udf(lambda s: pd.Series([None if pd.isna(v) else one(int(v)) for v in s], dtype="Int64"), "long")(seed)


def permutation(seed: Column | str, second: int, n: int) -> Column:
    """0 to n - 1 in the order that a seed draws: from the last place down, each changes with one at or below it."""

    def one(v: int) -> list[int]:
        draws, out = Draws(v, second), list(range(n))
        for i in range(n - 1, 0, -1):
            k = draws.draw() % (i + 1)
            out[i], out[k] = out[k], out[i]
        return out

    return F.pandas_udf(lambda s: pd.Series([None if pd.isna(v) else one(int(v)) for v in s]), "array<int>")(seed)
