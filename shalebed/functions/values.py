"""Unicode forms, nested values and deterministic pseudo-random numbers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(x: Column | str, form: str = "NFC", fold: bool = False) -> Column:
    """Text in a normal form, with fold also in lower case as comparison needs it."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(v):
            if v is None or v.isascii():
                return v.lower() if v and fold else v
            return unicodedata.normalize(form, unicodedata.normalize(form, v).casefold() if fold else v)

        return pd.Series([one(v) for v in s], dtype=object)

    return run(x)


def at_path(json: Column | str, path: str, kind: str) -> Column:
    """The value at a path such as a.b[2].c, as a type; null if it is not there or not of that type."""
    return F.try_variant_get(F.try_parse_json(json), "$." + path, kind)


def pick(seed: Column | str, salt: int, below: int) -> Column:
    """A number from 0 to below - 1 that depends on the seed and the salt alone."""
    return F.pmod(F.xxhash64(seed, F.lit(salt)), F.lit(below))
