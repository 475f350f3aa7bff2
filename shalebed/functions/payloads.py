"""Functions of binary payloads: combinable checksums, codecs, keyed digests and parity over GF(2^8)."""

from __future__ import annotations

import hashlib
import hmac
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Sums = tuple[int, int, int, int]
ZERO: Sums = (0, 0, 0, 0)
_WRAP = 1 << 64


def fletcher4_update(sums: Sums, data: bytes, order: str = "<") -> Sums:
    """Four running sums over 32-bit words, each of the one before it, modulo 2^64. Short data is filled with zeros."""
    line = np.frombuffer(data + bytes(-len(data) % 4), order + "u4").astype(np.uint64)
    if not len(line):
        return sums
    out = []
    for start in sums:
        line = np.cumsum(line, dtype=np.uint64) + np.uint64(start)
        out.append(int(line[-1]))
    return tuple(out)


def fletcher4_combine(left: Sums, right: Sums, words: int) -> Sums:
    """The sums of two pieces in a row, from the sums of each alone and the words of the right one."""
    n = words
    weight = (1, n, n * (n + 1) // 2, n * (n + 1) * (n + 2) // 6)
    return tuple((right[k] + sum(weight[k - j] * left[j] for j in range(k + 1))) % _WRAP for k in range(4))


def fletcher4(data: Column | str) -> Column:
    """struct(a, b, c, d), the decimal sums of a payload; null where it is null."""

    @F.pandas_udf("struct<a:string,b:string,c:string,d:string>")
    def run(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None,) * 4 if v is None else tuple(map(str, fletcher4_update(ZERO, v))) for v in x], columns=list("abcd"))

    return run(data)


def _zero_runs(data: bytes, most: int = 64) -> bytes:
    """Runs as a length byte: below `most` literals follow (length + 1 of them), from there on (length - most + 1) zeros."""
    raw = np.frombuffer(data, np.uint8)
    zero = raw == 0
    cut = np.flatnonzero(np.diff(zero)) + 1
    out = bytearray()
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(raw)]):
        if zero[a : a + 1].any():
            for at in range(a, b, 256 - most):
                out.append(most + min(256 - most, b - at) - 1)
        else:
            for at in range(a, b, most):
                part = data[at : min(b, at + most)]
                out.append(len(part) - 1)
                out += part
    return bytes(out)


def _zero_runs_back(data: bytes, most: int = 64) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        at += 1
        if n < most:
            out += data[at : at + n + 1]
            at += n + 1
        else:
            out += bytes(n - most + 1)
    return bytes(out)


def _codec(name: str):
    """Packing and unpacking by name: off, zle, gzip-1 to gzip-9, zstd-1 to zstd-19."""
    kind, _, level = name.partition("-")
    if kind == "off":
        return bytes, bytes
    if kind == "zle":
        return _zero_runs, _zero_runs_back
    if kind == "gzip":
        return lambda x: zlib.compress(x, int(level or 6)), zlib.decompress
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=int(level or 3)).compress, zstandard.ZstdDecompressor().decompress
    raise ValueError(f"no codec {name}")


def compress(data: Column | str, codec: str, saving: int = 8) -> Column:
    """struct(codec, payload): packed if that saves at least one part in `saving`, else codec off and the payload as it is."""

    @F.pandas_udf("struct<codec:string,payload:binary>")
    def run(x: pd.Series) -> pd.DataFrame:
        pack = _codec(codec)[0]
        rows = []
        for v in x:
            p = None if v is None else pack(v)
            rows.append((None, None) if v is None else (codec, p) if len(p) <= len(v) - len(v) // saving and len(p) < len(v) else ("off", v))
        return pd.DataFrame(rows, columns=["codec", "payload"])

    return run(data)


def decompress(codec: Column | str, data: Column | str) -> Column:
    """The payload back, each row by its own codec."""

    @F.pandas_udf("binary")
    def run(name: pd.Series, x: pd.Series) -> pd.Series:
        known = {c: _codec(c)[1] for c in name.dropna().unique()}
        return pd.Series([None if c is None or v is None else known[c](v) for c, v in zip(name, x)], dtype=object)

    return run(codec, data)


def mac(data: Column | str, key: bytes, algorithm: str = "sha512") -> Column:
    """Hexadecimal HMAC of a payload."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else hmac.new(key, v, algorithm).hexdigest() for v in x], dtype=object)

    return run(data)


def derive_key(secret: bytes, salt: bytes, info: bytes, size: int, algorithm: str = "sha512") -> bytes:
    """HKDF of RFC 5869."""
    width = hashlib.new(algorithm).digest_size
    root = hmac.new(salt or bytes(width), secret, algorithm).digest()
    out = block = b""
    for i in range(-(-size // width)):
        block = hmac.new(root, block + info + bytes([i + 1]), algorithm).digest()
        out += block
    return out[:size]


def encrypt(data: Column | str, key: Column, aad: Column | str | None = None) -> Column:
    """AES-GCM with a fresh initial vector in front, by Spark's own function."""
    return F.aes_encrypt(data, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(""), aad if aad is not None else F.lit(""))


def decrypt(data: Column | str, key: Column, aad: Column | str | None = None) -> Column:
    """Null where the tag does not fit."""
    return F.try_aes_decrypt(data, key, F.lit("GCM"), F.lit("DEFAULT"), aad if aad is not None else F.lit(""))


def _tables(modulus: int = 0x11D) -> tuple[np.ndarray, np.ndarray]:
    """Powers of 2 in GF(2^8) and their logarithms."""
    power, x = np.zeros(510, np.uint8), 1
    for i in range(255):
        power[i] = power[i + 255] = x
        x = x << 1 ^ (modulus if x >= 128 else 0)
    log = np.zeros(256, np.int64)
    log[power[:255]] = np.arange(255)
    return power, log


_POWER, _LOG = _tables()


def times(scalar: int, data: np.ndarray) -> np.ndarray:
    """Products in GF(2^8)."""
    return np.where(data == 0, 0, _POWER[_LOG[data] + _LOG[scalar]]).astype(np.uint8) if scalar else np.zeros_like(data)


def parity_rows(columns: dict[int, np.ndarray], width: int, count: int) -> np.ndarray:
    """count parities of columns padded to width; parity k weighs column i with 2^(i*k)."""
    out = np.zeros((count, width), np.uint8)
    for i, data in columns.items():
        for k in range(count):
            out[k, : len(data)] ^= times(int(_POWER[i * k % 255]), data)
    return out


def rebuild(known: dict[int, np.ndarray], lost: list[int], parities: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Lost columns from the known ones and as many parities, by elimination in GF(2^8)."""
    ks = sorted(parities)[: len(lost)]
    if len(ks) < len(lost):
        raise ValueError("fewer parities than lost columns")
    width = len(parities[ks[0]]) if ks else 0
    have = parity_rows(known, width, max(ks, default=-1) + 1)
    right = [parities[k] ^ have[k] for k in ks]
    left = [[int(_POWER[i * k % 255]) for i in lost] for k in ks]
    for c in range(len(lost)):
        p = next(r for r in range(c, len(lost)) if left[r][c])
        left[c], left[p], right[c], right[p] = left[p], left[c], right[p], right[c]
        inverse = int(_POWER[(255 - _LOG[left[c][c]]) % 255])
        left[c] = [int(x) for x in times(inverse, np.array(left[c], np.uint8))]
        right[c] = times(inverse, right[c])
        for r in range(len(lost)):
            if r != c and left[r][c]:
                f = left[r][c]
                left[r] = [a ^ int(b) for a, b in zip(left[r], times(f, np.array(left[c], np.uint8)))]
                right[r] = right[r] ^ times(f, right[c])
    return dict(zip(lost, right))


def parity(df: DataFrame, stripe: str, column: str, payload: str, count: int = 3) -> DataFrame:
    """stripe, parity (0 to count - 1) and payload for stripes of numbered columns (below 255, each once)."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        cols = {int(i): np.frombuffer(x or b"", np.uint8) for i, x in zip(t[column], t[payload])}
        rows = parity_rows(cols, max(map(len, cols.values())), count)
        return pd.DataFrame({stripe: t[stripe].iloc[0], "parity": range(count), payload: [r.tobytes() for r in rows]})

    return df.select(stripe, column, payload).groupBy(stripe).applyInPandas(run, f"{stripe} {dict(df.dtypes)[stripe]}, parity int, {payload} binary")


def reconstruct(df: DataFrame, parities: DataFrame, wanted: DataFrame, stripe: str, column: str, payload: str) -> DataFrame:
    """wanted (stripe, column) with the payload rebuilt, filled with zeros to the stripe's width; df has the columns that are left."""
    kind = dict(df.dtypes)
    every = df.select(stripe, F.col(column).cast("int").alias("_n"), payload, F.lit("d").alias("_k")).unionByName(parities.select(stripe, F.col("parity").alias("_n"), payload, F.lit("p").alias("_k")))
    every = every.unionByName(wanted.select(stripe, F.col(column).cast("int").alias("_n"), F.lit(None).cast("binary").alias(payload), F.lit("w").alias("_k")))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        part = {k: {int(n): np.frombuffer(x or b"", np.uint8) for n, x in zip(g["_n"], g[payload])} for k, g in t.groupby("_k")}
        got = rebuild(part.get("d", {}), sorted(part.get("w", {})), part.get("p", {}))
        return pd.DataFrame({stripe: [t[stripe].iloc[0]] * len(got), column: list(got), payload: [x.tobytes() for x in got.values()]}).astype({column: "int32"})

    return every.groupBy(stripe).applyInPandas(run, f"{stripe} {kind[stripe]}, {column} int, {payload} binary")
