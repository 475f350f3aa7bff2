import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shalebed.functions import patterns as P
from shalebed.functions import payloads as Y


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, pattern, want",
    [("key = value", "^(%w+)%s*=", "key"), ("a.b", "%.", "."), ("x[1]", "%[(%d)%]", "1"), ("<<a>>", "<(.-)>", "<a"), ("THE (quick) fox", "%f[%a]%a+%)", "quick)"), ("2024-01", "[^%-]+$", "01"), ("aXb", "%u", "X"), ("abc", "z", None), ("a]b", "[]]", "]"), ("a-b", "[a%-]+", "a-"), ("line\nend", "e.e", "e\ne")],
)
def test_match(spark, text, pattern, want):
    assert one(spark, P.match(F.lit(text), pattern)) == want


def test_other_pattern_functions(spark):
    assert one(spark, P.gmatch(F.lit("a=1, b=2"), "(%w+)=%w+")) == ["a", "b"]
    assert one(spark, P.gsub(F.lit("hello world"), "(%w+) (%w+)", "%2 $%% %1")) == "world $% hello"
    assert tuple(one(spark, P.find(F.lit("abcabc"), "ca"))) == (3, 4)
    assert one(spark, P.find(F.lit("abc"), "z")) is None
    assert [one(spark, P.sub(F.lit("hello"), a, b)) for a, b in ((2, 3), (-3, -1), (0, 2), (4, 2), (-9, 2), (3, 99))] == ["el", "llo", "he", "", "he", "llo"]
    assert one(spark, P.byte(F.lit("A"))) == 65 and one(spark, P.byte(F.lit("A"), 5)) is None
    assert one(spark, P.rep(F.lit("ab"), 3, "-")) == "ab-ab-ab" and one(spark, P.rep(F.lit("ab"), 0)) == ""
    assert one(spark, P.octal_escape(F.lit("a b\\é"))) == r"a\0040b\0134\0303\0251"


@pytest.mark.parametrize("pattern", ["%b()", "()", "%", "[a", "(a)%1"])
def test_refused_patterns(pattern):
    with pytest.raises(ValueError):
        P.to_regex(pattern)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=300), st.integers(0, 700).map(bytes))).map(b"".join), st.sampled_from(["off", "zle", "gzip-9", "zstd-1"]))
def test_codecs_round_trip(data, codec):
    pack, unpack = Y._codec(codec)
    assert unpack(pack(data)) == data


def test_compress_keeps_what_does_not_shrink(spark):
    rows = spark.createDataFrame([(bytes(1000),), (b"ab",), (None,), (b"",)], "p binary").select(Y.compress("p", "zle").alias("c")).collect()
    assert [r["c"]["codec"] if r["c"] else None for r in rows] == ["zle", "off", None, "off"]


def test_keys_and_macs(spark):
    # RFC 5869, first case.
    okm = Y.derive_key(bytes([11] * 22), bytes(range(13)), bytes(range(0xF0, 0xFA)), 42, "sha256")
    assert okm.hex() == "3cb25f25faacd57a90434f64d0362f2a2d2d0a90cf1a5a4c5db02d56ecc4c5bf34007208d5b887185865"
    # RFC 4231, second case.
    assert one(spark, Y.mac(F.lit(b"what do ya want for nothing?"), b"Jefe", "sha256")) == "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"
    key = F.lit(bytes(range(32)))
    sealed = Y.encrypt(F.lit(b"secret"), key, F.lit("row 1"))
    assert one(spark, Y.decrypt(sealed, key, F.lit("row 1"))) == b"secret"
    assert one(spark, Y.decrypt(sealed, key, F.lit("row 2"))) is None


@pytest.mark.parametrize("lost", [[0], [2, 5], [1, 3, 4]])
def test_parity_rebuilds_any_three(lost):
    rng = np.random.default_rng(1)
    cols = {i: rng.integers(0, 256, 40 - i, np.uint8) for i in range(6)}
    rows = Y.parity_rows(cols, 40, 3)
    for ks in ([0, 1, 2], [2, 1, 0])[: 1 + (len(lost) == 3)]:
        got = Y.rebuild({i: c for i, c in cols.items() if i not in lost}, lost, {k: rows[k] for k in ks[: len(lost)]})
        for i in lost:
            assert (got[i][: len(cols[i])] == cols[i]).all() and not got[i][len(cols[i]) :].any()
