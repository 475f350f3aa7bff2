import random

import pytest
from pyspark.sql import functions as F

from shalebed.functions import values
from shalebed.operators import intervals, listing, logs
from shalebed.sources import text


def test_gather_against_one_pass(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(3), s, s + rng.randrange(1, 30)) for s in (rng.randrange(3000) for _ in range(400))]
    want = []
    for k in range(3):
        now = None
        for _, s, e in sorted(r for r in rows if r[0] == k):
            if now and s - now[1] <= 5 and max(e, now[1]) - now[0] <= 100:
                now[1], now[2] = max(e, now[1]), now[2] + 1
            else:
                now = [s, e, 1]
                want.append((k, now))
    got = logs.gather(spark.createDataFrame(rows, "k int, start long, end long"), ["k"], 5, 100).collect()
    assert sorted(tuple(r) for r in got) == sorted((k, *n) for k, n in want)


def test_replay_against_cells(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice(["ALLOC", "FREE"]), s, s + rng.randrange(1, 40)) for k, s in enumerate(rng.randrange(300) for _ in range(60))]
    cells = {}
    for _, op, s, e in rows:
        cells.update(dict.fromkeys(range(s, e), op))
    got = intervals.replay(spark.createDataFrame([("a", *r) for r in rows], "g string, seq int, op string, start long, end long"), ["g"], "seq", "op").collect()
    assert {x for r in got for x in range(r["start"], r["end"])} == {x for x, op in cells.items() if op == "FREE"}


def test_ring_without_drops_and_empty(spark):
    e = spark.range(1, 11).withColumnRenamed("id", "eid")
    assert [tuple(r) for r in logs.ring_next(e, "eid", 7, 100, 2).collect()] == [(8, 0), (9, 0)]
    assert [tuple(r) for r in logs.ring_next(e, "eid", 2, 3, 9).collect()] == [(8, 5), (9, 5), (10, 5)]
    assert logs.ring_next(e.where("false"), "eid", 2, 3, 9).count() == 0


def test_listing(spark):
    assert listing.expand("a,all,a", ["a", "b"]) == ["a", "b"]
    with pytest.raises(ValueError):
        listing.expand("z", ["a"])
    df = spark.createDataFrame([("x", "fs", 5), ("y", "snap", 9), ("z", "fs", None), ("w", "fs", 7)], "name string, kind string, n int")
    for up, want in ((True, "xwyz"), (False, "wxyz")):
        assert "".join(r["name"] for r in df.orderBy(*listing.order([("n", up)], {"n": F.col("kind") == "fs"})).collect()) == want
    got = [r["value"] for r in listing.lines(df, ["name", "n"], listing.order([("n", True)]), numeric=("n",)).orderBy("line").collect()]
    assert got == ["NAME  N", "x     5", "w     7", "y     9", "z     -"]
    assert listing.lines(df, ["name", "n"], [F.col("name")], script=True).orderBy("line").first()["value"] == "w\t7"


def test_counter_tables(spark, tmp_path):
    (tmp_path / "a").write_text("13 1 0x01\nname type data\nhits 4 123\nmisses 4 7\n\nodd 7 text\n")
    (tmp_path / "b").write_text("13 1 0x01\ntype name data extra\n4 hits 9 z\n4 short\n")
    got = text.named_counters(spark, str(tmp_path)).select("name", "value").collect()
    assert sorted((r["name"], r["value"]) for r in got if r["value"] is not None) == [("hits", 9), ("hits", 123), ("misses", 7)]
    assert len(got) == 5


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a b", None, 5)], "t string, u string, f int")
    text.write_tabs(df, str(tmp_path / "tabs"), ["t", "u", "f"])
    assert spark.read.text(str(tmp_path / "tabs")).first()["value"] == "a b\t-\t5"
    text.write_lines(df, str(tmp_path / "lines"), "m", ["t", "u"], ["f"], F.timestamp_seconds(F.lit(2)))
    assert spark.read.text(str(tmp_path / "lines")).first()["value"] == "m,t=a\\ b f=5u 2000000000"
    writes = spark.createDataFrame([(0, b"ab"), (10, b"cd")], "offset long, payload binary")
    text.write_image(writes, str(tmp_path / "image"), 16)
    assert (tmp_path / "image").read_bytes() == b"ab" + bytes(8) + b"cd" + bytes(4)


def test_values(spark):
    df = spark.createDataFrame([('{"a": {"b": [1, 2, {"c": "x"}]}}', "éSs"), ("not json", None)], "j string, t string")
    got = df.select(values.at_path("j", "a.b[2].c", "string").alias("c"), values.at_path("j", "a.b[2].c", "int").alias("n"), values.normalize("t").alias("nfc"), values.normalize("t", fold=True).alias("fold")).collect()
    assert [tuple(r) for r in got] == [("x", None, "éSs", "éss"), (None, None, None, None)]
