"""Library operators against plain Python: deep trees, tiers, holes, names, numbers, packed values, streams."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from shalebed import storage
from shalebed.functions import hashes, nested, packed, words
from shalebed.functions import scalars as S
from shalebed.operators import catalog, counters, dedup, hierarchy, history, intervals, objects, replication, snapshots, timeseries
from shalebed.streaming import chain


def test_deep_tree(spark):
    tree = spark.createDataFrame([(i, i - 1 if i else None) for i in range(100)], "id long, parent long")
    got = hierarchy.closure(tree)
    assert got.count() == 100 * 101 // 2
    assert {r["id"]: r["n"] for r in hierarchy.roll_up(tree, tree.select("id"), n="count(*)").collect()} == {i: 100 - i for i in range(100)}
    assert got.where("id = 99").agg(F.max("distance")).first()[0] == 99


def test_loop_in_tree(spark):
    tree = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "id long, parent long")
    with pytest.raises(ValueError):
        hierarchy.closure(tree)
    alone = hierarchy.closure(spark.createDataFrame([(1, None)], "id long, parent long"))
    assert [tuple(r) for r in alone.collect()] == [(1, 1, 0)]


def test_clone_loop(spark):
    rows = [("a", "filesystem", 0, "b@s"), ("a@s", "snapshot", 1, None), ("b", "filesystem", 0, "a@s"), ("b@s", "snapshot", 2, None), ("b/c", "filesystem", 0, None), ("z", "filesystem", 0, None)]
    c = spark.createDataFrame(rows, "name string, kind string, created long, origin string")
    assert sorted(r["name"] for r in catalog.dependents(c, "a").collect()) == ["a@s", "b", "b/c", "b@s"]


def place(samples, keep=256):
    """Tiers as three rings: (time, mark) entries, coarsest first."""
    rings = {name: [] for name, _ in timeseries.TIERS}
    for s, m in samples:
        for name, span in timeseries.TIERS:
            last = rings[name][-1][0] if rings[name] else None
            if last is None or s - last >= span:
                if last == s:
                    if rings[name][-1][1] >= m:
                        break
                    rings[name][-1] = (s, m)
                rings[name].append((s, m))
                break
    return {(n, *e) for n, r in rings.items() for e in r[-keep:]}, rings


def test_tiers(spark):
    rng = random.Random(5)
    for step in (10, 3600, 40000):
        times = sorted(rng.randrange(0, 300 * step) // 7 * 7 for _ in range(400))
        samples = [(t, i * 3 % 1000) for i, t in enumerate(times)]
        samples.sort()
        df = spark.createDataFrame([(1, t, m) for t, m in samples], "k int, s long, m long")
        got = timeseries.tiers(df, ["k"], "s", "m")
        want, rings = place(samples)
        assert {(r["tier"], r["s"], r["m"]) for r in got.collect()} == want
        asked = spark.createDataFrame([(1, t) for t in range(0, 300 * step, 17 * step)], "k int, t long")
        for how, fits in (("floor", lambda e, t: e[0] <= t), ("ceiling", lambda e, t: e[0] >= t)):
            found = {r["t"]: r["m"] for r in timeseries.closest(asked, got, ["k"], "t", "s", "m", how).collect()}
            for t in found:
                hits = []
                for p, (name, _) in enumerate(timeseries.TIERS):
                    some = [e for e in rings[name][-256:] if fits(e, t)]
                    if some:
                        edge = max(e[0] for e in some) if how == "floor" else min(e[0] for e in some)
                        hits.append((abs(edge - t), p, max(e[1] for e in some if e[0] == edge)))
                assert found[t] == (min(hits)[2] if hits else None)


def test_folds(spark):
    rng = random.Random(6)
    rows = [(k, i, rng.randrange(0, 500)) for k in range(5) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, i int, v int")
    got = {(r["k"], r["i"]): r["ewma"] for r in timeseries.moving_average(df, ["k"], ["i"], "v", 4).collect()}
    seconds = spark.createDataFrame([(k, i, i * i % 37 + 10 * i) for k, i, _ in rows], "k int, i int, s int")
    passed = {(r["k"], r["i"]): r["passed"] for r in timeseries.limit_rate(seconds, ["k"], ["i"], "s", 50, 3).collect()}
    for k in range(5):
        now, begin, used = 0, None, 0
        for kk, i, v in rows:
            if kk == k:
                now = max(0, now + int((v - now) / 4))
                assert got[k, i] == now
                s = i * i % 37 + 10 * i
                if begin is None or s - begin >= 50:
                    begin, used = s, 0
                used += 1
                assert passed[k, i] == (used <= 3)


def test_holes_keep_their_place(spark):
    rng = random.Random(7)
    held = {(o, b): bytes(rng.randrange(1, 256) for _ in range(8 if rng.random() < 0.8 else 5)) for o in range(4) for b in range(6) if rng.random() < 0.6}
    df = spark.createDataFrame([(o, b, bytearray(p)) for (o, b), p in held.items()], "object int, blkid int, payload binary")
    for offset, length in ((0, 16), (5, 9), (13, 30), (8, 8), (47, 1)):
        got = {r["object"]: bytes(r["payload"]) for r in objects.read_range(df, 8, offset, length).collect()}
        for o in got:
            whole = b"".join(held.get((o, b), b"").ljust(8, b"\0") for b in range(8))
            assert got[o] == whole[offset : offset + length]
        assert set(got) == {o for o, b in held if offset // 8 <= b <= (offset + length - 1) // 8}


def fault(name):
    """The first fault of a name from the left, as a walk over its components."""
    if len(name.encode()) >= 256:
        return "too long"
    if name[:1] == "/":
        return "leading slash"
    if not name:
        return "empty component"
    at, mark = 0, False
    while True:
        end = at
        while end < len(name) and name[end] not in "/@#":
            end += 1
        part, sep = name[at:end], name[end : end + 1]
        if not sep and name[end - 1] == "/":
            return "trailing slash"
        if re.search(r"[^A-Za-z0-9_.: %-]", part):
            return "invalid character"
        if part in (".", ".."):
            return "self reference" if part == "." else "parent reference"
        if sep in ("@", "#") and sep:
            if mark:
                return "multiple delimiters"
            mark = True
        if not part:
            return "empty component"
        if not sep:
            return None
        if sep == "/" and mark:
            return "trailing slash"
        at = end + 1


def test_name_faults(spark):
    rng = random.Random(8)
    names = ["".join(rng.choice("ab.%/@#é ,") for _ in range(rng.randrange(0, 9))) for _ in range(3000)] + ["a" * 256, "a" * 255]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [(r["n"], r["f"]) for r in df.select("n", S.name_error("n").alias("f")).collect()]
    assert [(n, f, fault(n)) for n, f in got if f != fault(n)] == []
    others = df.sparkSession.createDataFrame([("@x", "a/" * 49 + "a", "a/" * 50 + "a", "mirror", "m1", "1m", "@")], "a string, b string, c string, d string, e string, f string, g string")
    r = others.select(S.valid_name("a", "set"), S.valid_name("b", "depth"), S.valid_name("c", "depth"), S.valid_name("d", "pool"), S.valid_name("e", "pool"), S.valid_name("f", "pool"), S.valid_name("g", "set"), S.valid_name("e", "component")).first()
    assert tuple(r) == (True, True, False, False, True, False, False, True)


def test_numbers(spark):
    cases = {"9007199254740993": 9007199254740993, "0x1F": 31, "1k": 1024, "1.5K": 1536, "7EiB": 7 << 60, "8E": None, "12x": None, "": None, " 3 ": 3, "0xFFFFFFFFFFFFFFFF": -1, "9223372036854775807": 2**63 - 1, "9223372036854775808": None}
    df = spark.createDataFrame(list(cases), "string").toDF("t")
    assert {r["t"]: r["v"] for r in df.select("t", S.parse_size("t").alias("v")).collect()} == cases


def test_escapes(spark):
    df = spark.createDataFrame([("a b\\c,d=e", "/x y\\é\x7f")], "a string, b string")
    r = df.select(S.escape_tag("a").alias("a"), S.escape_path("b").alias("b"), nested.json_string("b").alias("j")).first()
    assert r["a"] == "a\\ b\\\\c\\,d\\=e"
    assert r["b"] == "/x\\0040y\\0134\\0303\\0251\\0177"
    assert r["j"] == '"/x y\\\\\\u00e9\x7f"' and json.loads(r["j"].replace("\x7f", "")) == "/x y\\é"


def test_packed_round_trip(spark):
    values = [{}, {"a": 1, "b": "text é", "c": None, "d": True, "e": -1.5, "f": {"g": {"h": -(2**63)}}, "i": [1, 2, 3], "j": ["x", "yz"], "k": [{"l": 1}, {}], "m": []}]
    for v in values:
        assert packed.unpack_value(packed.pack_value(v)) == v
        assert json.loads(packed.of_token(packed.token_of(json.dumps(v)))) == v
    whole = packed.token_of(json.dumps(values[1]))
    assert packed.of_token(whole[:-2]) is None and packed.of_token("x") is None and packed.of_token(whole.replace("1-", "2-", 1)) is None
    df = spark.createDataFrame([(json.dumps(values[1]),), (None,)], "t string")
    assert [r["v"] and json.loads(r["v"]) for r in df.select(packed.unpack(packed.pack("t")).alias("v")).collect()] == [values[1], None]


def test_serial_and_parallel_chains(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["WRITE", "FREE", "WRITE_BYREF"]), rng.randrange(5), rng.randrange(4), f"p{i}", rng.randrange(5), rng.randrange(4)) for i in range(400)]
    rows = [(*r[:4], None if r[1] != "WRITE" else r[4], *r[5:]) for r in rows]
    df = spark.createDataFrame(rows, "seq long, type string, object long, offset long, payload string, ref_object long, ref_offset long")
    image, last = {}, {}
    for seq, type_, o, f, p, ro, rf in rows:  # one record after another
        if type_ == "WRITE_BYREF":
            if (ro, rf) not in last:
                continue
            p = last[ro, rf]
        if type_ == "WRITE":
            last[o, f] = p
        image[o, f] = None if type_ == "FREE" else p
    want = {(*k, v) for k, v in image.items() if v is not None}
    for parts in (1, 7):
        got = chain.run(df.repartition(parts), chain.resolve_references, chain.apply_writes)
        assert {tuple(r) for r in got.collect()} == want


def test_windows_of_a_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    got = chain.event_counts(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    want = events.groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("start"), "event_type").agg(F.count("*").alias("n"))
    assert {(r["start"], r["event_type"], r["n"]) for r in got.collect()} == {tuple(r) for r in want.collect()}
    closed = chain.sessions(spark, str(tmp_path / "in"), str(tmp_path / "out2"), str(tmp_path / "cp2"), "6 hours")
    assert 0 < closed.agg(F.sum("n")).first()[0] <= events.count()
    assert closed.where("end <= start").count() == 0


def test_ring_of_history(spark):
    rng = random.Random(10)
    rows = [(i * 3, i, "command", "u", "h", "x" * rng.randrange(1, 90)) for i in range(900)]
    df = spark.createDataFrame(rows, "at long, time long, kind string, who string, host string, text string")
    for capacity in (10, 500, 20000, 10**9):
        got = sorted(r["at"] for r in history.append(df.where("at <= 600"), df.where("at > 600"), capacity).collect())
        kept, left = [], capacity
        for r in reversed(rows):
            if len(r[5]) > left:
                break
            left -= len(r[5])
            kept.append(r[0])
        assert got == sorted({*kept, 0})


def test_long_and_short_ranges(spark):
    rng = random.Random(11)
    ranges = [(i, s, s + (10**9 if i == 0 else rng.randrange(1, 50))) for i, s in enumerate(rng.randrange(0, 2000) for _ in range(200))]
    points = [(p,) for p in range(0, 2100, 3)]
    got = intervals.containing(spark.createDataFrame(points, "p long"), spark.createDataFrame(ranges, "i long, lo long, hi long"), [], "p", "lo", "hi")
    assert {(r["p"], r["i"]) for r in got.collect()} == {(p, i) for (p,) in points for i, lo, hi in ranges if lo <= p < hi}


def test_scan_in_steps(spark):
    rng = random.Random(12)
    rows = [(k, rng.randrange(1, 100)) for k in sorted(rng.sample(range(200000), 3000))]
    df = spark.createDataFrame(rows, "k long, size long")
    done, seen, turns = None, [], 0
    while True:
        step, progress = replication.scan_step(df, done, "k", "size", 20000)
        keys = [r["k"] for r in step.collect()]
        seen += sorted(keys)
        p = progress.first()
        turns += 1
        if p["left"] == 0:
            break
        done = p["last"]
    assert seen == [k for k, _ in rows] and turns > 3 and p["percent"] == 100


def test_unique_numbers(spark):
    df = spark.createDataFrame([(f"k{i % 120}",) for i in range(500)], "k string")
    got = counters.unique_numbers(df, "k", 8).collect()
    assert len({r["number"] for r in got}) == len(got) == 120 and all(0 <= r["number"] < 256 for r in got)
    with pytest.raises(ValueError):
        counters.unique_numbers(df, "k", 7)


def test_clone_and_flush_keep_counts(spark):
    files = spark.createDataFrame([(1, b, b * 10) for b in range(5)] + [(2, b, b * 100 + 1) for b in range(3)], "file long, blkid long, block long")
    got = {(r["file"], r["blkid"]): r["block"] for r in dedup.clone_range(files, 1, 1, 2, 2, 3).collect()}
    assert {k: v for k, v in got.items() if k[0] == 2} == {(2, 0): 1, (2, 1): 101, (2, 2): 10, (2, 3): 20, (2, 4): 30}


def test_paths_of_deep_trees(spark):
    objects_ = spark.createDataFrame([(i, i - 1 if i else None, f"d{i}") for i in range(30)], "object long, parent long, name string")
    got = {r["object"]: r["path"] for r in snapshots.paths(objects_).collect()}
    assert got[29] == "/" + "/".join(f"d{i}" for i in range(30)) and got[0] == "/d0"


def test_words(spark):
    df = spark.createDataFrame([("0x1f", "zz", ["b", "a", "c"])], "h string, z string, l array<string>")
    r = df.select(words.to_number("h"), words.to_number("z", 36), words.to_number("z"), words.sort("l", lambda x: F.when(x == "c", 0).otherwise(1)), words.concat("l", "-", 2), words.insert("l", F.lit("e"))).first()
    assert tuple(r) == (31, 35 * 36 + 35, None, ["c", "a", "b"], "a-c", ["b", "a", "c", "e"])


def test_no_shared_folder_on_a_cluster():
    class Context:
        master = "spark://somewhere"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(RuntimeError):
        storage.shared_dir(Session())


def test_cyclic_codes(spark):
    def slow(raw, h):
        for b in raw:
            h ^= b
            for _ in range(8):
                h = h >> 1 ^ (hashes.POLYNOMIAL if h & 1 else 0)
        return h - (1 << 64) if h >> 63 else h

    texts = ["", "a", "longer text é", "x" * 300, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for salt in (1, 0xFEDCBA9876543210):
        got = {r["t"]: r["h"] for r in df.select("t", hashes.crc64("t", salt).alias("h")).collect()}
        assert got == {t: None if t is None else slow(t.encode(), salt) for t in texts}


def test_permutations(spark):
    got = spark.range(200).select(hashes.permutation("id", 99, 6).alias("p")).collect()
    assert all(sorted(r["p"]) == list(range(6)) for r in got) and len({tuple(r["p"]) for r in got}) > 100
