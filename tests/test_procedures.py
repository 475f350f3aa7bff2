import pytest

from shalebed.operators import catalog as C
from shalebed.operators import procedures as P
from shalebed.streaming import events as E

ROWS = [("t", "filesystem", 0, None), ("t/a", "filesystem", 0, None), ("t/a@1", "snapshot", 1, None), ("t/a@2", "snapshot", 2, None), ("t/c", "filesystem", 3, "t/a@1"), ("t/a#b", "bookmark", 1, None)]


@pytest.fixture(scope="module")
def state(spark):
    return spark.createDataFrame(ROWS, "name string, kind string, created long, origin string"), spark.createDataFrame([("t/a@2", "keep")], "name string, tag string")


def names(df):
    return sorted(r["name"] for r in df.collect())


def test_steps_in_a_row(state):
    c, h = state
    got = {r["name"]: r["origin"] for r in P.run(c, h, [("promote", "t/c"), ("snapshot", "t/c", {"tag": "3", "at": 5}), ("clone", "t/c@3", "t/d", 6), ("rename", "t/a", "t/b")]).collect()}
    assert got == {"t": None, "t/b": "t/c@1", "t/b@2": None, "t/c": None, "t/c@1": None, "t/c@3": None, "t/d": "t/c@3", "t/b#b": None}


@pytest.mark.parametrize(
    "steps, why",
    [([("destroy", "t/a@1")], "destroy t/a@1: cloned"), ([("destroy", "t/a@2")], "destroy t/a@2: held"), ([("destroy", "x")], "destroy x: missing"), ([("destroy", "t")], "destroy t: has children"), ([("clone", "t/a", "t/x", 1)], "clone: t/a is filesystem"), ([("rename", "t/a", "t/c")], "rename: t/c is filesystem"), ([("destroy", "t/c"), ("destroy", "t/a@1")], None)],
)
def test_dry_run(state, steps, why):
    c, h = state
    assert P.check(c, h, steps) == why
    assert names(c) == sorted(r[0] for r in ROWS)


@pytest.mark.parametrize("step", [("no",), ("promote",), ("promote", "a", "b"), ("promote", "a", {"name": "b"}), ("promote", {"x": 1})])
def test_arguments(state, step):
    with pytest.raises(ValueError):
        P.run(*state, [step])


def test_views(state, spark):
    c, _ = state
    assert names(C.dependents(c, "t/a")) == ["t/a#b", "t/a@1", "t/a@2", "t/c"]
    assert names(C.rollback(c, "t/a@1")) == ["t", "t/a", "t/a#b", "t/a@1", "t/c"]
    assert names(C.snapshot_span(c, "t/a@%1")) == ["t/a@1"] and names(C.snapshot_span(c, "t/a@9")) == []
    assert names(C.bookmark(c, "t/a@2", "z").where("kind = 'bookmark'")) == ["t/a#b", "t/a#z"]
    assert names(C.visible(c.unionByName(spark.createDataFrame([("t/$x", "filesystem", 0, None)], c.schema)))) == names(c)
    assert C.children(c.where("false"), "t").count() == 0


def test_dispatch(spark, tmp_path):
    spark.createDataFrame([(1, "io.error"), (2, "scrub"), (3, "error")], "eid int, class string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("eid int, class string").parquet(str(tmp_path / "in"))
    seen = {}
    handlers = {n: (lambda df, k, n=n: seen.setdefault(n, []).extend(r["eid"] for r in df.collect())) for n in ("all-log", "error-mail", "scrub-done")}
    E.dispatch(stream, handlers, "class", str(tmp_path / "check")).awaitTermination()
    assert {k: sorted(v) for k, v in seen.items()} == {"all-log": [1, 2, 3], "error-mail": [1, 3], "scrub-done": [2]}


def test_replay_once(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, seq int")
    assert sorted(map(tuple, E.replay_once(rows, rows.where("seq = 1 and k = 'a'"), "seq", ["k"]).collect())) == [("a", 2), ("b", 1)]
