"""Large buckets that hold many components, against all pairs."""

import numpy as np

from shalebed.llm import minhash
from tests.llm.test_edges import frame
from tests.llm.test_pipeline import shingles


def test_large_open_buckets(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = np.random.default_rng(17)
    base = [f"t{i}" for i in range(60)]  # a template that all share
    texts = []
    for i in range(60):
        own = [f"o{i}x{k}" for k in range(int(rng.integers(0, 30)))]
        texts.append(base + own)
        for _ in range(int(rng.integers(0, 3))):
            near = list(texts[-1])
            near[int(rng.integers(0, len(near)))] = f"z{rng.integers(0, 5)}"
            texts.append(near)
    rows = [(int(i), " ".join(t)) for i, t in zip(rng.permutation(len(texts)), texts)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    sets = {i: shingles(t) for i, t in rows}
    group = {i: i for i in sets}
    while True:
        before = dict(group)
        for i in sets:
            for j in sets:
                if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                    group[i] = group[j] = min(group[i], group[j])
        if before == group:
            break
    assert got == group
    assert 1 < len(set(group.values())) < len(rows)


def test_rare_shingles_hold_every_link(spark):
    """Pairs at the threshold share a bucket of the rarest shingles."""
    rng = np.random.default_rng(18)
    words = [np.sort(rng.choice(2**40, 100, replace=False)) for _ in range(30)]
    sets = {}
    for i, w in enumerate(words):
        sets[2 * i] = w
        other = w.copy()
        n = int(rng.integers(0, 9))
        other[rng.choice(100, n, replace=False)] = rng.choice(2**40, n) + 2**41
        sets[2 * i + 1] = np.sort(other)
    for i in sets:
        sets[i][: int(rng.integers(0, 3))] = 7  # what many share
        sets[i] = np.unique(sets[i])
    rows = spark.createDataFrame([(i, bytearray(v.astype(np.uint64).tobytes())) for i, v in sets.items()], "id long, hashes binary")
    members = rows.select("id", rows["id"].alias("component"))
    held = {}
    for r in minhash._prefixes(members, rows, 85).collect():
        held.setdefault(r["key"], set()).add(r["id"])
    for i in sets:
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                assert any({i, j} <= ids for ids in held.values())


def test_one_id_with_several_texts(spark):
    words = [f"w{i}" for i in range(40)]
    other = [f"v{i}" for i in range(40)]
    rows = [(5, " ".join(words)), (5, " ".join(other)), (3, " ".join([*words, "end"])), (9, " ".join(["begin", *other])), (None, " ".join(words)), (7, " ".join(other)), (7, " ".join(other))]
    got = sorted(map(tuple, minhash.near_duplicates(frame(spark, rows)).collect()), key=repr)
    n = 36
    assert got == sorted([(5, n, 3, False), (5, n, 5, True), (3, n + 1, 3, True), (9, n + 1, 5, False), (None, n, None, False), (7, n, 5, False), (7, n, 5, False)], key=repr)
