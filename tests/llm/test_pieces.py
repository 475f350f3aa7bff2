"""Sampled segmentations: noise by row key, chances against enumeration, units of any length."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from shalebed.llm import pieces

tokenizers = pytest.importorskip("public_tokenizers")
MODEL = tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(MODEL, 0.5)


def texts():
    rng = np.random.default_rng(7)
    letters = list("etaoinshrdlu")
    word = lambda: "".join(rng.choice(letters, rng.integers(1, 11)))
    some = [" ".join(word() for _ in range(rng.integers(0, 40))) for _ in range(40)]
    return [*some, "", " ", "a", "  two  blanks ", "漢字 🙂 \x00 ünï", "x" * 3000, "▁marked", "the cat"]


def flat(got):
    return [(r, tuple(ids.tolist()), lp, score, inc) for _, r, ids, lp, score, inc in got]


@pytest.mark.parametrize("k", range(1, 9))
def test_alone_as_in_any_batch(model, k):
    rows = texts()
    keys = np.arange(len(rows), dtype=np.uint64) + np.uint64(1)
    whole = pieces.sample(model, rows, keys, k)
    back = pieces.sample(pieces.Pieces(MODEL, 0.5), rows[::-1], keys[::-1], k)
    for i, (text, key) in enumerate(zip(rows, keys)):
        mine = flat(x for x in whole if x[0] == i)
        assert mine == flat(pieces.sample(model, [text], np.array([key]), k))
        assert mine == flat(x for x in back if x[0] == len(rows) - 1 - i)
        assert len({m[1] for m in mine}) == len(mine) and [m[0] for m in mine] == list(range(len(mine)))
        assert all(a[3] >= b[3] for a, b in zip(mine, mine[1:]))


def test_any_partitioning(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string")
    runs = [sorted(map(tuple, pieces.sample_segmentations(d, MODEL, 3).collect())) for d in (docs.coalesce(1), docs.repartition(7, F.col("doc_id") % 5), docs.orderBy(F.desc("doc_id")))]
    assert runs[0] == runs[1] == runs[2]
    assert all(r[-1] for r in runs[0])


@pytest.mark.parametrize("k", [2, 3])
def test_tuples_by_chance(model, k):
    text = "tin"
    exact = {tuple(x[2].tolist()): float(np.exp(x[3])) for x in pieces.sample(model, [text], np.array([5], np.uint64), 60)}
    assert abs(sum(exact.values()) - 1) < 1e-6 and 3 <= len(exact) < 60
    n = 20000
    seen: dict = {}
    got = pieces.sample(model, [text] * n, np.arange(n, dtype=np.uint64) + np.uint64(11), k)
    for _, group in itertools.groupby(got, key=lambda x: x[0]):
        key = tuple(tuple(x[2].tolist()) for x in group)
        seen[key] = seen.get(key, 0) + 1
    for draw in itertools.permutations(exact, k):
        p, left = 1.0, 1.0
        for d in draw:
            p, left = p * exact[d] / left, left - exact[d]
        assert abs(seen.get(draw, 0) / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-3


def test_long_unit_chances(model):
    """The scalar way of long units and the other give the same lattice."""
    text = "abcabd" * 30
    short = {x[2].tobytes(): x[3] for x in pieces.sample(model, [text], np.array([3], np.uint64), 8)}
    had, pieces.LONG = pieces.LONG, 8
    try:
        long = {x[2].tobytes(): x[3] for x in pieces.sample(pieces.Pieces(MODEL, 0.5), [text], np.array([3], np.uint64), 8)}
    finally:
        pieces.LONG = had
    assert short.keys() == long.keys() and all(abs(short[x] - long[x]) < 1e-9 for x in short)
