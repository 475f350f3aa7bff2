"""Lattice cells: recall of every setting, the share of pairs compared, links against brute force."""

import duckdb
import numpy as np
import pytest

from shalebed.llm import lattice


def unit(rng, n, d=64):
    x = rng.standard_normal((n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def meet(a, b):
    return (a[:, :, None] == b[:, None, :]).any((1, 2))


@pytest.mark.parametrize("how", lattice.SETTINGS, ids=str)
def test_recall(how):
    rng = np.random.default_rng(2)
    n, missed = 4000 if how.points < 4 else 1000, 0
    x = unit(rng, n)
    z = unit(rng, n)
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * z / np.linalg.norm(z, axis=1, keepdims=True)
    a, b = (np.sort(lattice.cells(v, how), axis=1) for v in (x, y))
    for i in range(n):
        missed += not len(np.intersect1d(a[i], b[i]))
    assert missed <= 2


def test_share_of_pairs_falls():
    rng = np.random.default_rng(3)
    shares = []
    for n in (2000, 8000, 32000, 200000):
        how = lattice.setting(n)
        a, b = unit(rng, 3000), unit(rng, 3000)
        k, l = lattice.cells(a, how), lattice.cells(b, how)
        shares.append(np.mean([len(np.intersect1d(x, y)) > 0 for x, y in zip(k, l)]))
    assert shares[0] > 2 * shares[1]
    assert shares[1] > 2 * shares[3] and lattice.setting(10**9).share * 100 < lattice.setting(10**6).share * 2


@pytest.mark.parametrize("how", [None, lattice.SETTINGS[2], lattice.SETTINGS[3]], ids=str)
def test_links_of_all_rows(spark, how):
    sf = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"select vec_id, embedding from '{sf}/embeddings.parquet' order by vec_id").fetchall()
    m = np.array([r[1] for r in rows], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    hit = m @ m.T >= 0.9
    np.fill_diagonal(hit, False)
    label = np.arange(len(rows))
    while True:
        new = np.array([min(label[i], label[np.flatnonzero(hit[i])].min(initial=label[i])) for i in range(len(rows))])
        if (new == label).all():
            break
        label = new
    got = {r["vec_id"]: r for r in lattice.near_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"), how=how).collect()}
    assert [got[r[0]]["n_links"] for r in rows] == hit.sum(1).tolist()
    assert [got[r[0]]["component_id"] for r in rows] == [rows[k][0] for k in label]
