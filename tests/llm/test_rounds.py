"""Vectors that meet in many rounds: the same links, large components by cells, nothing of a round left behind."""

import numpy as np

from shalebed.llm import lattice
from shalebed.llm.common import shared_dir


def test_rounds_find_what_one_finds(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 64))
    x[100:160] = x[100] + 0.02 * rng.standard_normal((60, 64))
    x[200:210] = x[200] + 0.2 * rng.standard_normal((10, 64))
    x = x.astype(np.float32)
    x[299] = x[0]
    m = x.astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    hit = m @ m.T >= 0.9
    np.fill_diagonal(hit, False)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/v")
    monkeypatch.setattr(lattice, "ROUND", 1 << 16)
    monkeypatch.setattr(lattice, "BLOCK", 16)
    folder = spark._jvm.java.io.File(shared_dir(spark).removeprefix("file:"))
    before = set(folder.list())
    got = {r["vec_id"]: r["n_links"] for r in lattice.near_vectors(spark.read.parquet(f"{tmp_path}/v"), how=lattice.SETTINGS[0]).collect()}
    assert [got[i] for i in range(300)] == hit.sum(1).tolist()
    assert not [f for f in set(folder.list()) - before if f.startswith(("cells-", "compared-", "full-"))]
