"""Every dealt operator on nulls, empty and long texts, repeated rows, ties, clashing columns and empty tables."""

import hashlib
import zlib

import numpy as np
import pytest

from shalebed.llm import chunks, huffman, imatch, lattice, maxent, minhash, mixing, pieces, quality, suffix

tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, component string, bucket int, size int, word string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(20000))
TEXTS = [(1, "a b c d e f g h i j k l m n o p " * 6), (2, "a b c d e f g h i j k l m n o p " * 6), (3, None), (4, ""), (5, " \n\t "), (6, "two words"), (7, LONG), (8, LONG + " end"), (9, "x"), (9, "x"), (None, "a b c d e f g h i j k l m n o p " * 6), (11, "Ünï çödé — 漢字 🙂 " * 20)]
RUNS = {
    "chunks": chunks.remove_repeated_chunks,
    "maxent": maxent.score_documents,
    "mixing": mixing.mix_sources,
    "imatch": imatch.fingerprints,
    "minhash": minhash.near_duplicates,
    "pieces": lambda d: pieces.sample_segmentations(d, tokenizers.path("piece_bpe_32k.model")),
    "suffix": suffix.remove_repeats,
    "huffman": lambda d: huffman.id_files(d, tokenizers.path("byte_bpe_50k.json"), 2),
}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", None if i == 6 else f"s{(i or 0) % 3}", len(t or ""), 1, "x", 2, 3, "w") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(spark, name):
    assert RUNS[name](frame(spark, [])).count() == 0


def test_quality_edges(spark):
    docs = frame(spark, TEXTS)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (7, 1, None), (9, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    assert quality.score(docs, model).where("score between 0 and 1").count() == len(TEXTS)
    assert quality.keep_good(docs, model, 0.0).columns == docs.columns
    assert quality.score(frame(spark, []), quality.train(docs, labels.limit(0))).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((60, 16))
    near = base[:20] + 0.05 * rng.standard_normal((20, 16))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([base, near, base[:5]]))]
    rows += [(100, None), (101, [0.0] * 16), (102, [float("nan")] * 16), (103, [None] * 16), (104, []), (105, [1.0, 2.0]), (None, rows[0][1])]
    got = {r["vec_id"]: r for r in lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    m = np.array([v for i, v in rows[:85]])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    links = (m @ m.T >= 0.9).sum(1) - 1
    assert [got[i]["n_links"] for i in range(85)] == links.tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(100, 106))
    assert lattice.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_suffix_brute_force(spark):
    rng = np.random.default_rng(3)
    parts = ["".join(rng.choice(list("ab c"), 80)) for _ in range(6)]
    rows = [(i, "".join(parts[k] for k in rng.integers(0, 6, 4)) + "q" * int(rng.integers(0, 60))) for i in range(40)]
    got = {r["doc_id"]: r for r in suffix.remove_repeats(frame(spark, rows)).collect()}
    first = {}
    for i, t in rows:
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], i)
    for i, t in rows:
        gone = {j for k in range(len(t) - 49) if first[t[k : k + 50]] < i for j in range(k, k + 50)}
        kept = "".join(c for k, c in enumerate(t) if k not in gone)
        assert got[i]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()


def test_chunks_survive_insertions(spark):
    rng = np.random.default_rng(4)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(n))
    passage = text(60)
    rows = [(i, f"{text(40)} {passage} {text(30)}") for i in range(5)] + [(9, text(100))]
    got = {r["doc_id"]: r for r in chunks.remove_repeated_chunks(frame(spark, rows)).collect()}
    assert got[0]["spans"] == [] and got[9]["spans"] == []
    assert all(sum(s["end"] - s["start"] for s in got[i]["spans"]) > 100 for i in range(1, 5))


def test_mix(spark):
    rows = [(i, "w " * (10 + i % 7)) for i in range(300)]
    got = mixing.mix_sources(frame(spark, rows)).toPandas()
    assert (got["taken"] <= 3 * got["size"]).all()
    by = got.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((by["taken"] - by["target"]).abs() <= 3 * mixing.BLOCK).all()


def test_huffman_lengths():
    counts = np.array([2**i for i in range(30)])
    lengths = huffman.code_lengths(counts, 8)
    assert lengths.max() <= 8 and sum(2.0 ** -int(n) for n in lengths) <= 1
    ids = np.random.default_rng(0).integers(0, 30, 5000).astype(np.uint32)
    bits, checkpoints = huffman.pack(ids, huffman.canonical(lengths), lengths)
    assert (huffman.unpack(bits, checkpoints, len(ids), *huffman.decode_table(lengths)) == ids).all()


def test_sampling_matches_chances():
    model = pieces.Pieces(tokenizers.path("piece_bpe_32k.model"), 0.5)
    exact = {tuple(x[2].tolist()): np.exp(x[3]) for x in pieces.sample(model, ["the cat"], np.array([5], np.uint64), 60)}
    assert abs(sum(exact.values()) - 1) < 1e-6
    got = [tuple(x[2].tolist()) for x in pieces.sample(model, ["the cat"] * 2000, np.arange(2000, dtype=np.uint64), 1)]
    best = max(exact, key=exact.get)
    assert abs(got.count(best) / 2000 - exact[best]) < 0.05


def test_classifier_held_out():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((4000, 4))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(4000) < 0.02)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.8


def test_language_model_base(spark):
    rows = [(i, f"the cat {i} sat on the mat number {i % 5}") for i in range(60)]
    got = maxent.score_documents(frame(spark, rows)).toPandas().set_index("doc_id")
    known = {}
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for w in [*t.split(), ""]:
                known[w] = known.get(w, 0) + 1
    total = sum(known.values())
    for i, t in rows:
        assert abs(got.loc[i, "base_score"] - sum(np.log10((known.get(w, 0) + 1) / (total + len(known) + 1)) for w in [*t.split(), ""])) < 1e-6
    assert got["score"].sum() > got["base_score"].sum()
