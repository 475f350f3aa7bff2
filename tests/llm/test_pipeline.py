"""Each stage of the pipeline against brute force, with null and repeated ids, and on an empty table."""

import re

import numpy as np
import pytest

from shalebed.llm import mixing, quality
from tests.llm.test_edges import SCHEMA, frame

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return sorted(((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in df.collect()), key=repr)


def corpus():
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [list(rng.choice(vocabulary, rng.integers(12, 60))) for _ in range(25)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i in range(25):
        near = list(base[i])
        for k in rng.integers(0, len(near), int(rng.integers(0, 3))):
            near[k] = "changed"
        rows.append((100 + int(rng.integers(0, 8)) if i % 3 else None, " ".join(near)))
    return [*rows, (None, "alone and without an id at all"), (7, "another text under an id that is taken"), (7, rows[7][1]), (200, None), (201, ""), (None, " \n "), (202, "two words")]


def shingles(text):
    words = WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_quality_keeps_rows_by_score(spark):
    docs = frame(spark, corpus())
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    real = spark.read.parquet(f"{SF}/documents.parquet")
    both = real.select(*corpus_pipeline.COLUMNS).unionByName(docs.selectExpr("doc_id + 1000000 as doc_id", "text", "lang", "source", "n_chars"))
    model = quality.train(both, labels)
    kept = rows_of(corpus_pipeline.good_quality(spark, both, SF))
    expected = []
    for r in both.collect():
        raw = (r["text"] or "").encode()
        if model.score(quality.features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))[0] >= 0.5:
            expected.append((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]))
    assert kept == sorted(expected, key=repr)


def test_near_copies(spark):
    rows = corpus()
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    group[i] = group[j] = min(group[i], group[j])
    got = corpus_pipeline.one_of_near_copies(spark, frame(spark, rows), SF).collect()
    assert len(got) == len(set(group))
    place = {}
    for i, (d, t) in enumerate(rows):
        place.setdefault((d, t), i)
    chosen = {group[place[r["doc_id"], r["text"]]] for r in got}
    assert chosen == set(group)
    for r in got:
        ids = [rows[i][0] for i in range(len(rows)) if group[i] == group[place[r["doc_id"], r["text"]]] and rows[i][0] is not None]
        assert r["doc_id"] == (min(ids) if ids else None)


def test_repeats(spark):
    rng = np.random.default_rng(3)
    parts = ["".join(rng.choice(list("ab cé漢"), 60)) for _ in range(6)]
    rows = [(i, "".join(parts[k] for k in rng.integers(0, 6, 4)) + "q" * int(rng.integers(0, 60))) for i in range(30)]
    rows += [(5, rows[5][1]), (None, rows[0][1]), (31, None), (32, ""), (33, "short")]
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - 49 if i is not None else 0):
            first[raw[k : k + 50]] = min(i, first.get(raw[k : k + 50], i))
    expected = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = {j for k in range(len(raw) - 49) if i is not None and first[raw[k : k + 50]] < i for j in range(k, k + 50)}
        left = bytes(c for k, c in enumerate(raw) if k not in gone).decode(errors="replace").replace("�", "") if gone else t
        expected.append((i, left))
    got = corpus_pipeline.without_repeats(spark, frame(spark, rows), SF).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted(expected, key=repr)


def water(sizes, weights=(5, 2, 1), most=3):
    """Targets by filling: sources above their cap give the excess to the others by weight."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        share = {s: (total - sum(capped.values())) * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: float(most * sizes[s]) for s in over}


def test_mix(spark):
    rows = [(i, "w " * (i * 7 % 23)) for i in range(300)] + [(3, "w v " * 5), (None, "x y z"), (None, "x y z"), (None, None)]
    docs = frame(spark, rows)
    taken = mixing.mix_sources(docs).toPandas()
    assert len(taken) == len(rows)
    targets = water({k if isinstance(k, str) else None: int(v) for k, v in taken.groupby("source", dropna=False)["size"].sum().items()})
    for s, t in taken.groupby("source", dropna=False):
        want = targets[s if isinstance(s, str) else None]
        assert abs(t["target"].iloc[0] - want) < 1e-6 and abs(t["taken"].sum() - want) <= 3
    assert (taken["taken"] <= 3 * taken["size"]).all()
    got = corpus_pipeline.mixed(spark, docs, SF).collect()
    assert sum(len(WORDS.findall(r["text"])) for r in got) == taken["taken"].sum()
    assert len(got) == int(np.ceil(taken["taken"] / taken["size"].clip(lower=1)).sum())
    whole = {(i, " ".join(WORDS.findall(t or ""))) for i, t in rows}
    assert all(any(r["doc_id"] == i and (t + " ").startswith(" ".join(WORDS.findall(r["text"])) + " ") for i, t in whole) for r in got)
    again = mixing.mix_sources(docs.repartition(5)).toPandas()
    by = lambda t: sorted(map(str, t[["doc_id", "size", "taken"]].itertuples(index=False)))
    assert by(again) == by(taken)


def test_blocks_are_chosen_from_the_whole_shard(spark):
    """A source of which half is taken: the words come from all over its documents, by whole blocks."""
    rows = [(i, "w " * 1000) for i in range(1100)]
    docs = frame(spark, rows).withColumn("source", __import__("pyspark").sql.functions.expr("if(doc_id % 11 < 10, 's9', 's0')"))
    got = mixing.mix_sources(docs, block=64).toPandas()
    part = got[got["source"] == "s9"]
    share = part["taken"].sum() / part["size"].sum()
    assert 0.05 < share < 0.95
    assert (part["taken"] > 0).mean() > 0.9 * min(1, share * 1000 / 64) or (part["taken"] > 0).mean() > 0.5


def test_encoded(spark):
    public = pytest.importorskip("public_tokenizers")
    rows = corpus()
    got = corpus_pipeline.encoded(spark, frame(spark, rows), SF).collect()
    assert all(r["round_trip"] for r in got) and sum(r["rank"] == 0 for r in got) == len(rows)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    texts = {}
    for i, t in rows:
        texts.setdefault(i, set()).add(t or "")
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        pieces = "".join(model.id_to_piece(i) for i in ids if not model.is_byte(i)).replace("▁", " ")
        assert any(model.is_byte(i) for i in ids) or pieces[1:] in texts[r["doc_id"]] or not pieces and "" in texts[r["doc_id"]]


@pytest.mark.parametrize("stage", range(5))
def test_empty(spark, stage):
    empty = spark.createDataFrame([], SCHEMA)
    got = corpus_pipeline.STAGES[stage][1](spark, empty, SF)
    assert got.count() == 0
    if stage < 4:
        assert tuple(got.columns) == corpus_pipeline.COLUMNS
