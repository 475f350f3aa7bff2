"""Cases that an operator or a stage once did less than whole."""

import pytest

from shalebed.llm import imatch
from tests.llm.test_edges import frame

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stage_drops_copies_from_four_fifths_on(spark):
    words = [f"w{i}" for i in range(100)]
    near = [*words[:91], *(f"x{i}" for i in range(9))]  # 87 of 105 shingles: 0.829
    far = [*words[:85], *(f"y{i}" for i in range(15))]  # 81 of 111: 0.730, and less with near
    docs = frame(spark, [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))])
    assert sorted(r["doc_id"] for r in corpus_pipeline.one_of_near_copies(spark, docs, "").collect()) == [1, 3]


def test_fingerprints_of_hot_texts(spark):
    hot = [" ".join(f"{c}{i}" for i in range(40)) for c in "ab"]
    rest = [" ".join(f"c{(7 * i + k) % 400}" for k in range(30)) for i in range(120)]
    # Two groups of copies, each with a fifth of the rows; a few words of one are in the band by distinct texts.
    rest[3] += " a0 a1 a2 a3 a4 a5 a6 a7"
    # Descending ids meet in turn, so each hot text is the next of the other.
    rows = [(i, hot[i % 2]) for i in range(80)] + [(100 + i, t) for i, t in enumerate(rest)] + [(300, "rare short words"), (301, "other brief ones"), (302, ""), (303, None)]
    got = {r["doc_id"]: r for r in imatch.fingerprints(frame(spark, rows)).collect()}
    assert all(got[i]["fingerprint"] == got[i % 2]["fingerprint"] != "" for i in range(80))
    assert got[0]["fingerprint"] != got[1]["fingerprint"] and got[1]["near_next"] == 0
    assert all(int(got[0]["fingerprint"][k : k + 2], 16) < imatch.SUBSETS for k in range(0, len(got[0]["fingerprint"]), 18))
    assert all(int(got[1]["fingerprint"][k : k + 2], 16) >= imatch.SUBSETS for k in range(0, len(got[1]["fingerprint"]), 18))
    assert got[301]["near_next"] < 0.2 and got[302]["fingerprint"] == "" and got[303]["near_next"] == 1
    # Half of a hot text and half of another.
    assert got[79]["near_edited"] > 0.1 and got[0]["near_edited"] > 0
    # One half hot, the other from a normal text.
    rows = [(i, hot[1]) for i in range(1, 40)] + [(0, rest[0])] + [(100 + i, t) for i, t in enumerate(rest)]
    got = {r["doc_id"]: r for r in imatch.fingerprints(frame(spark, rows)).collect()}
    assert 0 < got[1]["near_edited"] < 1 and 0 < got[2]["near_edited"] < 1 and got[2]["near_next"] == 1
