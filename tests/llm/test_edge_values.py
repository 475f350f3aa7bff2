"""What every operator returns for nulls, empty and blank texts, repeated rows, ties and rows without an id."""

import hashlib

import pytest

from tests.llm.test_edges import RUNS, TEXTS, frame

EMPTY = hashlib.sha256(b"").hexdigest()
FIRST = TEXTS[0][1]


@pytest.fixture(scope="module")
def results(spark):
    out = {}
    for name, run in RUNS.items():
        rows: dict = {}
        for r in run(frame(spark, TEXTS)).collect():
            rows.setdefault(r["doc_id"], []).append(r)
        out[name] = rows
    return out


@pytest.mark.parametrize("name", RUNS)
def test_repeated_rows_are_equal(results, name):
    for rows in results[name].values():
        by_rank: dict = {}
        for r in rows:
            by_rank.setdefault(r["rank"] if "rank" in r else 0, set()).add(repr({k: v for k, v in r.asDict().items() if k not in ("taken", "start", "near_next", "near_edited", "edited_sha256", "edited_fingerprint")}))
        assert all(len(v) == 1 for v in by_rank.values())


@pytest.mark.parametrize("name", RUNS)
def test_every_row_has_a_result(results, name):
    rows = [r for some in results[name].values() for r in some if "rank" not in r or r["rank"] == 0]
    assert len(rows) == len(TEXTS) and None in results[name]


def test_chunks(results):
    got = results["chunks"]
    assert all(got[i][0]["n_bytes"] == 0 and got[i][0]["spans"] == [] and got[i][0]["kept_sha256"] == EMPTY for i in (3, 4))
    assert got[5][0]["n_bytes"] == 4 and got[5][0]["spans"] == []
    assert got[1][0]["spans"] == [] and sum(s["end"] - s["start"] for s in got[2][0]["spans"]) > 100
    assert got[None][0]["n_bytes"] == len(FIRST)


def test_suffix(results):
    got = results["suffix"]
    assert all(got[i][0]["n_bytes"] == 0 and got[i][0]["kept_sha256"] == EMPTY for i in (3, 4))
    assert got[1][0]["spans"] == [] and [tuple(s) for s in got[2][0]["spans"]] == [(0, len(FIRST))] and bytes(got[2][0]["kept"]) == b""
    assert got[None][0]["spans"] == [] and bytes(got[None][0]["kept"]).decode() == FIRST
    assert [tuple(s) for s in got[8][0]["spans"]] == [(0, len(TEXTS[6][1]))] and bytes(got[8][0]["kept"]) == b" end"


def test_language_model(results):
    got = results["maxent"]
    assert all(got[i][0]["n_tokens"] == 1 for i in (3, 4, 5)) and got[6][0]["n_tokens"] == 3
    assert not got[None][0]["held_out"] and got[None][0]["n_tokens"] == 97 and got[None][0]["n_known"] == 97
    assert len({r["train_tokens"] for rows in got.values() for r in rows}) == 1
    assert all(r["score"] < 0 and r["base_score"] < 0 for rows in got.values() for r in rows)


def test_mix(results):
    got = results["mixing"]
    assert all(got[i][0]["size"] == 0 and got[i][0]["taken"] == 0 for i in (3, 4, 5))
    assert got[6][0]["source"] is None and got[6][0]["size"] == 2
    assert all(0 <= r["taken"] <= 3 * r["size"] for rows in got.values() for r in rows)


def test_fingerprints(results):
    got = results["imatch"]
    assert got[1][0]["fingerprint"] == got[2][0]["fingerprint"] == got[None][0]["fingerprint"] != ""
    assert got[3][0]["fingerprint"] == got[4][0]["fingerprint"] == "" != got[5][0]["fingerprint"]
    assert got[3][0]["n_chars"] == 0 and got[11][0]["n_chars"] == len(TEXTS[11][1])


def test_minhash(results):
    got = results["minhash"]
    assert all((got[i][0]["n_shingles"], got[i][0]["component_id"], got[i][0]["kept"]) == (0, i, True) for i in (3, 4, 5))
    assert (got[2][0]["component_id"], got[2][0]["kept"]) == (1, False) and got[8][0]["component_id"] == 7
    assert got[None][0]["component_id"] is None and not got[None][0]["kept"]
    assert got[9][0]["n_shingles"] == 1 and got[9][0]["kept"] and got[6][0]["n_shingles"] == 1


def test_sampling(results):
    got = results["pieces"]
    assert all([r["n_tokens"] for r in got[i]] == [0] and got[i][0]["inclusion"] == 1 for i in (3, 4))
    assert len({bytes(r["ids"]) for r in got[1]}) == 2 and all(r["round_trip"] for rows in got.values() for r in rows)


def test_token_files(results):
    got = results["huffman"]
    assert all(got[i][0]["n_tokens"] == 1 and bytes(got[i][0]["ids"]) == (2).to_bytes(4, "little") for i in (3, 4))
    rows = sorted((r["start"], r["n_tokens"]) for rows in got.values() for r in rows)
    assert rows[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(rows, rows[1:]))
