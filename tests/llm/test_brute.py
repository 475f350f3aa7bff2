"""Queries without SQL against plain Python: chunks, fingerprints, token ids."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shalebed.llm import chunks, huffman, imatch, maxent
from shalebed.llm.queries import QUERIES
from tests.llm.test_edges import frame

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def documents():
    return duckdb.sql(f"select doc_id, coalesce(text, '') from '{SF}/documents.parquet' order by doc_id desc").fetchall()


def expected_fingerprints(spark, rows):
    """n_chars, digest, near_edited and near_next of (doc_id, text) rows in descending order: pieces are equal if a subset has the same terms."""
    held = lambda t: list(dict.fromkeys(WORDS.findall(t.translate(LOWER))))
    texts = {t for _, t in rows}
    count: dict = {}
    for t in texts:
        for w in held(t):
            count[w] = count.get(w, 0) + 1
    low, high = max(2, imatch.LEAST_SHARE * len(texts)), max(2, imatch.MOST_SHARE * len(texts))
    lexicon = {w for w, c in count.items() if low <= c <= high}
    edited = []
    for k, (_, t) in enumerate(rows):
        half = len(t) // 2
        edited.append(t[: len(t) - half] + rows[(k + 1) % len(rows)][1][:half])
    words = sorted({w for t in [*texts, *edited] for w in [*held(t), t]})
    hashes = {r["w"]: r["h"] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w", F.lit(41)).alias("h")).collect()}

    def subsets(some):
        out: dict = {}
        for w in some:
            h = hashes[w]
            first, step = h % imatch.SUBSETS, (h >> 6) % (imatch.SUBSETS // imatch.MEMBERS - 1) + 1
            for i in range(imatch.MEMBERS):
                out.setdefault((first + step * i) % imatch.SUBSETS, set()).add(w)
        return out

    def both(t):
        all_ = held(t) or ([t] if t else [])
        return subsets([w for w in held(t) if w in lexicon]), subsets(all_)

    def like(a, b):
        either = a.keys() | b.keys()
        return sum(a.get(s) == b.get(s) for s in either) / len(either) if either else 1.0

    out = {}
    for k, (d, t) in enumerate(rows):
        (a, whole_a), (b, whole_b), (n, whole_n) = both(t), both(edited[k]), both(rows[(k + 1) % len(rows)][1])
        near_edited = like(a, b) if a and b else like(whole_a, whole_b)
        near_next = 0.0 if bool(a) != bool(n) else like(a, n) if a else like(whole_a, whole_n)
        out[d] = (len(t), hashlib.sha256(edited[k].encode()).hexdigest(), near_edited, near_next)
    return out


def test_fingerprints(spark):
    rows = documents()
    want = expected_fingerprints(spark, rows)
    got = {r["doc_id"]: r for r in QUERIES["op4_document_fingerprints"](spark, SF).collect()}
    assert got.keys() == want.keys()
    for d, (n, digest, edited, following) in want.items():
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (n, digest)
        assert abs(r["near_edited"] - edited) < 1e-9 and abs(r["near_next"] - following) < 1e-9
    by_text: dict = {}
    for d, t in rows:
        assert by_text.setdefault(t, got[d]["fingerprint"]) == got[d]["fingerprint"]
    assert np.mean([r["near_edited"] for r in got.values()]) > np.mean([r["near_next"] for r in got.values()]) + 0.1


def test_fingerprints_of_unlike_texts(spark):
    rows = [(5, "wholly new words"), (4, "nothing like these"), (3, " \n"), (2, "\t"), (1, ""), (0, "")]
    got = {r["doc_id"]: r for r in imatch.fingerprints(frame(spark, rows)).collect()}
    assert [got[i]["near_next"] for i in (5, 4, 3, 2, 1)] == [0, 0, 0, 0, 1]
    assert got[3]["fingerprint"] != got[2]["fingerprint"] and got[1]["fingerprint"] == got[0]["fingerprint"] == ""


def test_lexicon_joined_by_shuffle(spark, monkeypatch):
    rows = documents()[:60]
    docs = frame(spark, rows)
    few = sorted(map(tuple, imatch.fingerprints(docs).collect()))
    monkeypatch.setattr(imatch, "BROADCAST_TERMS", 1)
    assert sorted(map(tuple, imatch.fingerprints(docs).collect())) == few


def test_token_ids(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    rows = [*documents(), (-5, "  odd   blanks \n\n\t end "), (-4, "ünï çödé 漢字 🙂​"), (-3, ""), (-2, "x" * 5000)]
    got = {r["doc_id"]: r for r in huffman.id_files(frame(spark, rows), public.path("byte_bpe_50k.json"), end=2).collect()}
    start = 0
    for d, t in sorted(rows):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert bytes(got[d]["ids"]) == ids.tobytes() and got[d]["n_tokens"] == len(ids) and got[d]["start"] == start
        start += len(ids)
    query = QUERIES["op10_token_id_files"](spark, SF).collect()
    for r in query:
        mine = tokenizer.encode(dict(rows)[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids_crc32"] == zlib.crc32(np.array([*mine, 2], "<u4").tobytes())


def test_chunks_by_definition(spark):
    """Every removed run of chunks also stands in a document of smaller id, and no longer run was left."""
    rows = sorted(documents())
    got = {r["doc_id"]: r for r in chunks.remove_repeated_chunks(frame(spark, rows)).collect()}
    seen: list[tuple[int, bytes]] = []
    for d, t in rows:
        raw, spans = t.encode(), [(s["start"], s["end"]) for s in got[d]["spans"]]
        assert got[d]["n_bytes"] == len(raw)
        left, at = b"", 0
        for a, b in spans:
            assert a >= at and b > a
            left, at = left + raw[at:a], b
        assert got[d]["kept_sha256"] == hashlib.sha256(left + raw[at:]).hexdigest()
        if spans:
            whole = b"\x00".join(x for i, x in seen if i < d)
            # A run may join chunks of several documents; each piece of 64 bytes at a chunk's beginning is in one of them.
            assert all(any(raw[k : k + 24] in whole for k in range(a, max(a + 1, b - 24))) for a, b in spans)
        seen.append((d, raw))
    first: dict = {}
    for d, t in rows:
        first.setdefault(t, d)
    copies = [(d, t) for d, t in rows if first[t] < d and len(t.encode()) >= 400]
    assert copies and all(sum(s["end"] - s["start"] for s in got[d]["spans"]) >= 0.9 * len(t.encode()) for d, t in copies)


def bigram(rows):
    """log10 chances of held-out texts by an interpolated bigram of the others: a history's followers take n of n + kinds of its chance."""
    tokens = {d: [*WORDS.findall(t.translate(LOWER)), ""] for d, t in rows}
    held = {d for d, _ in rows if zlib.crc32(str(d).encode()) % 7 == 2}
    count, pairs, total, kinds = {}, {}, {}, {}
    for d in tokens.keys() - held:
        before = None
        for w in tokens[d]:
            count[w] = count.get(w, 0) + 1
            kinds[before] = kinds.get(before, 0) + ((before, w) not in pairs)
            pairs[before, w] = pairs.get((before, w), 0) + 1
            total[before] = total.get(before, 0) + 1
            before = w
    n = sum(count.values())
    out = 0.0
    for d in held:
        before = None
        for w in tokens[d]:
            alone = (count.get(w, 0) + 1) / (n + len(count) + 1)
            h, k = total.get(before, 0), kinds.get(before, 0)
            out += np.log10((pairs.get((before, w), 0) + k * alone) / (h + k) if h else alone)
            before = w
    return out


def test_language_model_beats_a_bigram(spark):
    """On the held-out texts of sf0.01."""
    sf = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"select doc_id, coalesce(text, '') from '{sf}/documents.parquet'").fetchall()
    got = QUERIES["op2_lm_scoring"](spark, sf).where("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base")).first()
    assert got["score"] > bigram(rows) > got["base"]


def test_language_model_is_a_distribution():
    """Chances of all words after any history sum to 1."""
    rng = np.random.default_rng(5)
    counts = np.sort(rng.integers(1, 400, 150))[::-1].astype(np.int64)
    model = maxent.Model([f"w{i}".encode() for i in range(150)], counts, int(counts.sum()) + 77, 190)
    word = rng.integers(0, 151, 6000)
    one, two = model.history(word, np.full(60, 100))
    skip = two % 7
    for history, after in ((3, 1), (model.begin, 2), (150, 0), (999, 5)):
        every = np.arange(151)
        log = maxent.log_chances(model, np.concatenate([one, np.full(151, history)]), np.concatenate([skip, np.full(151, after)]), np.concatenate([word, every]), np.arange(6151) < 6000)
        assert abs((10.0 ** log[6000:]).sum() - 1) < 1e-5


def test_language_model_does_not_depend_on_tasks(spark):
    rows = [(i, f"the cat {i % 9} sat on the mat with {i % 5} others {'and more ' * (i % 3)}") for i in range(300)]
    docs = frame(spark, rows)
    runs = [{r["doc_id"]: r["score"] for r in maxent.score_documents(d).collect()} for d in (docs.coalesce(1), docs.repartition(7))]
    assert all(abs(runs[0][i] - runs[1][i]) < 1e-4 for i in runs[0])
