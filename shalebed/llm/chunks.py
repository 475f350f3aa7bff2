"""Substring dedup by content-defined chunking: a gear rolling hash cuts, digests decide."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shalebed.llm.common import block, digests, id_and_text, materialize, slices

#: A chunk has LEAST to MOST bytes; one byte in 2**CUT_BITS ends one, so they have about 48.
LEAST, MOST, CUT_BITS = 16, 160, 5
#: Repeated chunks go only where they make up a run of so many bytes.
LEAST_RUN = 64
_GEAR = np.random.default_rng(77).integers(0, 2**32, 256, dtype=np.uint32)
#: The bits tested depend on the last 16 bytes alone, so a cut is found again 16 bytes after an insertion.
_SHIFT = 16 - CUT_BITS


def cuts(data: np.ndarray, offsets: np.ndarray, least: int = LEAST, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the chunks of each row and each chunk's row."""
    gear = _GEAR[data]
    step = 1
    while step < 16:
        shifted = gear.copy()
        shifted[step:] += gear[:-step] << np.uint32(step)
        gear, step = shifted, step * 2
    hits = np.flatnonzero(((gear >> np.uint32(_SHIFT)) & np.uint32((1 << CUT_BITS) - 1)) == 0) + 1
    first = np.searchsorted(hits, offsets)
    hits_ = hits.tolist()
    ends: list[int] = []
    count: list[int] = []
    for r, (start, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        had, last = len(ends), start
        for at in hits_[first[r] : first[r + 1]]:
            while at - last > most:
                last += most
                ends.append(last)
            if at - last >= least:
                ends.append(at)
                last = at
        while end - last > most:
            last += most
            ends.append(last)
        if end > last:
            ends.append(end)
        count.append(len(ends) - had)
    return np.array(ends, np.int64), np.repeat(np.arange(len(count)), count)


def _chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            data, offsets = block(batch.column(2))
            end, row = cuts(data, offsets)
            if not len(end):
                continue
            start = np.concatenate([[0], end[:-1]])
            start = np.maximum(start, offsets[row])
            key = digests(data, start, end).view(np.int64)
            ids, versions = batch.column(0).to_numpy()[row], batch.column(1).to_numpy()[row]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(versions), pa.array((start - offsets[row]).astype(np.int32)), pa.array((end - start).astype(np.int32)), pa.array(key[:, 0]), pa.array(key[:, 1])], names=["doc_id", "version", "start", "size", "d1", "d2"])


def _keep(least_run: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, spans, sizes = [], [], []
            for text, found in zip(batch.column(1), batch.column(2)):
                raw = text.as_py()
                sizes.append(len(raw))
                runs: list[list[int]] = []
                for item in sorted({(x["start"], x["size"]) for x in found.as_py() or []}):
                    if runs and item[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], sum(item))
                    else:
                        runs.append([item[0], sum(item)])
                # A removed run never splits a character.
                edges = [0]
                out = []
                for a, b in runs:
                    while a < b and raw[a] & 0xC0 == 0x80:
                        a += 1
                    while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                        b -= 1
                    if b - a >= least_run:
                        edges += [a, b]
                        out.append({"start": a, "end": b})
                edges.append(len(raw))
                kept.append(b"".join(raw[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2)))
                spans.append(out)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([x.decode() for x in kept]), pa.array([hashlib.sha256(x).hexdigest() for x in kept])],
                names=["doc_id", "n_bytes", "spans", "text", "kept_sha256"],
            )

    return run


def remove_repeated_chunks(docs: DataFrame, least_run: int = LEAST_RUN) -> DataFrame:
    """Each text without the runs of chunks whose digest also occurs in a document of smaller doc_id.

    docs has doc_id and text; other columns are not read. Returns doc_id, n_bytes, spans (the removed byte ranges of the
    UTF-8 text), text (what is left) and kept_sha256. Runs under least_run bytes stay; no character is split. A null
    text counts as empty and stays empty. Chunks repeated within one document, or in rows of the same doc_id, stay. A
    row whose doc_id is null stays whole and takes part in no match. An empty table gives no rows.
    """
    texts = id_and_text(docs).select("doc_id", F.xxhash64("text").alias("version"), "text")
    chunks = materialize(texts.where("doc_id is not null").mapInArrow(_chunk, "doc_id long, version long, start int, size int, d1 long, d2 long"), "chunks")
    owners = chunks.groupBy("d1", "d2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))
    shared = materialize(owners.where("owner < last").select("d1", "d2", "owner"), "shared")
    found = chunks.join(shared, ["d1", "d2"]).where("doc_id > owner")
    by_doc = materialize(found.groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "size")).alias("found")), "found")
    joined = texts.join(by_doc, ["doc_id", "version"], "left").select("doc_id", F.col("text").cast("binary").alias("text"), "found")
    return joined.mapInArrow(_keep(least_run), "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, text string, kept_sha256 string")
