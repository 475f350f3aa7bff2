"""Suffix-array dedup: threshold-bounded interval expansion on Burrows-Wheeler transforms.

A 50-byte string has a minimiser: the least hash of its 24-byte strings. Equal strings have equal minimisers, so all
that can match meets under a minimiser's hash, however documents are dealt. Three passes over the text:

1. Every minimiser position (an anchor, about one in 14 bytes) is sent by its hash, with two 16-bit hashes of the 13
   bytes on either side: a 50-byte match shares one of them. Anchors that another document may share are marked.
2. Around marked anchors, the context of the windows they rule is cut out. A context that a batch holds several times
   is sent once, by the anchor's hash; its copies in later documents are resolved on the spot.
3. In each part the distinct contexts are one text. Its suffixes are sorted, its Burrows-Wheeler transform taken, and
   intervals are extended backward, breadth first, so that boundaries appear by increasing common prefix, up to the
   threshold. What is then still one interval is one 50-byte string, and its least doc_id is known.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shalebed.llm.common import Rolling, binary, block, digests, id_and_text, materialize, partitions, slices, spread

LENGTH, GRAM = 50, 24
SIDE = (LENGTH - GRAM) // 2
#: Bytes of text whose anchors are gathered before they are sent.
FLUSH = 4 << 20
#: Bytes of text whose anchors make a part, on average.
PART = 16 << 20


class Anchors:
    """Minimisers of all windows of `length` bytes inside the rows of a block."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
        self.reach = length - gram
        n = len(data) - gram + 1
        self.rolling = Rolling(data)
        self.end = np.repeat(offsets[1:], np.diff(offsets))
        self.begin = np.repeat(offsets[:-1], np.diff(offsets))
        if n <= self.reach:
            self.hash, self.at, self.least = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
            return
        every = np.arange(n)
        self.hash = self.rolling.of(every, every + gram) | np.uint64(1)
        w = n - self.reach
        least = self._slide(self.hash, np.minimum, self.reach + 1)
        least[every[:w] + length > self.end[:w]] = 0
        self.least = least
        most = self._slide(np.concatenate([np.zeros(self.reach, np.uint64), least, np.zeros(self.reach, np.uint64)]), np.maximum, self.reach + 1)
        self.at = np.flatnonzero(most[:n] == self.hash)

    @staticmethod
    def _slide(x: np.ndarray, op: np.ufunc, width: int) -> np.ndarray:
        have = 1
        while have * 2 <= width:
            x, have = op(x[:-have], x[have:]), have * 2
        return op(x[: len(x) - (width - have)], x[width - have :]) if have < width else x

    def side(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """16-bit hashes of byte ranges, never 0; 0 where a range leaves its row."""
        inside = (start >= self.begin[self.at]) & (end <= self.end[self.at])
        got = np.zeros(len(start), np.uint16)
        got[inside] = (self.rolling.of(start[inside], end[inside]) % np.uint64(65535)).astype(np.uint16) + 1
        return got

    def rule(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and last window start that each anchor rules."""
        starts = at[:, None] - self.reach + np.arange(self.reach + 1)
        ok = (starts >= 0) & (starts < len(self.least))
        hit = ok & (self.least[np.where(ok, starts, 0)] == self.hash[at][:, None])
        return starts[np.arange(len(at)), hit.argmax(1)], starts[np.arange(len(at)), self.reach - hit[:, ::-1].argmax(1)]


def _pairs(group: np.ndarray, side: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which rows share (group, side), side not 0, with a row of another document."""
    out = np.zeros(len(group), bool)
    use = np.flatnonzero(side)
    if len(use) < 2:
        return out
    order = use[np.lexsort((doc[use], side[use], group[use]))]
    g, s, d = group[order], side[order], doc[order]
    same = (g[1:] == g[:-1]) & (s[1:] == s[:-1])
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    last = np.concatenate([first[1:], [len(order)]]) - 1
    mixed = d[first] != d[last]
    out[order] = np.repeat(mixed, last - first + 1)
    return out


def _send_anchors(length: int, gram: int, parts: int):
    def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not rows:
            return
        hashed, left, right, doc, at = (np.concatenate(x) for x in zip(*rows))
        if not len(hashed):
            return
        order = np.argsort(hashed, kind="stable")
        hashed, left, right, doc, at = (x[order] for x in (hashed, left, right, doc, at))
        group = np.cumsum(np.concatenate([[0], (hashed[1:] != hashed[:-1]).astype(np.int64)]))
        matched = np.zeros(int(group[-1]) + 1, bool)
        matched[group[_pairs(group, left, doc) | _pairs(group, right, doc)]] = True
        marked = matched[group]
        # One row stands for all rows of an anchor that two documents of this batch share; those are marked here.
        first = np.concatenate([[True], group[1:] != group[:-1]])
        keep = np.flatnonzero(~marked | first)
        part = (hashed[keep] % np.uint64(parts)).astype(np.int64)
        keep = keep[np.lexsort((order[keep], part))]  # documents in order within a part, which packs well
        bounds = np.searchsorted(np.sort(part), np.arange(parts + 1))
        blobs: dict[str, list] = {k: [] for k in ("part", "hashes", "sides", "docs", "places")}
        for p in range(parts):
            i = keep[bounds[p] : bounds[p + 1]]
            if len(i):
                blobs["part"].append(p)
                blobs["hashes"].append(hashed[i].tobytes())
                blobs["sides"].append(np.stack([left[i], right[i], marked[i].astype(np.uint16)]).tobytes())
                blobs["docs"].append(doc[i].tobytes())
                blobs["places"].append(at[i].astype(np.uint32).tobytes())
        n = len(blobs["part"])
        yield pa.RecordBatch.from_arrays([pa.array(blobs["part"], pa.int32()), *(binary(blobs[k]) for k in ("hashes", "sides", "docs", "places")), pa.array(np.zeros(n, np.int64))], names=["part", "hashes", "sides", "docs", "places", "doc_id"])
        i = np.flatnonzero(marked)
        if len(i):
            yield _marks(doc[i], at[i], parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for whole in batches:
            for batch in slices(whole, "text"):
                data, offsets = block(batch.column(1))
                found = Anchors(data, offsets, length, gram)
                at = found.at
                row = np.searchsorted(offsets, at, side="right") - 1
                side = (length - gram) // 2
                ids = batch.column(0).to_numpy()
                rows.append((found.hash[at], found.side(at - side, at), found.side(at + gram, at + gram + side), ids[row], at - offsets[row]))
                held += len(data)
                if held > FLUSH:
                    yield from out(rows)
                    rows, held = [], 0
        yield from out(rows)

    return run


def _marks(doc: np.ndarray, at: np.ndarray, parts: int = 1) -> pa.RecordBatch:
    """One row for each document, with all of its places."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order].astype(np.uint32)
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    ends = [*first[1:], len(doc)]
    n = len(first)
    none = pa.nulls(n, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array((doc[first] % parts).astype(np.int32)), none, none, none, binary([at[a:b].tobytes() for a, b in zip(first, ends)]), pa.array(doc[first])], names=["part", "hashes", "sides", "docs", "places", "doc_id"])


def _mark(table: pd.DataFrame) -> pd.DataFrame:
    ready = table[table["hashes"].isna()][["doc_id", "places"]]
    table = table[table["hashes"].notna()]
    if not len(table):
        return ready
    hashed = np.concatenate([np.frombuffer(x, np.uint64) for x in table["hashes"]])
    left, right, forced = np.concatenate([np.frombuffer(x, np.uint16).reshape(3, -1) for x in table["sides"]], axis=1)
    doc = np.concatenate([np.frombuffer(x, np.int64) for x in table["docs"]])
    at = np.concatenate([np.frombuffer(x, np.uint32) for x in table["places"]])
    order = np.argsort(hashed, kind="stable")
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(np.concatenate([[0], (hashed[order][1:] != hashed[order][:-1]).astype(np.int64)]))
    marked = _pairs(group, left, doc) | _pairs(group, right, doc)
    hot = np.zeros(int(group.max()) + 1, bool)
    hot[group[forced > 0]] = True
    i = np.flatnonzero((marked | hot[group]) & (forced == 0))
    if not len(i):
        return ready
    got = _marks(doc[i], at[i])
    return pd.concat([ready, pd.DataFrame({"doc_id": got.column(5).to_numpy(), "places": got.column(4).to_pylist()})])


def _runs(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges merged where they overlap or touch, in the order of document and start."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    fresh = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
    which = np.cumsum(fresh)
    shift = which.astype(np.int64) << 33
    reach = np.maximum.accumulate(end + shift) if len(doc) else end
    opens = fresh.copy()
    opens[1:] |= start[1:] + shift[1:] > reach[:-1]
    first = np.flatnonzero(opens)
    last = np.concatenate([first[1:], [len(doc)]])[: len(first)] - 1
    return doc[first], start[first], (reach - shift)[last] if len(first) else end[:0]


_CONTEXTS = "part int, hashes binary, texts binary, lengths binary, rules binary, docs binary, doc_id long, spans binary"
_NAMES = [x.split()[0] for x in _CONTEXTS.split(", ")]


def _spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    doc, start, end = _runs(doc, start, end)
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    ends = [*first[1:], len(doc)]
    return doc[first], [np.stack([start[a:b], end[a:b]]).astype(np.int64).tobytes() for a, b in zip(first, ends)]


def _send_contexts(length: int, gram: int, parts: int):
    def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not rows:
            return
        hashed, key, doc, place, size = (np.concatenate(x) for x in list(zip(*rows))[:5])
        data = np.concatenate([x[5] for x in rows])
        begin = np.cumsum(size) - size
        order = np.lexsort((doc, key[:, 1], key[:, 0], hashed))
        lead = np.concatenate([[True], (key[order][1:] != key[order][:-1]).any(1) | (hashed[order][1:] != hashed[order][:-1])])
        head = np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))
        # A copy in a later document of this batch: all its windows start in an earlier one.
        later = doc[order] > doc[order][head]
        i = order[later]
        if len(i):
            docs, spans = _spans(doc[i], place[i], place[i] + size[i])
            n = len(docs)
            none = pa.nulls(n, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array((docs % parts).astype(np.int32)), none, none, none, none, none, pa.array(docs), binary(spans)], names=_NAMES)
        i = order[~later]
        part = (hashed[i] % np.uint64(parts)).astype(np.int64)
        i = i[np.argsort(part, kind="stable")]
        bounds = np.searchsorted(np.sort(part), np.arange(parts + 1))
        blobs: list[list] = [[] for _ in range(6)]
        for p in range(parts):
            j = i[bounds[p] : bounds[p + 1]]
            if len(j):
                for to, x in zip(blobs, (p, hashed[j].tobytes(), data[spread(begin[j], size[j])].tobytes(), size[j].astype(np.uint16).tobytes(), place[j].astype(np.uint32).tobytes(), doc[j].tobytes())):
                    to.append(x)
        n = len(blobs[0])
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(blobs[0], pa.int32()), *map(binary, blobs[1:]), pa.array(np.zeros(n, np.int64)), pa.nulls(n, pa.binary())], names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for whole in batches:
            for batch in slices(whole, "text"):
                data, offsets = block(batch.column(1))
                got = [np.frombuffer(b"".join(x), np.uint32) for x in batch.column(2).to_pylist()]
                row = np.repeat(np.arange(len(got)), [len(x) for x in got])
                at = np.concatenate(got).astype(np.int64) + offsets[row]
                at, keep = np.unique(at, return_index=True)
                row = row[keep]
                if not len(at):
                    continue
                found = Anchors(data, offsets, length, gram)
                first, last = found.rule(at)
                size = last + length - first
                rows.append((found.hash[at], digests(data, first, first + size), batch.column(0).to_numpy()[row], first - offsets[row], size, data[spread(first, size)]))
                held += int(size.sum())
                if held > FLUSH:
                    yield from out(rows)
                    rows, held = [], 0
        yield from out(rows)

    return run


def suffix_order(text: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Suffixes of text in order, each as far as stop, then by place. Sorted by prefixes of doubling length."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    place = np.arange(n)
    for k in range(8):
        key = (key << np.uint64(8)) | np.where(place + k < stop, padded[k : k + n], np.uint64(0))
    del padded
    have, longest = 8, int((stop - place).max())
    while True:
        order = np.argsort(key)
        sorted_ = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], (sorted_[1:] != sorted_[:-1]).astype(np.int64)]))
        if have >= longest or rank[order[-1]] == n:
            return np.argsort((rank << 32) | place)
        ahead = place + have
        key = (rank.astype(np.uint64) << np.uint64(32)) | np.where(ahead < stop, rank[np.minimum(ahead, n - 1)], 0).astype(np.uint64)
        have *= 2


def intervals(text: np.ndarray, stop: np.ndarray, length: int) -> np.ndarray:
    """For each place of text a number, equal for places whose next `length` bytes are equal.

    Contexts end before stop, where a 0 stands. Breadth-first backward extension: with all intervals of strings of some
    length known, those of one byte more follow through the transform, byte by byte; a boundary found at a step is a
    common prefix of that value. It stops at `length`.
    """
    order = suffix_order(text, stop)
    transform = text[order - 1]
    extend = np.argsort(transform, kind="stable")  # from each interval of c + w to where its w stands
    head = transform[extend]
    bound = np.ones(len(text), bool)
    bound[1:] = head[1:] != head[:-1]
    open_ = np.flatnonzero(~bound)
    for _ in range(length - 1):
        if not len(open_):
            break
        inside = np.cumsum(bound, dtype=np.int32)
        new = inside[extend[open_]] != inside[extend[open_ - 1]]
        bound[open_[new]] = True
        open_ = open_[~new]
    out = np.empty(len(text), np.int64)
    out[order] = np.cumsum(bound)
    return out


def _slices(size: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes together."""
    total = np.concatenate([[0], np.cumsum(size)])
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(total, total[at] + most, side="right")) - 1)
        yield at, to
        at = to


def _expand(length: int, most: int = 1 << 18):
    def run(table: pd.DataFrame) -> pd.DataFrame:
        ready = table[table["hashes"].isna()][["doc_id", "spans"]]
        table = table[table["hashes"].notna()]
        if not len(table):
            return ready
        hashed = np.concatenate([np.frombuffer(x, np.uint64) for x in table["hashes"]])
        size = np.concatenate([np.frombuffer(x, np.uint16) for x in table["lengths"]]).astype(np.int64)
        place = np.concatenate([np.frombuffer(x, np.uint32) for x in table["rules"]]).astype(np.int64)
        doc = np.concatenate([np.frombuffer(x, np.int64) for x in table["docs"]])
        data = np.frombuffer(b"".join(table["texts"]), np.uint8)
        start = np.cumsum(size) - size
        # A slice at a time, so the hash tables stay small.
        key = np.empty((len(start), 2), np.uint64)
        for a, b in _slices(size):
            key[a:b] = digests(data[start[a] : start[b - 1] + size[b - 1]], start[a:b] - start[a], start[a:b] + size[a:b] - start[a])
        order = np.lexsort((doc, key[:, 1], key[:, 0], hashed))
        lead = np.concatenate([[True], (key[order][1:] != key[order][:-1]).any(1) | (hashed[order][1:] != hashed[order][:-1])])
        context = np.empty(len(order), np.int64)
        context[order] = np.cumsum(lead) - 1
        one = order[lead]  # a context's first document stands for it
        firsts: list[np.ndarray] = []
        cut = np.concatenate([[True], hashed[one][1:] != hashed[one][:-1]])
        at = 0
        total = np.concatenate([[0], np.cumsum(size[one] + 1)])
        while at < len(one):
            to = int(np.searchsorted(total, total[at] + most))
            while to < len(one) and not cut[to]:
                to += 1
            pick = one[at : min(to, len(one))]
            text = np.zeros(int((size[pick] + 1).sum()), np.uint8)
            begin = np.cumsum(size[pick] + 1) - size[pick] - 1
            text[spread(begin, size[pick])] = data[spread(start[pick], size[pick])]
            stop = np.repeat(begin + size[pick], size[pick] + 1)
            class_ = intervals(text, stop, length)
            count = size[pick] - length + 1
            windows = class_[spread(begin, count)]
            least = np.full(int(class_.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, windows, np.repeat(doc[pick], count))
            firsts.append(least[windows])
            at = to
        first = np.concatenate(firsts)
        count = size[one] - length + 1
        begins = np.cumsum(count) - count
        n = count[context]
        window = spread(begins[context], n)
        owner = np.repeat(np.arange(len(doc)), n)
        found = first[window] < doc[owner]
        owner, offset = owner[found], (window - np.repeat(begins[context], n))[found]
        s = place[owner] + offset
        d, spans = _spans(doc[owner], s, s + length)
        return pd.concat([ready, pd.DataFrame({"doc_id": d, "spans": spans})])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text and spans become doc_id and what is left; columns after them are carried on."""
    for batch in batches:
        texts, all_spans = batch.column(1), batch.column(2)
        kept, spans, sizes = [], [], []
        for i in range(batch.num_rows):
            raw = texts[i].as_buffer().to_pybytes() if hasattr(texts[i], "as_buffer") else texts[i].as_py()
            ranges = all_spans[i].as_py() or []
            sizes.append(len(raw))
            if not ranges:
                kept.append(raw)
                spans.append([])
                continue
            got = np.concatenate([np.frombuffer(x, np.int64).reshape(2, -1) for x in ranges], axis=1)
            zero = np.zeros(got.shape[1], np.int64)
            _, start, end = _runs(zero, got[0], got[1])
            edges = np.concatenate([[0], np.stack([start, end], 1).ravel(), [len(raw)]])
            kept.append(b"".join(raw[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2)))
            spans.append([{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist())])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), binary(kept), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), *batch.columns[3:]],
            names=["doc_id", "n_bytes", "spans", "kept", "kept_sha256", *batch.schema.names[3:]],
        )


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each text without the bytes covered by a string of `length` bytes that also starts in a document of smaller doc_id.

    docs has doc_id and text; of other columns only those named in `carry` are read, and returned as they are. Returns
    one row for each of docs: doc_id, n_bytes, spans (the removed byte ranges), kept (the remaining bytes, which may be
    cut inside a character), kept_sha256. A null text counts as empty; texts under `length` bytes stay whole. Rows of
    one doc_id are never compared with each other, so repeated rows give equal results; rows of one doc_id with
    different texts stay whole and take part in no match. A row whose doc_id is null takes part in no match and stays
    whole. An empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = id_and_text(docs)
    hashed = F.xxhash64("text")
    each = texts.groupBy("doc_id").agg(F.min(hashed).alias("a"), F.max(hashed).alias("b"), F.sum(F.octet_length("text")).alias("bytes"))
    each = materialize(each.select("doc_id", "bytes", (F.col("a") != F.col("b")).alias("several")), "each")
    several = materialize(each.where("several").select("doc_id"), "several")  # a table of its own, so Spark sees how small it is
    numbered = texts.where("doc_id is not null").join(several, "doc_id", "left_anti")
    # A task holds a part's anchors whole, about one in 14 bytes of text.
    size = each.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()["bytes"]
    parts = max(8 * partitions(spark), -(-int(size) // PART))
    sent = numbered.mapInArrow(_send_anchors(length, gram, parts), "part int, hashes binary, sides binary, docs binary, places binary, doc_id long")
    marks = sent.groupBy("part").applyInPandas(_mark, "doc_id long, places binary")
    by_doc = materialize(marks.groupBy("doc_id").agg(F.collect_list("places").alias("places")), "marks")
    marked = numbered.join(by_doc, "doc_id").select("doc_id", "text", "places")
    spans = marked.mapInArrow(_send_contexts(length, gram, parts), _CONTEXTS).groupBy("part").applyInPandas(_expand(length), "doc_id long, spans binary")
    of_doc = materialize(spans.groupBy("doc_id").agg(F.collect_list("spans").alias("spans")), "spans")
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)))
    joined = whole.join(of_doc, "doc_id", "left").select("doc_id", "text", "spans", *(f"c{i}" for i in range(len(carry))))
    cut = joined.mapInArrow(_cut, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary, kept_sha256 string" + "".join(f", c{i} {types[c]}" for i, c in enumerate(carry)))
    return cut.withColumnsRenamed({f"c{i}": c for i, c in enumerate(carry)})


def summary(result: DataFrame) -> DataFrame:
    """The counts and digest of remove_repeats."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return result.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
