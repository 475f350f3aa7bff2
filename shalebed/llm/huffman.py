"""Token-id files: canonical length-limited Huffman codes from global counts, decoded by table in independent blocks.

A file set is a folder: `ids` has one row for each part of the id stream (shard, first, doc_ids, sizes, n_ids,
checkpoints, bits), `code` the code length of each id. doc_ids are 64-bit and sizes 32-bit little-endian integers;
bits is a big-endian bit stream in 32-bit words; checkpoints holds the bit offset of every BLOCK-th id. Codes are
canonical: by length, then by id. The stream is in ascending doc_id order, nulls first, equal ids by text.
"""

from __future__ import annotations

import itertools
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from shalebed.llm.common import binary, id_and_text, materialize, partitions, shared_dir, spread

#: Ids of a block, which is decoded on its own, and of a part.
BLOCK, PART = 512, 1 << 20
#: Distinct text units whose ids a worker remembers.
REMEMBERED = 700_000
#: Where a blank between two others would join them in one run of white space.
_JOINED = re.compile(r"\s (?:\s|\Z)")


class _Units(dict):
    """Numbers text units as they come."""

    def __missing__(self, unit: str) -> int:
        self[unit] = at = len(self)
        return at


class Encoder:
    """Ids of texts by the tokenizers library.

    A byte-level BPE splits text before every blank that follows or precedes a character other than white space, and
    merges nothing across; so the library encodes each distinct unit once, and texts where that may not hold whole.
    """

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.end = end
        # Bytes of each token; a byte-level vocabulary writes every byte as one character.
        self.width = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.width[i] = len(token)
        self._clear()

    def _clear(self) -> None:
        self.units, self.size, self.ids = _Units(), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.known = 0
        self.used = np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keep the units met more than once since the last time, at most half as many as may be."""
        keep = np.flatnonzero(self.used > 1)
        if 2 * len(keep) > REMEMBERED:
            keep = np.sort(keep[np.argsort(-self.used[keep], kind="stable")[: REMEMBERED // 2]])
        units = list(self.units)
        begin = np.cumsum(self.size) - self.size
        size, ids = self.size[keep], self.ids[spread(begin[keep], self.size[keep])]
        self._clear()
        for k in keep.tolist():
            self.units[units[k]]  # numbers it
        self.size, self.ids, self.known, self.used = size, ids, len(keep), np.zeros(len(keep), np.int64)

    def _learn(self) -> None:
        new = list(itertools.islice(self.units, self.known, None))
        if not new:
            return
        # Units that begin with a blank and another character split off by themselves, so many go to the library at once.
        joined = [k for k, x in enumerate(new) if len(x) > 1 and x[0] == " " and not x[1].isspace()]
        alone = set(range(len(new))).difference(joined)
        of, sizes, got = [], [], []
        for at in range(0, len(joined), 20_000):
            part = joined[at : at + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join([new[k] for k in part])], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.cumsum(np.fromiter((len(new[k].encode()) for k in part), np.int64, len(part)))
            reach = np.cumsum(self.width[ids])
            to = np.searchsorted(reach, ends) + 1
            if to[-1] == len(ids) and (reach[to - 1] == ends).all():
                of.append(np.array(part))
                sizes.append(np.diff(to, prepend=0))
                got.append(ids)
            else:
                alone.update(part)
        rest = sorted(alone)
        each = [x.ids for x in self.tokenizer.encode_batch_fast([new[k] for k in rest], add_special_tokens=False)]
        of.append(np.array(rest, np.int64))
        sizes.append(np.fromiter(map(len, each), np.int64, len(each)))
        got.append(np.fromiter(itertools.chain.from_iterable(each), np.uint32))
        # They come in another order than their numbers.
        by = np.argsort(np.concatenate(of))
        size = np.concatenate(sizes)
        begin = np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, np.concatenate(got)[spread(begin[by], size[by])]])
        self.size = np.concatenate([self.size, size[by]])
        self.known = len(self.units)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by the end id, and how many each text has."""
        if len(self.units) > REMEMBERED:
            self._forget()
        number = self.units.__getitem__
        flat: list[int] = []
        count: list[int] = []
        whole: list[int] = []
        for i, text in enumerate(texts):
            had = len(flat)
            if not text:
                pass
            elif _JOINED.search(text) or any(x in text for x in self.special):
                whole.append(i)
            else:
                head, *rest = text.replace(" ", "\0 ").split("\0") if "\0" not in text else [text]
                if head:
                    flat.append(number(head))
                flat.extend(map(number, rest))
            count.append(len(flat) - had)
        self._learn()
        unit = np.array(flat, np.int64)
        used = np.bincount(unit, minlength=len(self.units))
        used[: len(self.used)] += self.used
        self.used = used
        begin = np.cumsum(self.size) - self.size
        size = self.size[unit]
        row = np.repeat(np.arange(len(texts)), count)
        total = np.bincount(row, weights=size, minlength=len(texts)).astype(np.int64)
        ids = self.ids[spread(begin[unit], size)]
        more = {i: self.tokenizer.encode(texts[i], add_special_tokens=False).ids for i in whole}
        out = np.empty(int(total.sum()) + sum(map(len, more.values())) + len(texts), np.uint32)
        at = np.cumsum(total) - total
        for i, x in more.items():
            total[i] = len(x)
        total += 1
        to = np.cumsum(total) - total
        plain = total - 1
        plain[whole] = 0
        out[spread(to, plain)] = ids[spread(at, plain)]
        for i, x in more.items():
            out[to[i] : to[i] + len(x)] = x
        out[to + total - 1] = self.end
        return out, total


_encoders: dict[tuple[str, int], Encoder] = {}


def _encoder(path: str, end: int) -> Encoder:
    """A worker's encoder serves all of its tasks."""
    if (path, end) not in _encoders:
        _encoders[path, end] = Encoder(path, end)
    return _encoders[path, end]


def _tokenize(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, end)
        shard = TaskContext.get().partitionId()
        first, held, n = 0, [], 0

        def out() -> pa.RecordBatch:
            ids = np.concatenate([x[1] for x in held])
            kind = np.uint16 if ids.max() < 65536 else np.uint32
            docs = pa.concat_arrays([x[0] for x in held])
            known = np.packbits(docs.is_valid().to_numpy(zero_copy_only=False)).tobytes()
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([first], pa.int64()), binary([docs.fill_null(0).to_numpy().tobytes()]), binary([known]), binary([np.concatenate([x[2] for x in held]).astype(np.uint32).tobytes()]), pa.array([len(ids)], pa.int64()), pa.array([kind().itemsize], pa.int32()), binary([ids.astype(kind).tobytes()])],
                names=["shard", "first", "doc_ids", "known", "sizes", "n_ids", "width", "raw"],
            )

        for batch in batches:
            ids, size = encoder.encode(batch.column(1).to_pylist())
            if batch.num_rows:
                held.append((batch.column(0), ids, size))
                n += len(ids)
            if n >= PART:
                yield out()
                first, held, n = first + n, [], 0
        if held:
            yield out()

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for width, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            got = np.bincount(np.frombuffer(raw.as_buffer(), np.uint16 if width == 2 else np.uint32))
            if len(got) > len(total):
                got[: len(total)] += total
                total = got
            else:
                total[: len(got)] += got
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "n"])


def code_lengths(counts: np.ndarray, most: int | None = None) -> np.ndarray:
    """Lengths of an optimal prefix code of at most `most` bits, by package-merge; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    most = most or max(16, int(np.ceil(np.log2(len(used)))) + 2)
    order = used[np.argsort(counts[used], kind="stable")]
    base = counts[order].astype(np.int64)
    leaf: list[np.ndarray] = []
    now = base
    for level in range(most):
        leaf.append(np.ones(len(base), bool) if level == 0 else marks)
        if level == most - 1:
            break
        packages = now[: len(now) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([base, packages])
        by = np.argsort(both, kind="stable")
        now, marks = both[by], by < len(base)
    take = 2 * len(base) - 2
    lengths = np.zeros(len(base), np.int64)
    for marks in reversed(leaf):
        leaves = int(marks[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then by id."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes = np.zeros(len(lengths), np.uint64)
    code, had = 0, 0
    sizes = lengths[order]
    at = 0
    for size in np.unique(sizes).tolist():
        n = int((sizes == size).sum())
        code <<= size - had
        codes[order[at : at + n]] = np.arange(code, code + n, dtype=np.uint64)
        code, had, at = code + n, size, at + n
    return codes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
    """The bit stream of ids and its checkpoints."""
    size = lengths[ids].astype(np.int64)
    at = np.cumsum(size) - size
    word, bit = at >> 5, (at & 31).astype(np.uint64)
    wide = codes[ids] << (np.uint64(64) - size.astype(np.uint64) - bit)
    n = int((at[-1] + size[-1] + 31) >> 5) + 2 if len(ids) else 2
    total = np.bincount(word, weights=(wide >> np.uint64(32)).astype(np.float64), minlength=n)
    total += np.bincount(word + 1, weights=(wide & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n)
    return total.astype(np.uint32).astype(">u4").tobytes(), at[::BLOCK].astype("<u8").tobytes()


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """For every value of the next `longest` bits the id and its length, as id << 6 | length."""
    longest = int(lengths.max()) if len(lengths) else 1
    codes = canonical(lengths)
    used = np.flatnonzero(lengths)
    table = np.zeros(1 << longest, np.uint64)
    span = (1 << (longest - lengths[used].astype(np.int64))).astype(np.int64)
    start = (codes[used] << (longest - lengths[used]).astype(np.uint64)).astype(np.int64)
    table[spread(start, span)] = np.repeat((used.astype(np.uint64) << np.uint64(6)) | lengths[used].astype(np.uint64), span)
    return table, longest


def unpack(bits: bytes, checkpoints: bytes, n: int, table: np.ndarray, longest: int) -> np.ndarray:
    """All blocks at once, an id of each at a step."""
    words = np.frombuffer(bits, ">u4").astype(np.uint64)
    wide = (words[:-1] << np.uint64(32)) | words[1:]
    at = np.frombuffer(checkpoints, "<u8").copy()
    out = np.zeros((len(at), BLOCK), np.uint32)
    shift, mask = np.uint64(64 - longest), np.uint64((1 << longest) - 1)
    for k in range(min(BLOCK, n)):
        if k == n - (len(at) - 1) * BLOCK:
            at = at[:-1]
        got = table[(wide[at >> np.uint64(5)] >> (shift - (at & np.uint64(31)))) & mask]
        out[: len(at), k] = got >> np.uint64(6)
        at += got & np.uint64(63)
    return out.ravel()[:n] if n else out.ravel()[:0]


def _pack(lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical(lengths)
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                raw = np.frombuffer(one.column(7)[0].as_buffer(), np.uint16 if one.column(6)[0].as_py() == 2 else np.uint32)
                bits, checkpoints = pack(raw, codes, lengths)
                yield pa.RecordBatch.from_arrays([*(one.column(i) for i in range(6)), binary([checkpoints]), binary([bits])], names=["shard", "first", "doc_ids", "known", "sizes", "n_ids", "checkpoints", "bits"])

    return run


def _unpack(lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, longest = decode_table(lengths)
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["bits"], row["checkpoints"], row["n_ids"], table, longest)
                size = np.frombuffer(row["sizes"], np.uint32).astype(np.int64)
                known = np.unpackbits(np.frombuffer(row["known"], np.uint8))[: len(size)].astype(bool)
                start = np.cumsum(size) - size
                raw = ids.astype("<u4").tobytes()
                for a in range(0, len(size), 256):
                    b = min(len(size), a + 256)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.frombuffer(row["doc_ids"], np.int64)[a:b], mask=~known[a:b]), pa.array([row["shard"]] * (b - a), pa.int32()), pa.array(row["first"] + start[a:b]), pa.array(size[a:b]), binary([raw[4 * s : 4 * (s + n)] for s, n in zip(start[a:b], size[a:b])])],
                        names=["doc_id", "shard", "within", "n_tokens", "ids"],
                    )

    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str, end: int) -> None:
    """Write the ids of all texts of docs (doc_id, text), each followed by `end`, as a file set in the new folder path.

    A null or empty text is the end id alone. Rows of one doc_id follow each other. Other columns are not read. An
    empty table gives a file set without rows.
    """
    spark = docs.sparkSession
    dealt = id_and_text(docs).repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    raw = materialize(dealt.mapInArrow(_tokenize(tokenizer, end), "shard int, first long, doc_ids binary, known binary, sizes binary, n_ids long, width int, raw binary"), "raw-ids")
    counts = raw.select("width", "raw").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most one row for each id of the vocabulary
    total = np.zeros(max((r["id"] for r in counts), default=0) + 1, np.int64)
    for r in counts:
        total[r["id"]] = r["n"]
    lengths = code_lengths(total)
    raw.mapInArrow(_pack(lengths), "shard int, first long, doc_ids binary, known binary, sizes binary, n_ids long, checkpoints binary, bits binary").write.option("compression", "none").parquet(f"{path}/ids")
    spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths) if n], "id int, length int").coalesce(1).write.parquet(f"{path}/code")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (32-bit little-endian) from a file set."""
    code = spark.read.parquet(f"{path}/code").collect()
    lengths = np.zeros(max((r["id"] for r in code), default=0) + 1, np.uint8)
    for r in code:
        lengths[r["id"]] = r["length"]
    files = spark.read.parquet(f"{path}/ids")
    # One row for each shard, of which there are as many as tasks wrote.
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).selectExpr("shard", "sum(n) OVER (ORDER BY shard) - n AS before")
    rows = files.mapInArrow(_unpack(lengths), "doc_id long, shard int, within long, n_tokens long, ids binary")
    return rows.join(F.broadcast(shards), "shard").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids")


def id_files(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """write_ids to a new folder in the shared folder, then read_ids."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(docs, path, tokenizer, end)
    return read_ids(spark, path)
