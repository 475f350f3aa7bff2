"""What the training-data operators share: the shared folder, Arrow text blocks and vectorised hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch.
BATCH = 1024
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE2 = 0xD1342543DE82EF95 | 1
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_pow: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where none is set and all runs on one machine, a temporary one. RuntimeError on a cluster without one."""
    found = spark.sparkContext.getCheckpointDir()
    if not found:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(configured or tempfile.mkdtemp(prefix="shalebed-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a cut of the lineage that outlives executors.

    The shuffle files of the finished job are deleted, for nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    had = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, had)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads again."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and text, a null text as the empty one. Arrow batches get few rows, for texts may be long."""
    if int(docs.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH:
        docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def keyed(docs: DataFrame, key: str) -> tuple[DataFrame, bool]:
    """docs with a long column `key` that no two rows share: doc_id where each row has one of its own, else (and true) a row number of a written table."""
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("rows")).where("doc_id is null or rows > 1")
    if odd.isEmpty():
        return docs.withColumn(key, F.col("doc_id").cast("long")), False
    return materialize(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), True


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Row slices of about `most` bytes of text; one longer text is a slice of its own."""
    n = batch.num_rows
    if not n:
        return
    _, offsets = block(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield batch.slice(at, to - at)
        at = to


def block(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column and the rows' offsets in them, without a copy."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, raw, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(raw, np.int64 if wide else np.int32, n + 1 + column.offset)[column.offset :].astype(np.int64) if raw else np.zeros(n + 1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    if base not in _pow or len(_pow[base][0]) <= n:
        size = max(n + 1, 1 << 19)
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _pow[base] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _pow[base]


class Rolling:
    """Polynomial hashes modulo 2**64 of any byte ranges of a block."""

    def __init__(self, data: np.ndarray, base: int = _BASE):
        self.up, self.down = _powers(len(data) + 1, base)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit digests of byte ranges, as rows of two words; two independent polynomials and the length."""
    out = np.empty((len(start), 2), np.uint64)
    out[:, 0] = Rolling(data).of(start, end)
    out[:, 1] = Rolling(data, _BASE2).of(start, end) ^ (end - start).astype(np.uint64)
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, the words' starts and ends, and for each row the number of its first word."""
    low = _LOWER[data]
    solid = ~_WS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = True
    np.logical_not(solid[:-1], out=before[1:])
    after = np.empty(len(data), bool)
    after[-1:] = True
    np.logical_not(solid[1:], out=after[:-1])
    start = np.flatnonzero(solid & (before | edge[:-1]))
    end = np.flatnonzero(solid & (after | edge[1:])) + 1
    return low, start, end, np.searchsorted(start, offsets)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i]+1, … sizes[i] of them, one after another."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(sizes) - sizes
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, sizes)
