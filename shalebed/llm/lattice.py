"""Embedding near-dedup by lattice hashing: random projections decoded to points of E8, neighbouring cells probed.

A cell is a row of one or more points of E8, each the decoding of eight projections. More points make smaller cells,
which then need more tables: the more vectors, the smaller the cells, so the share of pairs that are compared falls.

Vectors meet in rounds, each of some tables and a range of their cells, whose shuffle is about as large as the vectors
themselves; what a round wrote goes when it is merged. Rounds yield components. Links are then counted inside them.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shalebed.llm.common import binary, discard, materialize, mix, partitions
from shalebed.llm.components import components
from shalebed.llm.minhash import spanning

class Setting(NamedTuple):
    """Points of E8 in a cell's key, what projections of unit vectors are multiplied by at a cosine of 0.9, cells of a table that hold a vector, tables, and the share of random pairs that meet."""

    points: int
    scale: float
    count: int
    tables: int
    share: float

    def cost(self, n: int) -> float:
        """Of a vector among n, in pairs compared: to place it in a cell costs as much as to compare it with about 100."""
        return 100 * self.count * self.tables + self.share * n


#: Each misses a pair at cosine 0.9 with less than 4e-5, as measured on random pairs of 64 dimensions; so are the shares, the last one carried on.
SETTINGS = (
    Setting(1, 0.45, 4, 4, 0.29),
    Setting(1, 0.62, 4, 8, 0.08),
    Setting(2, 0.45, 8, 10, 0.02),
    Setting(3, 0.45, 8, 24, 2e-3),
    Setting(4, 0.40, 8, 37, 4e-4),
    Setting(5, 0.40, 8, 80, 3e-5),
)
THRESHOLD = 0.9
#: Vectors of a cell that are compared with as many others at once, and rows that a task compares.
BLOCK, PART = 512, 1 << 16
#: Bytes of a round's shuffle at least; it is as large as all vectors where they are larger.
ROUND = 128 << 20


def _minimal() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    pairs = [np.array([a if k == i else b if k == j else 0 for k in range(8)]) for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    halves = [np.array(s) / 2 for s in itertools.product((1, -1), repeat=8) if np.prod(s) > 0]
    return np.array(pairs + halves)


_SHORT = _minimal()


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest point of D8: rounded, and where the sum is odd the worst coordinate rounded the other way."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(1) % 2)
    gap = x[odd] - near[odd]
    worst = np.abs(gap).argmax(1)
    near[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 of each row of 8: the better one of D8 and D8 moved by a half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def setting(n: int) -> Setting:
    """The setting of least cost for n vectors."""
    return min(SETTINGS, key=lambda s: s.cost(n))


def cells(unit: np.ndarray, how: Setting, threshold: float = THRESHOLD, seed: int = 8, own: range | None = None) -> np.ndarray:
    """Keys of the home cell and of the nearest neighbouring cells of unit vectors, table by table, of all tables or those in own.

    A neighbour differs from home in one of its points, by a shortest vector of E8; the nearest ones of all points count.
    """
    rng = np.random.default_rng([seed, unit.shape[1]])
    scale = how.scale * math.sqrt((1 - THRESHOLD) / (1 - min(threshold, 1 - 1e-6)))
    own = own or range(how.tables)
    out = np.empty((len(unit), len(own), how.count), np.uint64)
    salt = rng.integers(1, 2**62, (how.tables, how.points, 8), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    wide = min(how.count - 1, len(_SHORT))
    for t in range(own.stop):
        if t not in own:
            rng.standard_normal((how.points, unit.shape[1], 8))  # the projections of a table are the same whichever are asked for
            continue
        home = np.full(len(unit), t + unit.shape[1] * 64, np.uint64)
        steps, gains = [], []
        for k in range(how.points):
            y = unit @ rng.standard_normal((unit.shape[1], 8)) * scale
            point = decode(y)
            home += (np.rint(point * 2).astype(np.int64).view(np.uint64) * salt[t, k]).sum(-1, dtype=np.uint64)
            along = (y - point) @ _SHORT.T
            best = np.argsort(-along, axis=1, kind="stable")[:, :wide]
            gains.append(np.take_along_axis(along, best, 1))
            steps.append(((np.rint(_SHORT * 2).astype(np.int64).view(np.uint64) * salt[t, k]).sum(-1, dtype=np.uint64))[best])
        gain, step = np.concatenate(gains, 1), np.concatenate(steps, 1)
        best = np.argsort(-gain, axis=1, kind="stable")[:, : how.count - 1]
        out[:, t - own.start, 0] = home
        out[:, t - own.start, 1:] = home[:, None] + np.take_along_axis(step, best, 1)
    return mix(out.reshape(len(unit), len(own) * how.count))


def _unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision."""
    m = raw.astype(np.float64)
    most = np.abs(m).max(1, keepdims=True)
    return m / np.linalg.norm(m / most, axis=1, keepdims=True) / most


def _hash(how: Setting, threshold: float, own: range, kind: str):
    """id, copies, cells of the tables in own, and the vector's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            sizes = np.diff(vectors.offsets.to_numpy())
            values = vectors.flatten().to_numpy()
            begin = np.cumsum(sizes) - sizes
            keys: list = [None] * batch.num_rows
            raw: list = [None] * batch.num_rows
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                m = values[begin[rows][:, None] + np.arange(size)].astype(kind)
                for r, k, v in zip(rows.tolist(), cells(_unit(m), how, threshold, own=own), m):
                    keys[r], raw[r] = k.tobytes(), v.tobytes()
            flat = np.frombuffer(b"".join(keys), np.int64)
            n = len(own) * how.count
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(pa.array(np.arange(0, n * batch.num_rows + 1, n, dtype=np.int32)), pa.array(flat)), binary(raw)], names=["id", "copies", "keys", "raw"])

    return run


def _meetings(table: pd.DataFrame, threshold: float, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Of each pair of blocks of a cell that has links: the rows of both, which of them link, and the cell's key."""
    ids, key = table["id"].to_numpy(np.int64), table["key"].to_numpy(np.int64)
    spot = table[["i", "j", "block"]].to_numpy(np.int64)
    order = np.lexsort((ids, spot[:, 2], spot[:, 1], spot[:, 0], key))
    cuts = np.flatnonzero(np.concatenate([[True], (np.diff(key[order]) != 0) | (np.diff(spot[order, :2], axis=0) != 0).any(1)]))
    vectors = table["raw"].to_numpy()
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        here = order[a:b]
        if len(here) < 2:
            continue
        i, j = spot[here[0], :2]
        unit = _unit(np.frombuffer(b"".join(vectors[here]), kind).reshape(len(here), -1))
        left, right = spot[here, 2] == i, spot[here, 2] == j
        hit = unit[left] @ unit[right].T >= threshold
        if i == j:
            hit = np.triu(hit, 1)
        if hit.any():
            yield here[left], here[right], hit, key[here[0]]


def _join(threshold: float, kind: str):
    """Links that hold together what links in each cell."""

    def run(table: pd.DataFrame) -> pd.DataFrame:
        ids = table["id"].to_numpy(np.int64)
        edges = [spanning(ids[rows], ids[cols], hit) for rows, cols, hit, _ in _meetings(table, threshold, kind)]
        return pd.DataFrame({"u": np.concatenate([e[0] for e in edges] or [ids[:0]]), "v": np.concatenate([e[1] for e in edges] or [ids[:0]])})

    return run


def _count(threshold: float, kind: str, tables: int, count: int):
    """Links of each vector, weighed by copies."""

    def run(table: pd.DataFrame) -> pd.DataFrame:
        ids, copies = (table[c].to_numpy(np.int64) for c in ("id", "copies"))
        keys = np.stack(table["keys"].to_numpy()).astype(np.int64)
        links: list[tuple[np.ndarray, np.ndarray]] = []
        for rows, cols, hit, key in _meetings(table, threshold, kind):
            u, v = np.nonzero(hit)
            # A pair that meets in several cells counts in the one of least key.
            lower = np.zeros(len(u), bool)
            left, right = keys[rows].reshape(len(rows), tables, count), keys[cols].reshape(len(cols), tables, count)
            for p in range(0, len(u), 4096):
                l, r = left[u[p : p + 4096]], right[v[p : p + 4096]]
                lower[p : p + 4096] = ((l[:, :, :, None] == r[:, :, None, :]) & (l[:, :, :, None] < key)).any((1, 2, 3))
            u, v = u[~lower], v[~lower]
            links.append((ids[rows], np.bincount(u, weights=copies[cols][v], minlength=len(rows)).astype(np.int64)))
            links.append((ids[cols], np.bincount(v, weights=copies[rows][u], minlength=len(cols)).astype(np.int64)))
        return pd.DataFrame({"id": np.concatenate([x[0] for x in links] or [ids[:0]]), "n": np.concatenate([x[1] for x in links] or [ids[:0]])})

    return run


def _whole(threshold: float):
    """Links of each vector of components that are compared whole."""

    def run(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(["component", "id"])
        component, copies = table["component"].to_numpy(np.int64), table["copies"].to_numpy(np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(component) != 0]))
        vectors, out = table["embedding"].to_numpy(), np.zeros(len(table), np.int64)
        for a, b in zip(cuts, [*cuts[1:], len(table)]):
            unit = _unit(np.stack(vectors[a:b]))
            hit = unit @ unit.T >= threshold
            np.fill_diagonal(hit, False)
            out[a:b] = hit @ copies[a:b]
        return pd.DataFrame({"id": table["id"].to_numpy(np.int64), "n": out})

    return run


def _cells_of(keyed: DataFrame, rounds: int, r: int) -> DataFrame:
    """keyed with a row for each of its cells in range r of rounds."""
    return keyed.withColumn("key", F.explode(F.filter(F.array_distinct("keys"), lambda k: F.pmod(k, F.lit(rounds)) == r)))


def _dealt(keyed: DataFrame, full: DataFrame, rounds: int, r: int, rows: int) -> DataFrame:
    """Vectors by cells and pairs of blocks, in so many parts that one, which a task holds whole, has about PART rows on average."""
    parts = max(4 * partitions(keyed.sparkSession), math.ceil(rows / rounds / PART))
    placed = _cells_of(keyed, rounds, r).join(F.broadcast(full.select("key", "blocks")), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    meets = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    return meets.withColumn("part", F.pmod(F.xxhash64("key", "i", "j"), F.lit(parts))).drop("blocks", "other")


def _rounds(keyed: DataFrame, placed: int, row: int, most: int) -> tuple[DataFrame, int, int]:
    """Cells of more than BLOCK vectors with their blocks, rows to come in all, and rounds of about `most` bytes for rows of `row` bytes."""
    full = materialize(_cells_of(keyed, 1, 0).groupBy("key").agg(F.count("*").alias("members")).where(F.col("members") > BLOCK).withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")), "full")
    rows = placed + full.agg(F.coalesce(F.sum(F.col("members") * (F.col("blocks") - 1)), F.lit(0)).alias("m")).first()["m"]
    return full, rows, max(1, math.ceil(rows * row / most))


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, how: Setting | None = None) -> DataFrame:
    """Classes of vectors linked by a cosine of at least `threshold` in double precision.

    vectors has vec_id and embedding (an array of numbers); other columns are not read. Returns vec_id, n_links (other
    rows linked directly), component_id, kept. A null, empty or zero vector, or one that holds nulls or non-finite
    numbers, links with nothing, as do vectors of different lengths. Equal vectors are one class from the start and link
    with each other. A row whose vec_id is null has component_id null and takes part in no link. An empty table gives
    no rows. A pair at cosine 0.9 is missed with less than 4e-5, nearer ones with less; all pairs that meet are compared,
    in blocks. `how` follows from the number of distinct vectors unless it is given.

    Links are counted among all pairs of a component of up to BLOCK classes, and among pairs that meet in one of more.
    """
    kind = "float" if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "double"
    item = "float32" if kind == "float" else "float64"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    good = rows.where(F.col("vec_id").isNotNull() & F.coalesce((F.size("embedding") > 0) & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0), F.lit(False)))
    plus = lambda c: F.transform(c, lambda x: x + F.lit(0.0).cast(kind))
    classes = materialize(good.groupBy(plus("embedding").alias("embedding")).agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "vectors")
    n = classes.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("embedding")), F.lit(0)).alias("numbers")).first()
    how = how or setting(n["rows"])
    wide = n["numbers"] * (4 if kind == "float" else 8) // max(n["rows"], 1) + 48
    most = max(ROUND, n["rows"] * wide)
    at_once = min(how.tables, max(1, most // (2 * max(n["rows"], 1) * how.count * 8)))
    known = None
    for first in range(0, how.tables, at_once):
        own = range(first, min(first + at_once, how.tables))
        keyed = materialize(classes.select("id", "embedding", "copies").mapInArrow(_hash(how, threshold, own, item), "id long, copies long, keys array<long>, raw binary").drop("copies"), "cells")
        full, met, rounds = _rounds(keyed, n["rows"] * len(own) * how.count, wide, most)
        found = [] if known is None else [known]
        for r in range(rounds):
            found.append(materialize(_dealt(keyed.select("id", "keys", "raw"), full, rounds, r, met).drop("keys").groupBy("part").applyInPandas(_join(threshold, item), "u long, v long"), "compared"))
        known = materialize(functools.reduce(DataFrame.unionByName, found).distinct(), "links")
        discard(keyed, full, *found)
    least = materialize(components(known), "components")
    linked = materialize(classes.join(least, "id").join(least.groupBy("component").agg(F.count("*").alias("m")), "component"), "linked")
    parts = max(4 * partitions(vectors.sparkSession), math.ceil(n["rows"] / PART))
    small = linked.where(F.col("m") <= BLOCK).withColumn("part", F.pmod(F.xxhash64("component"), F.lit(parts)))
    counted = [materialize(small.groupBy("part").applyInPandas(_whole(threshold), "id long, n long"), "counted")]
    large = linked.where(F.col("m") > BLOCK)
    many = large.count()
    if many:
        keyed = materialize(large.select("id", "embedding", "copies").mapInArrow(_hash(how, threshold, range(how.tables), item), "id long, copies long, keys array<long>, raw binary"), "cells")
        places = how.tables * how.count
        full, met, rounds = _rounds(keyed, many * places, wide + 8 * places, most)
        for r in range(rounds):
            counted.append(materialize(_dealt(keyed, full, rounds, r, met).groupBy("part").applyInPandas(_count(threshold, item, how.tables, how.count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")), "counted"))
        discard(keyed, full)
    links = functools.reduce(DataFrame.unionByName, counted).groupBy("id").agg(F.sum("n").alias("n"))
    discard(known)
    summed = materialize(classes.join(links, "id", "left").join(least, "id", "left").select("embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "summed")
    keyed = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), plus("embedding")).alias("embedding"))
    return (
        keyed.join(summed, "embedding", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )
