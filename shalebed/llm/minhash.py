"""MinHash near-dedup: universal hash minima, bands, verification on full sets, large-star and small-star components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shalebed.llm.common import binary, block, id_and_text, keyed, materialize, mix, slices, words
from shalebed.llm.common import Rolling
from shalebed.llm.components import components

#: A pair of Jaccard 0.85 escapes 20 bands of 4 with probability (1 - 0.85**4)**20 = 4e-7, one of 0.8 with 3e-5.
BANDS, ROWS, WIDTH, PERCENT = 20, 4, 5, 85
#: Members of a bucket that one task compares with as many others; larger buckets are dealt anew by rare shingles.
BLOCK = 384
#: Members of a bucket that one task compares with the least id.
STAR = 96
_SEED = np.random.default_rng(20240501)
_A = _SEED.integers(0, 2**63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _SEED.integers(0, 2**63, 512, dtype=np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct shingles of each row, sorted within the row, and the rows' offsets in them.

    A row with fewer words than `width` has the whole sequence as its one shingle; a row without words has none.
    """
    low, start, end, first = words(data, offsets)
    hashed = Rolling(low).of(start, end)
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    left = (first[1:][row] - np.arange(len(hashed))) if len(row) else np.zeros(0, np.int64)
    total = np.zeros(len(hashed), np.uint64)
    padded = np.concatenate([hashed, np.zeros(width, np.uint64)])
    inside = np.minimum(left, width)
    for k in range(width):
        part = mix(padded[k : k + len(hashed)] + np.uint64(k * 2 + 1))
        total += np.where(k < inside, part * np.uint64(0x9E3779B97F4A7C15 + 2 * k), np.uint64(0))
    total = mix(total + inside.astype(np.uint64))
    keep = left >= width
    short = (count < width) & (count > 0)
    keep[first[:-1][short]] = True
    row, value = row[keep], total[keep]
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    row, value = row[fresh], value[fresh]
    return value, np.searchsorted(row, np.arange(len(count) + 1))


def _sketch(bands: int, rows: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                data, offsets = block(batch.column(1))
                value, at = shingles(data, offsets, width)
                size = np.diff(at)
                some = np.flatnonzero(size)
                minima = np.zeros((bands * rows, batch.num_rows), np.uint64)
                if len(some):
                    for k in range(bands * rows):
                        minima[k, some] = np.minimum.reduceat(value * _A[k] + _B[k], at[:-1][some])
                keys = np.zeros((bands, batch.num_rows), np.uint64)
                for k in range(bands):
                    for r in range(rows):
                        keys[k] = mix(keys[k] * np.uint64(31) + minima[k * rows + r])
                flat = np.ascontiguousarray(keys.T).view(np.int64).ravel()
                sets = [hashlib.blake2b(value[at[i] : at[i + 1]].tobytes(), digest_size=16).digest() for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(size.astype(np.int64)), binary(sets), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands, dtype=np.int32)), pa.array(flat))],
                    names=["doc_id", "n_shingles", "digest", "keys"],
                )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                data, offsets = block(batch.column(1))
                value, at = shingles(data, offsets, width)
                raw = [value[at[i] : at[i + 1]].tobytes() for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([batch.column(0), binary(raw)], names=["id", "hashes"])

    return run


def _overlap(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Exact sizes of all intersections of left and right sets: a product of incidence matrices over shared hashes, in column blocks."""
    ln, rn = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    out = np.zeros((len(left), len(right)), np.float32)
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    lv, rv = np.concatenate(left), np.concatenate(right)
    lr, rr = np.repeat(np.arange(len(left)), ln), np.repeat(np.arange(len(right)), rn)
    for at in range(0, len(both), 4096):
        part = both[at : at + 4096]
        mats = []
        for values, rows, n in ((lv, lr, len(left)), (rv, rr, len(right))):
            col = np.searchsorted(part, values)
            col[col == len(part)] = 0
            hit = part[col] == values
            m = np.zeros((n, len(part)), np.float32)
            m[rows[hit], col[hit]] = 1
            mats.append(m)
        out += mats[0] @ mats[1].T
    return out


def _linked(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    inter = np.rint(_overlap(left, right)).astype(np.int64)
    union = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :] - inter
    return 100 * inter >= percent * union


def spanning(a: np.ndarray, b: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same ids as all of linked (rows a, columns b) do: at most one for each id."""
    u, v = np.nonzero(linked)
    ids = np.unique(np.concatenate([a, b]))
    x, y = np.searchsorted(ids, a[u]), np.searchsorted(ids, b[v])
    label = np.arange(len(ids))
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = np.flatnonzero(label != np.arange(len(ids)))
    return ids[far], ids[label[far]]


def _star(percent: int):
    def run(table: pd.DataFrame) -> pd.DataFrame:
        hub = table["hub"].iloc[0]
        members = table.drop_duplicates("id")
        sets = {i: np.frombuffer(h, np.uint64) for i, h in zip(members["id"], members["hashes"])}
        center = sets.pop(hub)
        ids = np.fromiter(sets, np.int64, len(sets))
        if not len(ids):
            return pd.DataFrame({"u": ids, "v": ids})
        good = ids[_linked([sets[i] for i in ids], [center], percent)[:, 0]]
        return pd.DataFrame({"u": good, "v": np.full(len(good), hub, np.int64)})

    return run


def _square(percent: int):
    def run(table: pd.DataFrame) -> pd.DataFrame:
        i, j = int(table["i"].iloc[0]), int(table["j"].iloc[0])
        rows, cols = table[table["block"] == i], table[table["block"] == j]
        a, b = rows["id"].to_numpy(np.int64), cols["id"].to_numpy(np.int64)
        if not len(a) or not len(b):
            return pd.DataFrame({"u": a[:0], "v": a[:0]})
        read = lambda t: [np.frombuffer(h, np.uint64) for h in t["hashes"]]
        other = rows["component"].to_numpy()[:, None] != cols["component"].to_numpy()[None, :]
        hit = _linked(read(rows), read(cols), percent) & other if other.any() else other
        u, v = spanning(a, b, hit)
        return pd.DataFrame({"u": u, "v": v})

    return run


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = block(batch.column(2))
        ends = (offsets // 8).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends), pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(raw.tobytes(), np.int64)))], names=["id", "component", "n", "hashes"])


def _prefixes(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """members (id, component) in buckets (band -1, key a shingle) that hold all pairs to be linked: the rarest shingles of each set.

    Sets that share `percent` of their union share one of the first n - ceil(percent * n / 100) + 1 shingles of either in
    any common order; with the rarest first, sets that have only common text together seldom meet.
    """
    listed = members.join(sets, "id").select("id", "component", "hashes").mapInArrow(_lists, "id long, component long, n int, hashes array<long>")
    tokens = materialize(listed.select("id", "component", "n", F.explode("hashes").alias("key")), "tokens")
    often = tokens.groupBy("key").agg(F.count("*").alias("often")).where("often > 1")
    # A shingle that no other set has takes a place but makes no bucket; such ones come first.
    shared = tokens.join(often, "key")
    rank = F.row_number().over(W.partitionBy("id").orderBy("often", "key"))
    place = rank + F.col("n") - F.count("*").over(W.partitionBy("id"))
    first = shared.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    return materialize(first.select(F.lit(-1).alias("band"), "key", "id", "component"), "prefixes")


def _stars(bucketed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) of members to the least id of their bucket; bucketed has band, key, id, hub and members."""
    pairs = bucketed.where("id <> hub").groupBy("hub", "id").agg(F.max("members").alias("members"))
    # Salted, so a task has about STAR members of one hub; the hub goes to each of its parts.
    salted = pairs.withColumn("parts", F.ceil(F.col("members") / STAR).cast("int"))
    tasks = salted.select("hub", "parts", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id")
    centers = tasks.select("hub", "parts", "part").distinct().withColumn("id", F.col("hub"))
    return materialize(tasks.unionByName(centers).join(sets, "id").groupBy("hub", "parts", "part").applyInPandas(_star(percent), "u long, v long"), "stars")


def _open(placed: DataFrame) -> DataFrame:
    """band, key and members of the buckets of placed (band, key, id, component) that hold several components; of those with the same members one."""
    mixed = placed.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members"), F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("s")).where("lo <> hi")
    return materialize(mixed.groupBy("members", "x", "s").agg(F.min(F.struct("band", "key")).alias("one")).select("one.band", "one.key", "members"), "open")


def _squares(placed: DataFrame, open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across components within open buckets, member by member, in blocks: each block meets each block once."""
    single = open_.select("band", "key", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    member = placed.join(single, ["band", "key"]).withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int"))
    meets = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("band", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "component", "block")
    return materialize(meets.join(sets, "id").groupBy("band", "key", "i", "j").applyInPandas(_square(percent), "u long, v long"), "crossed")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Classes of documents linked by 100 * intersection >= percent * union of their distinct word shingles.

    docs has doc_id and text and may have more columns, which are not read. Returns doc_id, n_shingles, component_id,
    kept. A null or empty text, or one of white space, has no shingles and is its own class. Rows with equal sets are one
    class from the start, so copies cost nothing later; repeated rows with one doc_id give equal rows. Different texts
    of one doc_id are linked each for itself, and component_id is the least doc_id of a row's class. A row whose doc_id
    is null gets component_id null, kept false and takes part in no link. An empty table gives no rows.

    Buckets of the bands first verify every member against the bucket's least id. Buckets that still hold members of
    several components are compared member by member, across components, on full sets, if they have at most BLOCK
    members. Members of larger ones meet anew, and only there, in buckets of their rarest shingles, which miss no link.
    """
    rows_, odd = keyed(docs.select("doc_id", "text"), "row")
    found = _classes(rows_.select(F.when(F.col("doc_id").isNotNull(), F.col("row")).alias("doc_id"), "text"), percent, width, bands, rows)
    if odd:
        named = materialize(found.withColumnRenamed("doc_id", "row").join(rows_.select("row", F.col("doc_id").cast("long").alias("doc_id")), "row", "left"), "named")
        least = named.groupBy("component_id").agg(F.min("doc_id").alias("least"))
        found = named.join(least, "component_id", "left").select("doc_id", "n_shingles", F.col("least").alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _classes(docs: DataFrame, percent: int, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles and component_id of near_duplicates, for ids that are null or no other row's."""
    texts = id_and_text(docs)
    sketched = materialize(texts.mapInArrow(_sketch(bands, rows, width), "doc_id long, n_shingles long, digest binary, keys array<long>"), "sketch")
    classes = materialize(sketched.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("id")), "classes")
    reps = sketched.where("n_shingles > 0").join(classes, "digest").where("doc_id = id").dropDuplicates(["doc_id"])
    banded = materialize(reps.select("id", F.posexplode("keys").alias("band", "key")), "banded")
    hubs = materialize(banded.groupBy("band", "key").agg(F.min("id").alias("hub"), F.count("*").alias("members")).where("members > 1"), "hubs")
    bucketed = materialize(banded.join(hubs, ["band", "key"]), "bucketed")
    ids = bucketed.select("id").distinct()
    sets = materialize(texts.join(ids.withColumnRenamed("id", "doc_id"), "doc_id").dropDuplicates(["doc_id"]).mapInArrow(_sets(width), "id long, hashes binary"), "sets")
    compared = _stars(bucketed, sets, percent)
    first = materialize(components(compared), "first")
    placed = bucketed.join(first, "id", "left").select("band", "key", "id", F.coalesce("component", "id").alias("component"))
    open_ = _open(placed)
    links = compared.unionByName(_squares(placed, open_.where(F.col("members") <= BLOCK), sets, percent))
    large = open_.where(F.col("members") > BLOCK)
    if not large.isEmpty():
        again = placed.join(large.select("band", "key"), ["band", "key"]).select("id", "component").distinct()
        held = _prefixes(again, sets, percent)
        groups = held.groupBy("band", "key").agg(F.min("id").alias("hub"), F.count("*").alias("members"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").drop("lo", "hi")
        links = links.unionByName(_stars(held.join(groups, ["band", "key"]), sets, percent))
        found = materialize(components(links), "second")
        moved = materialize(held.drop("component").join(found, "id", "left").select("band", "key", "id", F.coalesce("component", "id").alias("component")), "moved")
        links = links.unionByName(_squares(moved, _open(moved), sets, percent))
    linked = materialize(components(links), "linked")
    of_class = classes.join(linked.withColumnRenamed("component", "least"), "id", "left").select("digest", F.coalesce("least", "id").alias("least"))
    return (
        sketched.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest"))
        .join(of_class, "digest", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))
    )
