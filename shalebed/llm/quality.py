"""Quality classifier: a generalised additive model with pairwise interactions on figures of a text.

Cyclic boosting fits one shallow tree at a time to one feature (or one pair); the trees of a feature add up to a lookup
table over its bins, so a score is a sum of looked-up values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shalebed.llm.common import Rolling, block, id_and_text, slices, words

#: Labelled rows that the model is fitted on at most, chosen by a hash of doc_id. A fit of so many takes the driver seconds.
SAMPLE = 20_000
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 48, 12, 120, 60, 8, 0.15
FEATURES = ("bytes", "words", "word_bytes", "upper", "digits", "marks", "line_ends", "non_ascii", "distinct", "repeated", "marked_words", "bars", "distinct_pairs", "longest_word", "upper_words")


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """FEATURES of each row of a block. A text without words has 0 for every share."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    low, start, end, first = words(data, offsets)
    count = np.diff(first)
    row = np.repeat(np.arange(n), count)
    share = lambda x, of: x / np.maximum(of, 1)

    def total(flag: np.ndarray, at: np.ndarray = offsets) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flag)])
        return (sums[at[1:]] - sums[at[:-1]]).astype(np.float64)

    upper = (data >= 65) & (data <= 90)
    letters = ((data | 32) >= 97) & ((data | 32) <= 122)
    marks = (data > 32) & (data < 127) & ~letters & ~((data >= 48) & (data <= 57)) & (data != 44) & (data != 46)
    hashed = Rolling(low).of(start, end)
    length = end - start

    def distinct(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
        order = np.lexsort((values, rows))
        v, r = values[order], rows[order]
        fresh = np.ones(len(v), bool)
        fresh[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
        return np.bincount(r[fresh], minlength=n)

    same_row = row[1:] == row[:-1]
    pairs = (hashed[1:] * np.uint64(31) + hashed[:-1])[same_row]
    again = (hashed[1:] == hashed[:-1]) & same_row
    most = np.zeros(n)
    some = np.flatnonzero(count)
    if len(some):
        most[some] = np.maximum.reduceat(length, first[:-1][some])
    marked = marks[end - 1] if len(end) else np.zeros(0, bool)
    ups = upper[start] & upper[np.minimum(start + 1, np.maximum(len(data) - 1, 0))] if len(start) else np.zeros(0, bool)
    return np.stack(
        [
            np.log1p(size), np.log1p(count), share(np.bincount(row, weights=length, minlength=n), count), share(total(upper), size),
            share(total((data >= 48) & (data <= 57)), size), share(total(marks), size), share(total(data == 10), size), share(total(data >= 128), size),
            share(distinct(hashed, row), count), share(np.bincount(row[1:][again], minlength=n), count), share(total(marked, first), count),
            share(total(data == 124), size), share(distinct(pairs, row[1:][same_row]), count), np.log1p(most), share(total(ups, first), count),
        ],
        axis=1,
    )


@dataclass
class Model:
    """Cuts of each feature, its table, and the tables of pairs over coarser cuts."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for k, (cut, table) in enumerate(zip(self.cuts, self.tables)):
            out += table[np.searchsorted(cut, x[:, k], side="right")]
        coarse = [np.searchsorted(cut, x[:, k], side="right") for k, cut in enumerate(self.pair_cuts)]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            out += table[coarse[a], coarse[b]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -40, 40)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="higher"))


def _gain(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g * g / (h + ridge)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float, least: float) -> np.ndarray:
    """Values of a tree of few leaves over ordered bins: the best cut of all parts, again and again."""
    parts = [(0, len(g))]
    sg, sh = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    while len(parts) < leaves:
        best = (1e-9, None)
        for a, b in parts:
            if b - a < 2:
                continue
            at = np.arange(a + 1, b)
            gl, hl, gr, hr = sg[at] - sg[a], sh[at] - sh[a], sg[b] - sg[at], sh[b] - sh[at]
            gain = _gain(gl, hl, ridge) + _gain(gr, hr, ridge) - _gain(sg[b] - sg[a], sh[b] - sh[a], ridge)
            gain[(hl < least) | (hr < least)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (a, int(at[k]), b))
        if best[1] is None:
            break
        a, m, b = best[1]
        parts.remove((a, b))
        parts += [(a, m), (m, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (sg[b] - sg[a]) / (sh[b] - sh[a] + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[np.ndarray, float]:
    """The best tree of one cut along each axis over a grid, and its gain."""
    cg, ch = (np.pad(np.cumsum(np.cumsum(x, 0), 1), ((1, 0), (1, 0))) for x in (g, h))

    def four(c: np.ndarray) -> np.ndarray:
        a = c[1:-1, 1:-1]
        left, top, every = c[1:-1, -1:], c[-1:, 1:-1], c[-1, -1]
        return np.stack([a, left - a, top - a, every - left - top + a])

    if min(g.shape) < 2:
        return np.zeros_like(g), 0.0
    fg, fh = four(cg), four(ch)
    gain = np.where((fh >= least).all(0), _gain(fg, fh, ridge).sum(0), 0) - _gain(cg[-1, -1], ch[-1, -1], ridge)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    value = fg[:, i, j] / (fh[:, i, j] + ridge)
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = value
    return out, float(gain[i, j])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 5.0, least: float = 2.0) -> Model:
    """Fit rows x to labels y, 0 or 1. Without rows, or with one label only, the model is the base rate."""
    n, k = x.shape
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(float(np.log(rate / (1 - rate))), [_cuts(x[:, i], BINS) if n else np.zeros(0) for i in range(k)], [])
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    if not n or y.min() == y.max():
        return model
    binned = [np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(model.cuts)]
    logit = np.full(n, model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for i, b in enumerate(binned):
            g, h = slopes()
            m = len(model.tables[i])
            step = RATE * _tree(np.bincount(b, g, m), np.bincount(b, h, m), 4, ridge, least)
            model.tables[i] += step
            logit += step[b]
    model.pair_cuts = [_cuts(x[:, i], PAIR_BINS) for i in range(k)]
    coarse = [np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(model.pair_cuts)]

    def grid(a: int, b: int, v: np.ndarray) -> np.ndarray:
        shape = (len(model.pair_cuts[a]) + 1, len(model.pair_cuts[b]) + 1)
        return np.bincount(coarse[a] * shape[1] + coarse[b], v, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    ranked = sorted(((_quadrants(grid(a, b, g), grid(a, b, h), ridge, least)[1], a, b) for a in range(k) for b in range(a)), reverse=True)
    model.pairs = [(a, b) for gain, a, b in ranked[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros((len(model.pair_cuts[a]) + 1, len(model.pair_cuts[b]) + 1)) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in zip(model.pairs, model.pair_tables):
            g, h = slopes()
            step = RATE * _quadrants(grid(a, b, g), grid(a, b, h), ridge, least)[0]
            table += step
            logit += step[coarse[a], coarse[b]]
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            got = features(*block(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, got.size + 1, len(FEATURES), dtype=np.int32)), pa.array(got.ravel()))], names=["doc_id", "x"])


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                got = model.score(features(*block(batch.column(batch.schema.get_field_index("text")))))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(got)], names=[*batch.schema.names[:-1], "score"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled rows of docs that aren't held out, the first by a hash of doc_id.

    Rows with a null doc_id or quality are left out; of a doc_id labelled several times, the least label counts, and of
    several texts of one doc_id the one of least figures. Text alone is an input.
    """
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    # The sample is bounded, so it may be broadcast and its figures collected.
    picked = F.broadcast(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    figures = id_and_text(docs).join(picked, "doc_id", "left_semi").mapInArrow(_figures, "doc_id long, x array<double>").join(picked, "doc_id")
    rows = figures.groupBy("doc_id").agg(F.min(F.struct("x", "quality")).alias("r")).orderBy("doc_id").select("r.*").collect()
    x = np.array([r["x"] for r in rows], float).reshape(-1, len(FEATURES))
    return fit(x, np.array([r["quality"] for r in rows], float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 if score >= 0.5) of every row of docs.

    A null text counts as empty; equal texts have equal scores; rows are scored one by one, so repeated rows, extra
    columns and empty tables need no care. A row whose doc_id is null is not held out.
    """
    scored = id_and_text(docs).mapInArrow(_scores(model), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs whose score is at least `least`, with their own columns, whatever their names.

    A null text is scored as an empty one and stays null; a null or repeated doc_id changes nothing, for rows are scored
    one by one and equal texts have equal scores. An empty table gives no rows.
    """
    names = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    id_and_text(docs)
    wide = docs.select(*names, F.coalesce(F.col("text"), F.lit("")).alias("text"))
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema)) + ", score double"
    scored = wide.mapInArrow(_scores(model), schema).where(F.col("score") >= least)
    return scored.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
