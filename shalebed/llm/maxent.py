"""LM scoring by a hashed maximum-entropy model with class-factored softmax.

Words are numbered by how often they occur; classes are runs of numbers of about equal chance. The chance of a word is
that of its class, a softmax with features (word before, class) and (hash of the word before that, class), the skip
feature, times that within its class, a softmax with features (word before, word) beside the words' own shares. A
feature exists for each pair that the training texts hold, so their number grows with the corpus.

Tokens go by the hash of the word before to parts, where all features of that history meet: a part takes gradient steps
on its own features from the counts of its training tokens, needs nothing from other parts, and scores its tokens. Skip
weights are those of a part's histories. A history with more than SHARE training tokens has skip weights of its own: its
features are fitted once, from the counts of all its training tokens, and sent to the shards, by a hash of the document,
that score its tokens.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shalebed.llm.common import binary, materialize, mix, partitions, slices

#: Words with numbers of their own, which every task holds; all others share one, and their counts are joined.
COUNTED = 1 << 18
#: Classes, hashes of the word before the last one, and tokens of a history in one shard.
CLASSES, SKIPS, SHARE = 64, 4096, 1 << 18
#: Variance of the prior of word weights, steps on them, steps on skip weights, and strength of the classes' own shares.
VARIANCE, STEPS, SKIP_STEPS, BACK = 10.0, 4, 2, 1.0
#: The share of the chance that follows counts plus one alone, so no word is worse than its count by far.
FLOOR = 0.05
#: Bytes of text whose tokens are sent together, tokens of a part on average, tokens scored at once, and rows whose sums travel together (at most 2**16).
FLUSH, PART, BATCH, ROWS = 3 << 20, 1 << 19, 1 << 14, 1 << 12
#: Distinct words that a task counts before it hands them on, and counts of frequent histories likewise.
HELD, HELD_PAIRS = 200_000, 4_000_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def tokens(text: str | bytes | None) -> list[bytes]:
    """Words in lower case (A-Z), then the end, written as the empty word."""
    raw = text if isinstance(text, bytes) else (text or "").encode()
    found = raw.lower().split()
    found.append(b"")
    return found


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for text in batch.column(0):
            held.update(tokens(text.as_py()))
            if len(held) > HELD:
                yield out()
                held.clear()
    if held:
        yield out()


def word_counts(docs: DataFrame) -> DataFrame:
    """word (UTF-8 bytes; empty for the end) and n over all rows of docs."""
    return docs.select(F.col("text").cast("binary")).mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Model:
    """Words by number, what follows from their counts, and how histories are dealt."""

    def __init__(self, words: list[bytes], counts: np.ndarray, total: int, kinds: int):
        self.total, self.kinds, self.counts = total, kinds, counts
        self.number = {w: i for i, w in enumerate(words)}
        self.rest_total, self.rest_kinds = total - int(counts.sum()), kinds - len(counts)
        share = np.append(counts + 1.0, self.rest_total + self.rest_kinds + 1.0)
        self.unigram = share / share.sum()
        self.class_of = np.minimum((np.cumsum(self.unigram) * CLASSES).astype(np.int64), CLASSES - 1)
        self.class_share = np.bincount(self.class_of, self.unigram, minlength=CLASSES)
        self.within = self.unigram / self.class_share[self.class_of]
        self.begin = len(counts) + 1  # what stands before a text
        texts = counts[self.number[b""]] if b"" in self.number else 0
        often = np.concatenate([counts, [self.rest_total, texts]])
        self.shards = np.maximum(1, -(-often // SHARE)).astype(np.uint64)

    def read(self, texts: list[str | None], others: bool = True) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
        """Numbers of all tokens (len(counts) for a word not counted here), how many each text has, and the words not counted here, where asked for."""
        get, none = self.number.get, len(self.counts)
        numbers, other = [np.zeros(0, np.int64)], []
        for text in texts:
            found = tokens(text)
            numbers.append(np.fromiter(map(get, found, itertools.repeat(none)), np.int64, len(found)))
            if others:
                other.append([found[i] for i in np.flatnonzero(numbers[-1] == none).tolist()])
        return np.concatenate(numbers), np.array([len(x) for x in numbers[1:]], np.int64), other

    def history(self, word: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the word before each token and of the one before that."""
        begin = np.cumsum(size) - size
        one = np.concatenate([[self.begin], word[:-1]])
        one[begin] = self.begin
        two = np.concatenate([[self.begin], one[:-1]])
        two[begin] = self.begin
        return one, two


def numbered(counts: DataFrame) -> Model:
    """The model's words: the COUNTED most frequent ones, with what follows from the counts; of those that are as frequent as the last, the ones of least hash."""
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # The least count of which all words fit, to a sixteenth of a power of two; words just below it fill what is left.
    step = F.floor(F.log2("n") * 16).cast("int")
    sizes = {r["step"]: r["words"] for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()}
    held, below = 0, None
    for k in sorted(sizes, reverse=True):
        if held + sizes[k] > COUNTED:
            below = k
            break
        held += sizes[k]
    chosen = counts if below is None else counts.where(step > below).unionByName(counts.where(step == below).orderBy(F.desc("n"), F.xxhash64("word"), "word").limit(COUNTED - held))
    top = chosen.toPandas().sort_values(["n", "word"], ascending=[False, True])  # bounded by COUNTED
    return Model([bytes(w) for w in top["word"]], top["n"].to_numpy(np.int64), int(whole["n"]), int(whole["v"]))


def _skip(two: np.ndarray) -> np.ndarray:
    return (mix(two.astype(np.uint64)) % np.uint64(SKIPS)).astype(np.uint16)


def _part_of(history: np.ndarray, shard: np.ndarray, parts: int) -> np.ndarray:
    return (mix(history.astype(np.uint64) * _GOLD + shard) % np.uint64(parts)).astype(np.int64)


def _send(model: Model, parts: int):
    """Tokens by part: numbers of the word before and of the token, hash of the word before that, and place of the row, twice, plus 1 in training rows."""

    def out(first: int, place: list, word: list, one: list, two: list, salt: list) -> pa.RecordBatch:
        p, w, a, b, s = (np.concatenate(x) for x in (place, word, one, two, salt))
        shard = s % model.shards[a]
        part = _part_of(a, shard, parts)
        order = np.lexsort((shard, a, part))
        bounds = np.searchsorted(part[order], np.arange(parts + 1))
        history = (a.astype(np.uint64) | shard << np.uint64(32))[order]
        w, p, skip = w[order].astype(np.uint32), p[order].astype(np.uint32), _skip(b)[order]
        some = np.flatnonzero(np.diff(bounds))
        cut = lambda x: binary([x[bounds[i] : bounds[i + 1]].tobytes() for i in some])
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), first)), cut(history), cut(w), cut(skip), cut(p)], names=["part", "first", "history", "word", "skip", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(5)]
        size, first = 0, 0
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = batch.column(0).to_numpy()
                if not size:
                    first = int(rows[0])
                word, many, _ = model.read(batch.column(batch.schema.get_field_index("text")).to_pylist(), others=False)
                one, two = model.history(word, many)
                owner = np.repeat(np.arange(len(rows)), many)
                place = 2 * (rows[owner] - first) + batch.column(2).to_numpy(zero_copy_only=False)[owner]
                for to, x in zip(held, (place, word, one, two, batch.column(1).to_numpy().view(np.uint64)[owner])):
                    to.append(x)
                size += len(word)
                if size * 8 > FLUSH:
                    yield out(first, *held)
                    held, size = [[] for _ in range(5)], 0
        if size:
            yield out(first, *held)

    return run


def _starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def fit_words(model: Model, history: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, ...]:
    """Weights of the pairs (history, word) of training tokens, and what they make of the chances within a class.

    Returns the pairs' keys (history number and word) with their weights, and the keys (history and class) with the
    logarithm of what all words of the class sum up to. history is numbered from 0.
    """
    return fit_pairs(model, *np.unique(history * len(model.unigram) + word, return_counts=True))


def fit_pairs(model: Model, keys: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """fit_words from the pairs' keys, in order, and how often they occur."""
    n_words = len(model.unigram)
    who, w = keys // n_words, keys % n_words
    group = who * CLASSES + model.class_of[w]  # classes are runs of numbers, so groups are in order
    start = _starts(group)
    of = np.cumsum(np.bincount(start, minlength=len(group))) - 1 if len(group) else start
    share = model.within[w]
    total = np.add.reduceat(count, start).astype(float) if len(start) else np.zeros(0)
    weight = np.clip(np.log(0.4 * count / np.maximum(total[of], 1) / share), 0, 25) if len(start) else np.zeros(0)
    sums = total
    for k in range(STEPS + 1):
        whole = share * np.exp(weight)
        sums = np.maximum(1 + np.add.reduceat(whole - share, start), 1e-9) if len(start) else sums
        if k == STEPS:
            break
        chance = whole / sums[of]
        slope = count - total[of] * chance - weight / VARIANCE
        weight += 0.8 * np.clip(slope / (total[of] * chance * (1 - chance) + 1 / VARIANCE), -1, 1)
    return keys, weight, group[start], np.log(sums)


def fit_classes(model: Model, history: np.ndarray, skip: np.ndarray, word: np.ndarray, histories: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of (history, class) and (skip, class) from training tokens: the first from counts, the second by gradient steps beside them."""
    class_ = model.class_of[word]
    met = np.bincount(history * CLASSES + class_, minlength=histories * CLASSES).reshape(histories, CLASSES).astype(np.float32)
    back = BACK * (met > 0).sum(1, keepdims=True) + 1e-3
    a = np.log((met + back * np.maximum(model.class_share, 1e-30)) / (met.sum(1, keepdims=True) + back)).astype(np.float32)
    b = np.zeros((SKIPS, CLASSES), np.float32)
    wanted = np.bincount(skip.astype(np.int64) * CLASSES + class_, minlength=SKIPS * CLASSES).reshape(SKIPS, CLASSES)
    scale = 0.5 / (wanted.sum(1, keepdims=True) * model.class_share + 2)
    order = np.argsort(skip, kind="stable")
    for _ in range(SKIP_STEPS):
        expected = np.zeros((SKIPS, CLASSES))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            x = a[history[some]]
            x += b[skip[some]]
            np.exp(x, out=x)
            x /= x.sum(1, keepdims=True)
            start = _starts(skip[some])
            expected[skip[some[start]]] += np.add.reduceat(x, start)
        b += np.clip(scale * (wanted - expected - 2 * b), -1, 1).astype(np.float32)
    return a, b


def _counted(model: Model, word: np.ndarray, size: np.ndarray, train: np.ndarray) -> np.ndarray:
    """What to count of the training tokens with a frequent history: history and word, and, below 0, history, skip and class."""
    one, two = model.history(word, size)
    some = np.flatnonzero((model.shards[one] > 1) & np.repeat(train, size))
    a, w = one[some], word[some]
    return np.concatenate([a * len(model.unigram) + w, -1 - ((a * SKIPS + _skip(two[some])) * CLASSES + model.class_of[w])])


def _pack(held: list[np.ndarray]) -> bytes:
    keys, count = np.unique(np.concatenate(held), return_counts=True)
    return zlib.compress(np.diff(keys, prepend=0).tobytes() + count.astype(np.int64).tobytes(), 1)


def _unpack(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0):
                raw = np.frombuffer(zlib.decompress(packed.as_py()), np.int64)
                keys, count = np.cumsum(raw[: len(raw) // 2]), raw[len(raw) // 2 :]
                history = np.where(keys >= 0, keys // len(model.unigram), (-1 - keys) // (SKIPS * CLASSES))
                for at in range(0, len(keys), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]) for x in (history, keys, count)], names=["history", "key", "n"])

    return run


def fit_history(model: Model, keys: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """The features of one history from the counts of all its training tokens, as _counted has them.

    Words and their weights, classes and the logarithm of what their words sum up to, skip hashes, and the logarithms of
    the classes' chances: in the first row after any other skip hash, then after each of those.
    """
    order = np.argsort(keys)
    keys, count = keys[order], count[order]
    pair = keys >= 0
    words, weight, groups, sums = fit_pairs(model, keys[pair] % len(model.unigram), count[pair])
    cell = (-1 - keys[~pair]) % (SKIPS * CLASSES)
    wanted = np.bincount(cell, count[~pair], minlength=SKIPS * CLASSES).reshape(SKIPS, CLASSES)
    met, total = wanted.sum(0), wanted.sum(1, keepdims=True)
    back = BACK * (met > 0).sum() + 1e-3
    a = np.log((met + back * np.maximum(model.class_share, 1e-30)) / (met.sum() + back))
    b = np.zeros((SKIPS, CLASSES))
    scale = 0.5 / (total * model.class_share + 2)
    for _ in range(SKIP_STEPS):
        x = np.exp(a + b)
        b += np.clip(scale * (wanted - total * x / x.sum(1, keepdims=True) - 2 * b), -1, 1)
    skips = np.flatnonzero(total[:, 0])
    log = a + np.concatenate([np.zeros((1, CLASSES)), b[skips]])
    return words, weight, groups, sums, skips, log - np.log(np.exp(log).sum(1, keepdims=True))


def _fit(model: Model, parts: int):
    """Features of a frequent history as a row like those of _send, with first below 0, and the parts that score its tokens."""

    def run(table: pd.DataFrame) -> pd.DataFrame:
        history = int(table["history"].iloc[0])
        words, weight, groups, sums, skips, log = fit_history(model, table["key"].to_numpy(np.int64), table["n"].to_numpy(np.int64))
        to = np.unique(_part_of(np.array([history]), np.arange(int(model.shards[history]), dtype=np.uint64), parts)).tolist()
        cut = lambda x, t: x.astype(t).tobytes()
        return pd.DataFrame({"parts": [to], "first": [-1 - history], "history": [cut(np.concatenate([[len(words)], words, groups]), np.uint32)], "word": [cut(weight, np.float32) + cut(sums, np.float32)], "skip": [cut(skips, np.uint16)], "place": [cut(log, np.float32)]})

    return run


def frequent_chances(model: Model, features: tuple, skip: np.ndarray, word: np.ndarray) -> np.ndarray:
    """log10 chances of tokens after the history of these features."""
    words, weight, groups, sums, skips, log = features
    class_ = model.class_of[word]
    row = np.zeros(SKIPS, np.int64)
    row[skips] = np.arange(1, len(skips) + 1)
    out = np.log(model.within[word]) + _find(words, weight, word) - _find(groups, sums, class_) + log[row[skip], class_]
    return np.log10((1 - FLOOR) * np.exp(out) + FLOOR * model.unigram[word])


def _features(row) -> tuple:
    keys, values, log = np.frombuffer(row.history, np.uint32).astype(np.int64), np.frombuffer(row.word, np.float32), np.frombuffer(row.place, np.float32).reshape(-1, CLASSES)
    n = int(keys[0])
    keys = keys[1:]
    return keys[:n], values[:n].astype(float), keys[n:], values[n:].astype(float), np.frombuffer(row.skip, np.uint16).astype(np.int64), log


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The value of each wanted key, 0 where there is none; keys are sorted."""
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def log_chances(model: Model, history: np.ndarray, skip: np.ndarray, word: np.ndarray, train: np.ndarray) -> np.ndarray:
    """log10 chances of all tokens of a part by features of its training tokens."""
    names, who = np.unique(history, return_inverse=True)
    known = np.flatnonzero(train)
    keys, weight, groups, sums = fit_words(model, who[known], word[known])
    a, b = fit_classes(model, who[known], skip[known], word[known], len(names))
    class_ = model.class_of[word]
    out = np.log(model.within[word]) + _find(keys, weight, who * len(model.unigram) + word) - _find(groups, sums, who * CLASSES + class_)
    for at in range(0, len(word), BATCH):
        x = a[who[at : at + BATCH]]
        x += b[skip[at : at + BATCH]]
        chosen = x[np.arange(len(x)), class_[at : at + BATCH]].astype(np.float64)
        out[at : at + BATCH] += chosen - np.log(np.exp(x, out=x).sum(1, dtype=np.float64))
    return np.log10((1 - FLOOR) * np.exp(out) + FLOOR * model.unigram[word])


def _part(model: Model, groups: int):
    def run(table: pd.DataFrame) -> pd.DataFrame:
        features = {-1 - row.first: _features(row) for row in table[table["first"] < 0].itertuples()}
        table = table[table["first"] >= 0].sort_values("first")
        if table.empty:
            return pd.DataFrame({"group": [], "block": [], "rows": [], "sums": []})
        read = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in table[c]])
        place = read("place", np.uint32).astype(np.int64)
        row = np.repeat(table["first"].to_numpy(np.int64), [len(x) // 4 for x in table["place"]]) + place // 2
        history, skip, word = read("history", np.uint64).astype(np.int64) & 0xFFFFFFFF, read("skip", np.uint16).astype(np.int64), read("word", np.uint32).astype(np.int64)
        log = np.empty(len(word))
        often = model.shards[history] > 1
        rare = np.flatnonzero(~often)
        if len(rare):
            log[rare] = log_chances(model, history[rare], skip[rare], word[rare], place[rare] % 2 == 1)
        for h in np.unique(history[often]).tolist():
            some = np.flatnonzero(history == h)
            log[some] = frequent_chances(model, features[h], skip[some], word[some])
        order = np.argsort(row, kind="stable")
        row, log = row[order], log[order]
        start = _starts(row)
        row, sums = row[start], np.add.reduceat(log, start)
        cut = _starts(row // ROWS)
        ends = [*cut[1:], len(row)]
        block = row[cut] // ROWS
        inside, sums = (row % ROWS).astype(np.uint16), sums.astype(np.float32)
        group = (mix(block.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)
        return pd.DataFrame({"group": group, "block": block, "rows": [inside[i:j].tobytes() for i, j in zip(cut, ends)], "sums": [sums[i:j].tobytes() for i, j in zip(cut, ends)]})

    return run


def _add(table: pd.DataFrame) -> pd.DataFrame:
    found = []
    for block, some in table.sort_values(["block", "rows"]).groupby("block"):  # in one order, so sums come out the same
        inside = np.concatenate([np.frombuffer(x, np.uint16) for x in some["rows"]])
        sums = np.concatenate([np.frombuffer(x, np.float32) for x in some["sums"]])
        whole, met = np.bincount(inside, sums, minlength=ROWS), np.bincount(inside, minlength=ROWS) > 0
        found.append(pd.DataFrame({"row": block * ROWS + np.flatnonzero(met), "model": whole[met]}))
    return pd.concat(found)


def _base(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.log10((np.append(model.counts, 0) + 1) / (model.total + model.kinds + 1))
        names = ["row", "doc_id", "n_tokens", "n_known", "base_score", "other", "packed"]
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            none = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())])))]
            return pa.RecordBatch.from_arrays([*none, binary([_pack(held)])], names=names)

        for whole in batches:
            for batch in slices(whole, "text"):
                number, size, other = model.read(batch.column(batch.schema.get_field_index("text")).to_pylist())
                if (model.shards > 1).any():
                    held.append(_counted(model, number, size, batch.column(3).to_numpy(zero_copy_only=False)))
                    if sum(map(len, held)) > HELD_PAIRS:
                        yield out()
                        held.clear()
                begin = np.cumsum(size) - size
                here = number < len(model.counts)
                add = lambda x: pa.array(np.add.reduceat(x, begin))
                pairs = [list(Counter(x).items()) for x in other]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in pairs])]).astype(np.int32)
                flat = list(itertools.chain.from_iterable(pairs))
                items = pa.StructArray.from_arrays([pa.array([w for w, _ in flat], pa.binary()), pa.array([n for _, n in flat], pa.int64())], names=["word", "times"])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size), add(here.astype(np.int64)), add(np.where(here, base[number], 0.0)), pa.ListArray.from_arrays(pa.array(ends), items), pa.nulls(len(size), pa.binary())], names=names)
        if held:
            yield out()

    return run


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 chances) of every row of docs, by features of the rows that aren't held out.

    docs has doc_id and text; other columns are not read. It is read twice and must give its rows in the same order, as
    tables on disk do. A null or empty text is the end alone. Rows of equal doc_id are scored one by one; a row whose doc_id is null is not held out. An empty table gives no rows; a model without
    training tokens knows no word and gives all to those it doesn't know.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), doc_id.alias("doc_id"), text.alias("text"), (~held_out(doc_id)).alias("train"))
    scored = materialize(rows.mapInArrow(lambda it: _base(shared.value)(it), "row long, doc_id long, n_tokens long, n_known long, base_score double, other array<struct<word:binary,times:long>>, packed binary"), "scored")
    n = scored.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n"), F.count("row").alias("rows")).first()
    parts, groups = max(partitions(spark), math.ceil(n["n"] / PART)), max(partitions(spark), math.ceil(n["rows"] / ROWS))
    salted = docs.select(F.monotonically_increasing_id().alias("row"), F.xxhash64(F.coalesce(doc_id, F.xxhash64("text"))).alias("salt"), (~held_out(doc_id)).alias("train"), text.alias("text"))
    sent = salted.mapInArrow(lambda it: _send(shared.value, parts)(it), "part int, first long, history binary, word binary, skip binary, place binary")
    if (model.shards > 1).any():
        met = scored.where("packed is not null").select("packed").mapInArrow(lambda it: _unpack(shared.value)(it), "history long, key long, n long").groupBy("history", "key").agg(F.sum("n").alias("n"))
        fitted = materialize(met.groupBy("history").applyInPandas(lambda t: _fit(shared.value, parts)(t), "parts array<int>, first long, history binary, word binary, skip binary, place binary"), "fitted")
        sent = sent.unionByName(fitted.select(F.explode("parts").alias("part"), "first", "history", "word", "skip", "place"))
    partial = sent.groupBy("part").applyInPandas(lambda t: _part(shared.value, groups)(t), "group long, block long, rows binary, sums binary")
    summed = materialize(partial.groupBy("group").applyInPandas(_add, "row long, model double"), "summed")
    others = scored.select("row", F.inline("other"))
    c = F.coalesce("n", F.lit(0))
    log = lambda total: F.sum(F.col("times") * F.log10((c + 1) / F.lit(float(total))))
    looked_up = others.join(counts, "word", "left").groupBy("row").agg(F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("k"), log(model.total + model.kinds + 1).alias("b"), log(model.rest_total + model.rest_kinds + 1).alias("s"))
    zero = lambda x: F.coalesce(x, F.lit(0))
    return scored.drop("other", "packed").join(summed, "row").join(looked_up, "row", "left").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("n_known") + zero("k")).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), (F.col("base_score") + zero("b")).alias("base_score"), (F.col("model") + zero("s")).alias("score"))


def score_documents(docs: DataFrame) -> DataFrame:
    """Scores of all rows of docs by a model of those that aren't held out."""
    if int(docs.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1024:
        docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if "Exchange" in known._jdf.queryExecution().executedPlan().toString():
        known = materialize(known, "known")  # rows are numbered twice and must come in the same order
    counts = materialize(word_counts(known.where(~held_out(F.col("doc_id")))), "counts")
    return score(known, numbered(counts), counts)
