"""SentencePiece encoding and decoding with distinct sampled segmentations: Gumbel top-k by perturbed A-star search.

Text, blanks written as U+2581, falls into units that no piece crosses. A unit's lattice gives each place the chances of
the pieces that may come next, by weights summed backward over all ways to the end. A segmentation is a path of such
choices through all units. The search keeps, for each path found, the perturbed score of what its every step left out;
the best of those is the next path, so paths come in falling order of log-probability plus Gumbel noise, none twice.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shalebed.llm.common import Rolling, binary, id_and_text, mix, slices, spread

SAMPLES, ALPHA = 2, 0.5
BLANK = "▁"
_BLANK = BLANK.encode()
#: Units whose lattices a worker remembers, bytes of text done at once (one longer text alone), and bytes of a long unit.
REMEMBERED, BYTES, LONG = 160_000, 1 << 20, 256
_UNIT = np.uint64(0x9E3779B97F4A7C15)


def _uniform(key: np.ndarray) -> np.ndarray:
    return (mix(key * _UNIT) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54


def _hash(rolling: Rolling, at: np.ndarray, size: int) -> np.ndarray:
    return (rolling.sums[size:][at] - rolling.sums[at]) * rolling.down[at]


def _four(data: np.ndarray) -> np.ndarray:
    """A 16-bit hash of each byte and the three after it."""
    padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
    n = len(data)
    return ((padded[:n] | padded[1 : n + 1] << np.uint32(8) | padded[2 : n + 2] << np.uint32(16) | padded[3:] << np.uint32(24)) * np.uint32(2654435761)) >> np.uint32(16)


class _Numbers(dict):
    def __missing__(self, unit: str) -> int:
        self[unit] = at = len(self)
        return at


class Pieces:
    """The vocabulary of a SentencePiece model and the lattices of units.

    The chance of a piece falls as one over its rank by the model's scores, raised to the power alpha; characters
    outside the vocabulary are written byte by byte.
    """

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        rank = np.zeros(n)
        rank[sorted(plain, key=lambda i: -model.get_score(i))] = np.arange(1, len(plain) + 1)
        chance = np.where(rank > 0, 1 / (rank + 10), 0)
        self.weight = np.log(np.where(chance > 0, chance / chance.sum(), 1e-9)) * alpha
        raw = [b""] * n
        for i in plain:
            raw[i] = model.id_to_piece(i).encode()
        self.byte = np.zeros(256, np.int64)
        for i in range(n):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                raw[i], self.byte[value] = bytes([value]), i
        self.size = np.array([len(x) for x in raw], np.int64)
        self.bytes, self.begin = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(self.size) - self.size
        self.by_size: list[tuple] = []
        self.reach = np.zeros(1 << 16, np.int64)  # by a hash of four bytes: the longest piece that begins with them
        for size in np.unique(self.size[plain]).tolist():
            ids = np.array([i for i in plain if self.size[i] == size])
            data = np.frombuffer(b"".join(raw[i] for i in ids), np.uint8)
            at = np.arange(len(ids)) * size
            hashed = _hash(Rolling(data), at, size)
            order = np.argsort(hashed)
            maybe = np.zeros(1 << 16, bool)  # by the hash's first 16 bits
            maybe[hashed >> np.uint64(48)] = True
            self.by_size.append((size, hashed[order], ids[order], maybe))
            if size >= 4:
                np.maximum.at(self.reach, _four(data)[at], size)
        self._clear()

    def _clear(self) -> None:
        self.numbers = _Numbers()
        self.start = np.zeros(0, np.int64)  # each unit's first place; places of all units are numbered on
        self.first = np.zeros(1, np.int64)  # of each place its first edge, and the number of edges
        self.edge_id = np.zeros(0, np.int32)
        self.edge_log = np.zeros(0)
        self.upto = np.zeros(0, np.float32)  # of each edge: the chances of the place's edges up to it, 2 for the last
        self.last = np.zeros(0, bool)  # of each place: a unit ends here
        self.used = np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keep the units met more than once since the last time, at most half as many as may be."""
        keep = np.flatnonzero(self.used > 1)
        if 2 * len(keep) > REMEMBERED:
            keep = np.sort(keep[np.argsort(-self.used[keep], kind="stable")[: REMEMBERED // 2]])
        names = list(self.numbers)
        stop = np.append(self.start, len(self.last))
        size = stop[keep + 1] - stop[keep]
        places = spread(stop[keep], size)
        many = np.diff(self.first)[places]
        edges = spread(self.first[:-1][places], many)
        kept = np.cumsum(size) - size, np.concatenate([[0], np.cumsum(many)]), self.edge_id[edges], self.edge_log[edges], self.upto[edges], self.last[places]
        self._clear()
        self.start, self.first, self.edge_id, self.edge_log, self.upto, self.last = kept
        for k in keep.tolist():
            self.numbers[names[k]]  # numbers it
        self.used = np.zeros(len(keep), np.int64)

    def _matches(self, data: np.ndarray, room: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Pieces that begin at each place and end within its room, as (size, places, ids), the longest first; then bytes."""
        rolling = Rolling(data)
        lead = (data & 0xC0) != 0x80
        char = np.select([data < 0x80, data < 0xE0, data < 0xF0], [1, 2, 3], 4)
        bare = lead.copy()  # no piece is this character alone
        at = np.flatnonzero(lead)
        left = room[at]
        found, four = [], False
        for n, hashed, ids, maybe in self.by_size:
            if n >= 4 and not four:
                left, four = np.minimum(left, self.reach[_four(data)[at]]), True
            live = left >= n
            at, left = at[live], left[live]
            h = _hash(rolling, at, n)
            some = np.flatnonzero(maybe[h >> np.uint64(48)])
            k = np.minimum(np.searchsorted(hashed, h[some]), len(hashed) - 1)
            hit = hashed[k] == h[some]
            spot = at[some[hit]]
            found.append((n, spot, ids[k[hit]]))
            bare[spot[char[spot] == n]] = False
        spot = np.flatnonzero(bare)
        spot = spread(spot, np.minimum(char[spot], room[spot]))
        return [*reversed(found), (1, spot, self.byte[data[spot]])]

    def learn(self) -> None:
        """Lattices of the units that were numbered since the last time. A unit's lattice depends on the unit alone."""
        new = [u.encode() for u in itertools.islice(self.numbers, len(self.start), None)]
        if not new:
            return
        data = np.frombuffer(b"".join(new), np.uint8)
        size = np.array([len(u) for u in new], np.int64)
        stop = np.cumsum(size)
        unit = np.repeat(np.arange(len(new)), size)
        found = self._matches(data, stop[unit] - np.arange(len(data)))
        # A unit has one more place than bytes: its end.
        n = len(data) + len(new)
        ends = stop + np.arange(len(new))
        slots = [at + unit[at] for _, at, _ in found]
        many = np.zeros(n, np.int64)
        for p in slots:
            many[p] += 1
        first = np.cumsum(many) - many
        ids = np.empty(int(many.sum()), np.int64)
        to = first.copy()
        for p, (_, _, i) in zip(slots, found):
            ids[to[p]] = i
            to[p] += 1
        place = np.repeat(np.arange(n), many)
        log = self._backward(ends, size, first, many, ids, place)
        good = np.isfinite(log)
        if not good.all():
            ids, log = ids[good], log[good]
            many = np.bincount(place[good], minlength=n)
            first = np.cumsum(many) - many
        chance = np.exp(log)
        some, k = np.flatnonzero(many > 1), 1
        while len(some):
            edge = first[some] + k
            chance[edge] += chance[edge - 1]
            k += 1
            some = some[many[some] > k]
        some = np.flatnonzero(many)
        chance[first[some] + many[some] - 1] = 2
        last = np.zeros(n, bool)
        last[ends] = True
        self.start = np.concatenate([self.start, len(self.last) + ends - size])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(many)])
        self.edge_id, self.edge_log = np.concatenate([self.edge_id, ids.astype(np.int32)]), np.concatenate([self.edge_log, log])
        self.upto, self.last = np.concatenate([self.upto, chance.astype(np.float32)]), np.concatenate([self.last, last])

    def _backward(self, ends: np.ndarray, size: np.ndarray, first: np.ndarray, many: np.ndarray, ids: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Each edge's log-chance at its place, by weights summed over all ways from there to the unit's end."""
        weight, goal = self.weight[ids], place + self.size[ids]
        total = np.full(len(many), -np.inf)
        total[ends] = 0
        log = np.empty(len(ids))
        order = np.argsort(size, kind="stable")
        short = order[: int(np.searchsorted(size[order], LONG, side="right"))]
        by_size = size[short]
        for left in range(1, int(by_size[-1]) + 1 if len(short) else 0):
            p = ends[short[int(np.searchsorted(by_size, left)) :]] - left
            p = p[many[p] > 0]
            if not len(p):
                continue
            m = many[p]
            e = spread(first[p], m)
            value = weight[e] + total[goal[e]]
            head = np.cumsum(m) - m
            most = np.maximum.reduceat(value, head)
            most = np.where(np.isfinite(most), most, 0)
            with np.errstate(divide="ignore"):
                sums = most + np.log(np.add.reduceat(np.exp(value - np.repeat(most, m)), head))
            total[p] = sums
            log[e] = value - np.repeat(np.where(np.isfinite(sums), sums, 0), m)
        for u in order[len(short) :].tolist():
            # Few units are so long; a step for every byte of one is cheaper without arrays.
            at, to = int(ends[u] - size[u]), int(ends[u])
            a, b = int(first[at]), int(first[to])
            w, g = weight[a:b].tolist(), (goal[a:b] - at).tolist()
            head, sum_ = (first[at : to + 1] - a).tolist(), [-math.inf] * int(size[u]) + [0.0]
            got = [0.0] * len(w)
            for k in range(to - at - 1, -1, -1):
                values = [w[e] + sum_[g[e]] for e in range(head[k], head[k + 1])]
                most = max(values, default=-math.inf)
                if most > -math.inf:
                    sum_[k] = most + math.log(sum(math.exp(v - most) for v in values))
                for e, v in zip(range(head[k], head[k + 1]), values):
                    got[e] = v - sum_[k] if most > -math.inf else -math.inf
            log[a:b] = got
        return np.minimum(log, 0)

    def units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the units of all texts, and how many each text has."""
        if len(self.numbers) > REMEMBERED:
            self._forget()
        flat: list[int] = []
        count = []
        number = self.numbers.__getitem__
        for text in texts:
            had = len(flat)
            if text:
                whole = (" " + text).replace(BLANK, " ")
                parts = whole.split(" ")
                if "" in parts[1:]:
                    # Blanks in a row begin one unit together.
                    joined, run = [], ""
                    for part in parts[1:]:
                        run += BLANK
                        if part:
                            joined.append(run + part)
                            run = ""
                    if run:
                        joined.append(run)
                    flat.extend(map(number, joined))
                else:
                    flat.extend(map(number, [BLANK + p for p in parts[1:]]))
            count.append(len(flat) - had)
        self.learn()
        unit = np.array(flat, np.int64)
        used = np.bincount(unit, minlength=len(self.start))
        used[: len(self.used)] += self.used
        self.used = used
        return unit, np.array(count, np.int64)

    def walk(self, start: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Random paths from each start to the end of its unit: the edges, walk after walk, and how many each walk has."""
        now, who = start.copy(), np.arange(len(start))
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        many = np.zeros(len(start), np.int64)
        live = ~self.last[now]
        now, who = now[live], who[live]
        while len(now):
            aim = _uniform(key[who] + np.uint64(len(steps)))
            edge = self.first[now]
            beyond = np.flatnonzero(self.upto[edge] < aim)
            while len(beyond):
                edge[beyond] += 1
                beyond = beyond[self.upto[edge[beyond]] < aim[beyond]]
            steps.append((who, edge))
            many[who] += 1
            now = now + self.size[self.edge_id[edge]]
            live = ~self.last[now]
            now, who = now[live], who[live]
        at = np.cumsum(many) - many
        out = np.empty(int(many.sum()), np.int64)
        for k, (who, edge) in enumerate(steps):
            out[at[who] + k] = edge
        return out, many

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Texts of ids: the pieces' bytes without the first blank, marks read as blanks."""
        flat = self.bytes[spread(self.begin[ids], self.size[ids])].tobytes()
        ends = np.concatenate([[0], np.cumsum(self.size[ids])])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        return [flat[a:b].replace(_BLANK, b" ")[1:] for a, b in zip(ends, ends[1:])]


def _truncated(log: np.ndarray, most: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Gumbel noise of location log, no more than most."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        x = np.log(-np.log(noise)) - log
        return np.where(np.isfinite(log), -np.logaddexp(-most, np.where(np.isfinite(x), x, np.inf)), -np.inf)


def _leftover(before: np.ndarray, used: np.ndarray) -> np.ndarray:
    """The log-chance of all that a step leaves out, given the log-chance before it and the chances that are used up."""
    rest = 1 - used
    some = rest > 1e-12
    return np.where(some, before + np.log(np.where(some, rest, 1)), -np.inf)


class _Paths:
    """One path of each text: its edges, the log-chance before each step, the chances that a step has used up and the scores of what it left out."""

    def __init__(self, pieces: Pieces, edges: np.ndarray, unit: np.ndarray, bound: np.ndarray):
        self.edges, self.unit, self.bound = edges, unit, bound
        self.size = np.diff(bound)
        self.some = np.flatnonzero(self.size)
        self.row = np.repeat(np.arange(len(self.size)), self.size)
        self.step = np.arange(len(edges)) - bound[:-1][self.row]
        log = pieces.edge_log[edges]
        sums = np.empty(len(log))
        for a, b in zip(bound[:-1].tolist(), bound[1:].tolist()):
            np.cumsum(log[a:b], out=sums[a:b])  # text by text, so a text's sums are the same in any batch
        self.before = np.zeros(len(log))
        self.before[1:] = sums[:-1]
        self.before[bound[:-1][self.some]] = 0
        self.log_prob = np.zeros(len(self.size))
        self.log_prob[self.some] = sums[bound[1:][self.some] - 1]
        self.used = np.exp(log)
        self.open = np.zeros(0)

    def rank(self) -> None:
        """Find each text's best open score and its step, counted from the first text's first."""
        self.best, self.at = np.full(len(self.size), -np.inf), np.zeros(len(self.size), np.int64)
        if len(self.some):
            head = self.bound[:-1][self.some]
            most = np.maximum.reduceat(self.open, head)
            hits = np.flatnonzero(self.open == np.repeat(most, self.size[self.some]))
            self.best[self.some], self.at[self.some] = most, hits[np.searchsorted(hits, head)]


def sample(pieces: Pieces, texts: list[str], keys: np.ndarray, k: int) -> list[tuple[np.ndarray, ...]]:
    """Up to k distinct segmentations of each text, best perturbed score first: (text, rank, ids, log-probability, score, inclusion).

    All noise is numbered within the text, so a text's samples depend on its key and on nothing beside it.
    """
    unit, count = pieces.units(texts)
    n = len(texts)
    stop = np.cumsum(count)
    begin = stop - count
    row = np.repeat(np.arange(n), count)
    base = mix(keys)
    seat = np.arange(len(unit)) - begin[row]

    def salted(text: np.ndarray, salt: int) -> np.ndarray:
        return mix(base[text] + np.uint64(salt * int(_UNIT) % 2**64))

    def noise(text: np.ndarray, purpose: int, number: np.ndarray) -> np.ndarray:
        return _uniform(salted(text, 2 * purpose + 1) + number.astype(np.uint64))

    def unit_key(which: np.ndarray, rank: int) -> np.ndarray:
        return mix(salted(row[which], 2 * rank + 2) + seat[which].astype(np.uint64))

    start = pieces.start[unit]
    edges, steps = pieces.walk(start, unit_key(np.arange(len(unit)), 0))
    paths = [_Paths(pieces, edges, np.repeat(np.arange(len(unit)), steps), np.concatenate([[0], np.cumsum(steps)])[np.concatenate([begin, [len(unit)]])])]
    one = paths[0]
    root = -np.log(-np.log(noise(np.arange(n), 0, np.zeros(n, np.int64))))
    one.open = _truncated(_leftover(one.before, one.used), root[one.row], noise(one.row, 1, one.step))
    one.rank()
    scores = [root]
    from_, at_, new_ = [np.full(n, -1)], [np.full(n, -1)], [np.full(n, -1)]
    for rank in range(1, k):
        best = np.stack([p.best for p in paths])
        which = best.argmax(0)
        score = best.max(0)
        jobs = np.flatnonzero(np.isfinite(score))
        scores.append(np.where(np.isfinite(score), score, -np.inf))
        parent = which[jobs]
        at = np.stack([p.at[jobs] for p in paths])[parent, np.arange(len(jobs))]
        taken, where, before, used = np.empty(len(jobs), np.int64), np.empty(len(jobs), np.int64), np.empty(len(jobs)), np.empty(len(jobs))
        for q, p in enumerate(paths):
            mine = parent == q
            taken[mine], where[mine], before[mine], used[mine] = p.edges[at[mine]], p.unit[at[mine]], p.before[at[mine]], p.used[at[mine]]
        # What may come next instead, as a row of options for each text; what paths through this step took is none.
        place = np.searchsorted(pieces.first, taken, side="right") - 1
        many = pieces.first[place + 1] - pieces.first[place]
        option = pieces.first[place][:, None] + np.arange(int(many.max(initial=1)))
        free = (np.arange(option.shape[1]) < many[:, None]) & (option != taken[:, None])
        for f, a, e in zip(from_, at_, new_):
            same = (f[jobs] == parent) & (a[jobs] == at)
            free &= ~(same[:, None] & (option == e[jobs][:, None]))
        chance = np.where(free, np.exp(pieces.edge_log[np.where(free, option, 0)]), 0)
        sums = np.cumsum(chance, axis=1)
        aim = noise(jobs, 4 * rank, np.zeros(len(jobs), np.int64)) * sums[:, -1]
        spot = (sums <= aim[:, None]).sum(1)
        spot = np.minimum(spot, option.shape[1] - 1 - free[:, ::-1].argmax(1))
        new = option[np.arange(len(jobs)), spot]
        used += np.exp(pieces.edge_log[new])
        step = np.empty(len(jobs), np.int64)
        for q, p in enumerate(paths):
            mine = np.flatnonzero(parent == q)
            step[mine] = p.step[at[mine]]
            p.used[at[mine]] = used[mine]
            left = np.where(free[mine].sum(1) > 1, _leftover(before[mine], used[mine]), -np.inf)
            p.open[at[mine]] = _truncated(left, score[jobs[mine]], noise(jobs[mine], 4 * rank + 1, step[mine]))
        # The rest of the unit from there, then all later units of the text.
        rest = stop[jobs] - where
        which_unit = spread(where, rest)
        head = np.cumsum(rest) - rest
        starts = start[which_unit]
        starts[head] = place + pieces.size[pieces.edge_id[new]]
        walked, walk_steps = pieces.walk(starts, unit_key(which_unit, rank))
        tail = np.add.reduceat(walk_steps, head) if len(jobs) else np.zeros(0, np.int64)
        size = np.zeros(n, np.int64)
        size[jobs] = step + 1 + tail
        bound = np.concatenate([[0], np.cumsum(size)])
        path, path_unit = np.empty(int(bound[-1]), np.int64), np.empty(int(bound[-1]), np.int64)
        for q, p in enumerate(paths):
            mine = np.flatnonzero(parent == q)
            to, of = spread(bound[jobs[mine]], step[mine]), spread(p.bound[jobs[mine]], step[mine])
            path[to], path_unit[to] = p.edges[of], p.unit[of]
        path[bound[jobs] + step], path_unit[bound[jobs] + step] = new, where
        to = spread(bound[jobs] + step + 1, tail)
        path[to], path_unit[to] = walked, np.repeat(which_unit, walk_steps)
        now = _Paths(pieces, path, path_unit, bound)
        branch = np.zeros(n, np.int64)
        branch[jobs] = step
        now.open = np.full(len(path), -np.inf)
        later = np.flatnonzero(now.step > branch[now.row])
        owner = now.row[later]
        now.open[later] = _truncated(_leftover(now.before[later], now.used[later]), score[owner], noise(owner, 4 * rank + 2, now.step[later]))
        paths.append(now)
        for p in paths:
            p.rank()
        for list_, value in ((from_, parent), (at_, at), (new_, new)):
            whole = np.full(n, -1)
            whole[jobs] = value
            list_.append(whole)
    limit = np.stack([p.best for p in paths]).max(0)
    results = []
    bounds = [p.bound.tolist() for p in paths]
    ids = [pieces.edge_id[p.edges] for p in paths]
    for i in range(n):
        for rank, p in enumerate(paths):
            if scores[rank][i] > -np.inf:
                lp = float(p.log_prob[i])
                inclusion = float(-np.expm1(-np.exp(min(lp - limit[i], 50.0)))) if limit[i] > -np.inf else 1.0
                results.append((i, rank, ids[rank][bounds[rank][i] : bounds[rank][i + 1]], lp, float(scores[rank][i]), inclusion))
    return results


_loaded: dict[tuple[str, float], Pieces] = {}


def _sample(path: str, alpha: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, alpha) not in _loaded:
            _loaded[path, alpha] = Pieces(path, alpha)
        pieces = _loaded[path, alpha]
        for whole in batches:
            for batch in slices(whole, "text", BYTES):
                texts = batch.column(1).to_pylist()
                docs = batch.column(0)
                keys = docs.fill_null(-1).to_numpy().view(np.uint64) + np.uint64(1)
                got = sample(pieces, texts, keys, k)
                sizes = np.array([len(x[2]) for x in got], np.int64)
                decoded = pieces.decode(np.concatenate([x[2] for x in got]) if got else np.zeros(0, np.int64), sizes)
                raw = [t.replace(BLANK, " ").encode() for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [docs.take(pa.array([x[0] for x in got])), pa.array([x[1] for x in got], pa.int32()), pa.array(sizes), pa.array([x[3] for x in got]), pa.array([x[4] for x in got]), pa.array([x[5] for x in got]), binary([x[2].astype("<u4").tobytes() for x in got]), pa.array([d == raw[x[0]] for x, d in zip(got, decoded)])],
                    names=["doc_id", "rank", "n_tokens", "log_prob", "perturbed", "inclusion", "ids", "round_trip"],
                )

    return run


def sample_segmentations(docs: DataFrame, model: str, k: int = SAMPLES, alpha: float = ALPHA) -> DataFrame:
    """k distinct sampled segmentations of each text, or all if it has fewer.

    docs has doc_id and text; other columns are not read. Returns doc_id, rank (0 is the highest perturbed score),
    n_tokens, log_prob, perturbed, inclusion (the chance to be among k, given the score of the next one), ids (32-bit
    little-endian) and round_trip (the ids decode to the text; U+2581 reads as a blank). The noise depends on doc_id
    alone, so repeated rows have equal samples and reruns agree. A null or empty text has one segmentation, of no ids; a
    null doc_id is a key of its own. Texts are done about BYTES at once, a longer one alone; units of any length are whole.
    An empty table gives no rows.
    """
    return id_and_text(docs).mapInArrow(_sample(model, alpha, k), "doc_id long, rank int, n_tokens long, log_prob double, perturbed double, inclusion double, ids binary, round_trip boolean")
