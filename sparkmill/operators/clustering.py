"""Medoid clustering of latent vectors: independent parts, and rounds over a part too large for one task.

Clusters are found one after the other: from a seed the medoid moves to neighbours while the weighted closeness around it rises,
and the valley of the distances around it bounds the cluster. An attempt is a generator that asks for what it needs, so that the
same code runs on arrays in one task and, many attempts at a time, on a distributed table. Distances and densities are whole
numbers: sums don't depend on how points are split.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Generator, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmill.operators.linkage import components_within, near_places
from sparkmill.operators.neighbours import DEFAULT_RADIUS, DELTA_X, HALF_WINDOW, MEDOID_RADIUS, N_BINS, SIGMA, X_MAX, normalised, seed_order
from sparkmill.sources.scratch import numbered, stored

#: Peak-valley ratio: first value, step, and from where on any cluster is accepted (fixed values).
FIRST_PVR, PVR_STEP, LAST_PVR = 0.1, 0.1, 0.55
#: Parts of the peak that end it, of the low that end the valley, and the last place of a peak (fixed values).
PEAK_END, VALLEY_END, LAST_PEAK, MOST_RADIUS = 0.6, 1.5, 0.1, 0.2
_STEPS = np.arange(-HALF_WINDOW, HALF_WINDOW + 1)
_WEIGHTS = np.exp(-((_STEPS * DELTA_X / SIGMA) ** 2) / 2) * DELTA_X / (SIGMA * np.sqrt(2 * np.pi))
#: Distances are counted in so small units.
UNIT = 1 << 30
NEAR = round(MEDOID_RADIUS * UNIT)
#: A part of at most so many points is clustered by one task; of a larger one so many seeds are tried at a time, whose walks go over all tasks.
PART_ROWS, SEEDS = 4_096, 32
#: The same for the walks of a group within a large part.
GROUP_ROWS = 32_768
#: Walks within a group that one task holds cost no pass: so many seeds are looked at in a round for each of SEEDS, and so many of a group are tried.
AHEAD, OF_GROUP = 128, 4


def valley(density: np.ndarray, ratio: float) -> tuple[float, float] | None:
    """(threshold, valley over peak) of a smoothed histogram, or None.

    The peak is the highest point before density first falls below PEAK_END of it; it must not lie behind LAST_PEAK. The
    valley goes from there to where density first exceeds VALLEY_END times the lowest point so far. Its lowest point is the
    threshold, if it lies behind the valley's start, below `ratio` of the peak and not beyond MOST_RADIUS + ratio.
    """
    highest = np.maximum.accumulate(density)
    over = density < PEAK_END * highest
    if not over.any():
        return None
    start = int(over.argmax())
    peak_at = int(density[:start].argmax())
    behind = density[start:]
    up = behind[1:] > VALLEY_END * np.minimum.accumulate(behind)[:-1]
    behind = behind[: int(up.argmax()) + 1] if up.any() else behind
    low = int(behind.argmin())
    threshold, seen = (start + low) * DELTA_X, behind[low] / density[peak_at]
    if peak_at * DELTA_X > LAST_PEAK + 1e-12 or not low or seen >= ratio or threshold > MOST_RADIUS + ratio:
        return None
    return threshold, float(seen)


def smooth(mass: np.ndarray) -> np.ndarray:
    """A histogram of lengths by distance, spread by normal weights."""
    return np.convolve(mass, _WEIGHTS)[HALF_WINDOW:-HALF_WINDOW]


def units(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of normalised rows, in whole units: a row for each of x, a column for each of y."""
    return np.maximum(np.rint((0.5 - x @ y.T) * UNIT), 0).astype(np.int64)


def closeness(d: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each column the sum of length * (NEAR - distance) over the points that are near."""
    return np.where(d <= NEAR, (NEAR - d) * length[:, None], 0).sum(axis=0)


def spread(d: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Lengths of the points by distance bin, up to X_MAX."""
    near = d <= X_MAX * UNIT
    place = np.minimum((d[near] / UNIT / DELTA_X).astype(np.int64), N_BINS - 1)
    out = np.zeros(N_BINS, np.int64)
    np.add.at(out, place, length[near])
    return out


def drawn(ids: np.ndarray, seed: int, start: int) -> np.ndarray:
    """A hash of each id that gives the order in which the attempt from `start` tries neighbours."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((start * 0xD1B54A32D192ED03 + seed * 0x8CB92BA72F3D8DD7 + 1) % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


@dataclass(frozen=True)
class Ask:
    """What an attempt wants to know: the closeness around each of some points, or with `look` all about one: its closeness, the near points not yet seen (the first by hash), how many are nearer than NEAR, and lengths by bin."""

    ids: tuple[int, ...]
    look: bool = False
    seen: frozenset = frozenset()


def attempt(start: int) -> Generator[Ask, Any, tuple[int, int, np.ndarray]]:
    """(medoid, points nearer than NEAR, lengths by distance bin) from a seed: the medoid moves to the first neighbour tried that is closer to its surroundings."""
    medoid, seen = start, {start}
    best, tried, close, mass = yield Ask((start,), True, frozenset(seen))
    while True:
        values = (yield Ask(tuple(tried))) if len(tried) else []
        for i, value in zip(tried, values):
            seen.add(i)
            if value > best:
                medoid, best = i, value
                _, tried, close, mass = yield Ask((medoid,), True, frozenset(seen))
                break
        else:
            return medoid, close, mass


@dataclass
class Found:
    """A cluster: its medoid and seed, members, kind (normal, loner or fallback), radius, and the observed and allowed ratio."""

    medoid: int
    seed: int
    members: np.ndarray
    kind: str
    radius: float | None
    observed_pvr: float | None
    allowed_pvr: float


@dataclass
class Judge:
    """Decides on attempts in their order, and allows a higher ratio once too few of the last `window` gave a cluster."""

    window: int
    min_successes: int
    ratio: float = field(default=FIRST_PVR, init=False)

    def __post_init__(self) -> None:
        if self.window < 1 or not 1 <= self.min_successes <= self.window:
            raise ValueError("window must be at least 1, min_successes between 1 and window")
        self.last: deque[bool] = deque(maxlen=self.window)

    def ball(self, close: int, mass: np.ndarray) -> tuple[str | None, float | None]:
        """(kind, radius) that would be decided on now; decides nothing."""
        if close == 1:
            return "loner", None
        cut = valley(smooth(mass), self.ratio)
        return ("normal", cut[0]) if cut else ("fallback", DEFAULT_RADIUS) if self.ratio > LAST_PVR else (None, None)

    def __call__(self, close: int, mass: np.ndarray) -> tuple[str | None, float | None, float | None, bool]:
        """(kind or None for no cluster, radius, observed ratio, whether seeds start anew with a higher ratio)."""
        if close == 1:
            return "loner", None, None, False
        cut, lenient = valley(smooth(mass), self.ratio), self.ratio > LAST_PVR
        if cut is None and lenient:
            return "fallback", DEFAULT_RADIUS, None, False
        anew = False
        if cut is None or self.ratio < LAST_PVR:
            self.last.append(cut is not None)
            anew = len(self.last) == self.window and sum(self.last) < self.min_successes
        if anew:
            self.last.clear()
            self.ratio += PVR_STEP
        return ("normal", *cut, anew) if cut else (None, None, None, anew)


@dataclass
class MedoidClusterer:
    """Emits disjoint clusters until every point is in one. vectors: any rows; lengths: positive whole weights; ids: names of the rows.

    Seeds go round from the longest contig to the shortest, of equal ones the higher id first.
    """

    vectors: np.ndarray
    lengths: np.ndarray
    max_steps: int = 25
    window: int = 300
    min_successes: int = 15
    seed: int = 0
    ids: np.ndarray | None = None
    normalised: bool = False

    def __post_init__(self) -> None:
        if self.max_steps < 1:
            raise ValueError("max_steps must be at least 1")
        self.judge = Judge(self.window, self.min_successes)
        if len(self.vectors) != len(self.lengths):
            raise ValueError("as many lengths as vectors are needed")
        x = np.array(self.vectors, np.float64)
        if not self.normalised and len(x):
            x[(x == 0).all(axis=1)] = 1 / max(1, x.shape[1] if x.ndim == 2 else 1)
            x = x / (np.sqrt((x * x).sum(axis=1, keepdims=True)) * np.sqrt(2))
        self.x, self.weight = x, np.asarray(self.lengths).astype(np.int64)
        self.names = np.arange(len(x)) if self.ids is None else np.asarray(self.ids)
        self.alive = np.ones(len(x), bool)

    def distances(self, k: int) -> np.ndarray:
        d = units(self.x, self.x[k : k + 1])[:, 0]
        d[k] = 0
        return d

    def answer(self, ask: Ask, start: int) -> Any:
        live = np.flatnonzero(self.alive)
        each = [self.distances(k)[live] for k in ask.ids]
        weights = [int(closeness(d[:, None], self.weight[live])[0]) for d in each]
        if not ask.look:
            return weights
        (d,) = each
        near = [i for i in live[d <= NEAR].tolist() if i not in ask.seen]
        order = np.argsort(drawn(self.names[near], self.seed, int(self.names[start])), kind="stable")
        return weights[0], [near[i] for i in order[: self.max_steps]], int((d < NEAR).sum()), spread(d, self.weight[live])

    def __iter__(self) -> Iterator[Found]:
        order, at = np.lexsort((self.names, self.weight))[::-1], 0
        while self.alive.any():
            while not self.alive[order[at % len(order)]]:
                at += 1
            start = int(order[at % len(order)])
            at += 1
            work, reply = attempt(start), None
            try:
                while True:
                    reply = self.answer(work.send(reply), start)
            except StopIteration as end:
                medoid, close, mass = end.value
            allowed = self.judge.ratio
            kind, radius, observed, anew = self.judge(close, mass)
            at = 0 if anew else at
            if kind is None:
                continue
            members = np.array([medoid]) if radius is None else np.flatnonzero(self.alive & (self.distances(medoid) <= round(radius * UNIT)))
            self.alive[members] = False
            yield Found(medoid, start, members, kind, radius, observed, allowed)


SCHEMA = "cluster long, contig_idx long, medoid long, kind string, radius double, observed_pvr double"


@dataclass
class _Point:
    """A seed or candidate on the driver."""

    id: int
    v: np.ndarray
    rank: int


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)


def _answers(alive: DataFrame, asks: list[tuple[_Point, Ask]], known: dict[int, np.ndarray], options: dict) -> list[Any]:
    """Replies to the asks of attempts (seed, ask): one pass over the points that are left.

    The points asked about are few and go to every task. A task replies with sums, and with the first neighbours by hash
    that it has; what comes back is bounded by the asks, not by the points.
    """
    most, seed = options["max_steps"], options["seed"]
    about = [(start.id, start.rank, i, ask.look, ask.seen) for start, ask in asks for i in ask.ids]
    y, own, ranks = np.array([known[x[2]] for x in about]), np.array([x[2] for x in about]), np.array([x[1] for x in about])
    neighbour = pa.struct([("h", pa.int64()), ("id", pa.int64()), ("v", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, counts, first = np.zeros(len(about), np.int64), np.zeros(len(about), np.int64), [[] for _ in about]
        mass = {k: np.zeros(N_BINS, np.int64) for k, x in enumerate(about) if x[3]}
        for b in batches:
            if not b.num_rows:
                continue
            x, ids, length, rank = _matrix(b["v"]), b["contig_idx"].to_numpy(), b["length"].to_numpy().astype(np.int64), b["rank"].to_numpy()
            lone = b["lone"].to_numpy(zero_copy_only=False)
            for s in range(0, len(about), 256):
                d = units(x, y[s : s + 256])
                d[ids[:, None] == own[s : s + 256]] = 0
                d[lone[:, None] & (rank[:, None] < ranks[s : s + 256])] = 4 * UNIT  # went before this seed's turn
                weights[s : s + 256] += closeness(d, length)
                for k in [k for k in mass if s <= k < s + 256]:
                    own_d = d[:, k - s]
                    counts[k] += int((own_d < NEAR).sum())
                    mass[k] += spread(own_d, length)
                    near = np.array([i for i in np.flatnonzero(own_d <= NEAR).tolist() if int(ids[i]) not in about[k][4]], np.int64)
                    order = drawn(ids[near], seed, about[k][0])
                    first[k] += [(int(order[i]) - (1 << 63), int(ids[near[i]]), x[near[i]].tolist()) for i in np.argsort(order, kind="stable")[:most]]
                    first[k] = sorted(first[k])[:most]
        sums = [[int(w), *(mass[k].tolist() if k in mass else ())] for k, w in enumerate(weights)]
        found = [[{"h": h, "id": i, "v": v} for h, i, v in f] for f in first]
        yield pa.record_batch([pa.array(np.arange(len(about), dtype=np.int32)), pa.array(counts), pa.array(sums, pa.list_(pa.int64())), pa.array(found, pa.list_(neighbour))], names=["k", "n", "sums", "first"])

    columns = alive.select("contig_idx", "v", "length", "rank", "lone")
    parts = columns.mapInArrow(run, "k int, n long, sums array<bigint>, first array<struct<h: bigint, id: bigint, v: array<double>>>")
    sums = F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(N_BINS + 1)])
    merged = parts.groupBy("k").agg(F.sum("n").alias("n"), sums.alias("sums"), F.slice(F.array_sort(F.flatten(F.collect_list("first"))), 1, most).alias("first"))
    rows = {r["k"]: r for r in merged.collect()}  # a row for each point asked about
    out, k = [], 0
    for _, ask in asks:
        mine = [rows[k + i] for i in range(len(ask.ids))]
        k += len(ask.ids)
        weights = [int(r["sums"][0]) for r in mine]
        if not ask.look:
            out.append(weights)
            continue
        (r,) = mine
        known.update({p["id"]: np.array(p["v"]) for p in r["first"]})
        out.append((weights[0], [p["id"] for p in r["first"]], int(r["n"]), np.array(r["sums"][1:], np.int64)))
    return out


@dataclass
class _Result:
    """What an attempt came to, and the points that it asked about."""

    medoid: int
    close: int
    mass: np.ndarray
    touched: dict[int, np.ndarray]


def _attempts(alive: DataFrame, seeds: list[_Point], options: dict) -> dict[int, _Result]:
    """By seed the results of attempts side by side; each sees the points as they are."""
    known, touched = {p.id: p.v for p in seeds}, {p.id: {} for p in seeds}
    works = {p.id: (p, attempt(p.id)) for p in seeds}
    asks, ended = {i: next(w) for i, (_, w) in works.items()}, {}
    while asks:
        replies = _answers(alive, [(works[i][0], ask) for i, ask in asks.items()], known, options)
        for (i, ask), reply in zip([*asks.items()], replies):
            touched[i].update({k: known[k] for k in ask.ids})
            try:
                asks[i] = works[i][1].send(reply)
            except StopIteration as end:
                ended[i] = _Result(*end.value, touched[i])
                del asks[i]
    return ended


def _walks(alive: DataFrame, seeds: list[_Point], options: dict) -> dict[int, _Result]:
    """The same for seeds of groups that a task holds: a walk never leaves its group, so each group's are gone in a task, and one pass over all points looks at the medoids."""
    names = alive.sparkSession.createDataFrame([(p.id,) for p in seeds], "start long")
    own = alive.where("not lone and not large").join(F.broadcast(names), F.col("contig_idx") == F.col("start"), "left")
    wanted = own.where("start is not null").select(F.col("near_group").alias("of")).distinct()
    own = own.join(wanted, F.col("near_group") == F.col("of"), "left_semi").select("near_group", "contig_idx", "v", "length", "start")
    steps, seed = options["max_steps"], options["seed"]

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("contig_idx").combine_chunks()
        ids = group["contig_idx"].to_numpy()
        x = _matrix(group["v"].chunk(0))
        held, rows = MedoidClusterer(x, group["length"].to_numpy(), max_steps=steps, seed=seed, ids=ids, normalised=True), []
        for start in np.flatnonzero(group["start"].is_valid().to_numpy()).tolist():
            work, reply, touched = attempt(start), None, {}
            try:
                while True:
                    ask = work.send(reply)
                    touched |= dict.fromkeys(ask.ids)
                    reply = held.answer(ask, start)
            except StopIteration as end:
                rows.append((int(ids[start]), int(ids[end.value[0]]), ids[[*touched]].tobytes(), x[[*touched]].tobytes()))
        columns = zip(*rows) if rows else ((), (), (), ())
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["start", "medoid", "ids", "vs"])

    found = own.groupBy("near_group").applyInArrow(run, "start long, medoid long, ids binary, vs binary").toArrow()  # at most OF_GROUP seeds of each group
    medoids, ranks, touched = {}, {p.id: p.rank for p in seeds}, {}
    for start, medoid, names_of, vs in zip(*(found[c].to_pylist() for c in ("start", "medoid", "ids", "vs"))):
        ids = np.frombuffer(names_of, np.int64)
        touched[start], medoids[start] = dict(zip(ids.tolist(), np.frombuffer(vs).reshape(len(ids), -1))), medoid
    looks = _histograms(alive, [(ranks[i], m, touched[i][m]) for i, m in medoids.items()])
    return {i: _Result(m, close, mass, touched[i]) for (i, m), (close, mass) in zip(medoids.items(), looks)}


def _near(x: np.ndarray, y: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of x, rows of y, distances in whole units) of the pairs at most `most` units apart."""
    for i, j, d in near_places(x, y, (most + 1) / UNIT):
        u = np.maximum(np.rint(d * UNIT), 0).astype(np.int64)
        yield i[u <= most], j[u <= most], u[u <= most]


def _bins(u: np.ndarray) -> np.ndarray:
    return np.minimum((u / UNIT / DELTA_X).astype(np.int64), N_BINS - 1)


def _histograms(alive: DataFrame, about: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, np.ndarray]]:
    """(points nearer than NEAR, lengths by bin) around medoids (rank of the seed, id, vector): one pass over the points that are left."""
    ranks, own, y = (np.array(c) for c in zip(*about))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(own), N_BINS + 1), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            ids, length, rank, lone = _columns(b)
            for i, k, u in _near(_matrix(b["v"]), y, int(X_MAX * UNIT)):
                stays = ~(lone[i] & (rank[i] < ranks[k]))  # the others went before this seed's turn
                i, k, u = i[stays], k[stays], np.where(ids[i] == own[k], 0, u)[stays]
                np.add.at(sums, (k, _bins(u)), length[i])
                np.add.at(sums, (k, N_BINS), u < NEAR)
        some = np.flatnonzero(sums.any(axis=1))
        yield pa.record_batch([pa.array(some), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], names=["k", "sums"])

    parts = alive.select("contig_idx", "v", "length", "rank", "lone").mapInArrow(run, "k long, sums array<bigint>")
    found = parts.groupBy("k").agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(N_BINS + 1)]).toArrow().sort_by("k")  # a row for each medoid
    sums = np.stack([found[f"s{i}"].to_numpy() for i in range(N_BINS + 1)], axis=1)
    return [(int(r[-1]), r[:-1]) for r in sums]


def _columns(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return b["contig_idx"].to_numpy(), b["length"].to_numpy().astype(np.int64), b["rank"].to_numpy(), b["lone"].to_numpy(zero_copy_only=False).astype(bool)


def _disturbed(points: dict[int, np.ndarray], done: list[tuple[np.ndarray, float]]) -> bool:
    """Whether clusters (medoid, radius) may have taken points near the given ones, which a walk went by."""
    if not done:
        return False
    y, medoids, reach = np.array([*points.values()]), np.array([m for m, _ in done]), np.sqrt(2 * np.array([r for _, r in done]))
    apart = np.sqrt(np.maximum((y * y).sum(axis=1)[:, None] - 2 * y @ medoids.T + (medoids * medoids).sum(axis=1), 0))
    return bool((apart <= reach + np.sqrt(2 * MEDOID_RADIUS) + 1e-6).any())


@dataclass
class _Taken:
    """What the clusters of tries would take: points are known by the tries (places) whose clusters have them. by_place: for a try the lengths by bin of such points around its medoid; by_group: of which sets a group has points."""

    by_place: dict[int, dict[tuple[int, ...], np.ndarray]]
    by_group: dict[int, list[tuple[int, ...]]]


def _taken(alive: DataFrame, tries: list[tuple[_Point, _Result, tuple[str | None, float | None]]]) -> _Taken:
    """One pass over the points; what comes back are sums for the tries that have points in common."""
    places = np.array([k for k, (_, _, (kind, _)) in enumerate(tries) if kind is not None], np.int64)
    if not len(places):
        return _Taken({}, {})
    medoids, ids, ranks = np.array([r.touched[r.medoid] for _, r, _ in tries]), np.array([r.medoid for _, r, _ in tries]), np.array([p.rank for p, _, _ in tries])
    reach = np.array([-1 if tries[k][2][1] is None else round(tries[k][2][1] * UNIT) for k in places])
    balls, names, turns = medoids[places], ids[places], ranks[places]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, (own, length, rank, lone) = _matrix(b["v"]), _columns(b)
            hits = [(i[on], k[on]) for i, k, u in _near(x, balls, max(0, int(reach.max()))) if (on := ((u <= reach[k]) | (own[i] == names[k])) & ~(lone[i] & (rank[i] < turns[k]))).any()]
            if not hits:
                continue
            i, k = (np.concatenate(c) for c in zip(*hits))
            order = np.lexsort((k, i))
            rows, begin = np.unique(i[order], return_index=True)
            sets = np.split(places[k[order]], begin[1:])
            known: dict[bytes, int] = {}
            of = np.array([known.setdefault(h.tobytes(), len(known)) for h in sets])  # equal sets have one number
            first = np.array([h[0] for h in sets])
            keys, sums = [], []
            for at, later, u in _near(x[rows], medoids, int(X_MAX * UNIT)):
                on = (later > first[at]) & ~(lone[rows[at]] & (rank[rows[at]] < ranks[later]))
                at, later, u = at[on], later[on], np.where(own[rows[at]] == ids[later], 0, u)[on]
                keys.append((of[at] * len(tries) + later) * N_BINS + _bins(u))
                sums.append(length[rows[at]])
            key, back = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_inverse=True)
            mass = np.zeros(len(key), np.int64)
            np.add.at(mass, back, np.concatenate([np.zeros(0, np.int64), *sums]))
            group = np.where(lone[rows], -1, b["near_group"].fill_null(-1).to_numpy()[rows])
            met = np.unique(np.stack([of, group])[:, ~lone[rows]], axis=1)
            every = [np.frombuffer(h, np.int64).tolist() for h in known]
            of, later, place = np.concatenate([key // N_BINS // len(tries), met[0]]), np.concatenate([key // N_BINS % len(tries), np.full(met.shape[1], -1)]), np.concatenate([key % N_BINS, met[1]])
            yield pa.record_batch([pa.array(every, pa.list_(pa.int64())).take(pa.array(of)), pa.array(later), pa.array(place), pa.array(np.concatenate([mass, np.zeros(met.shape[1], np.int64)]))], names=["earlier", "later", "bin", "mass"])

    sums = alive.select("contig_idx", "v", "length", "rank", "lone", "near_group").mapInArrow(run, "earlier array<bigint>, later long, bin long, mass long")
    found = sums.groupBy("earlier", "later", "bin").agg(F.sum("mass").alias("mass")).toArrow()
    out = _Taken({}, {})
    for earlier, later, place, mass in zip(*(found[c].to_pylist() for c in ("earlier", "later", "bin", "mass"))):
        if later < 0:
            out.by_group.setdefault(place, []).append(tuple(earlier))
        else:
            out.by_place.setdefault(later, {}).setdefault(tuple(earlier), np.zeros(N_BINS, np.int64))[place] += mass
    return out


def clusters_in_rounds(points: DataFrame, max_steps: int = 25, window: int = 300, min_successes: int = 15, seed: int = 0, seeds: int = SEEDS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(contig_idx, medoid, kind, radius, observed_pvr, batch, turn) of normalised points (contig_idx, v, length): the clusters of MedoidClusterer, found over a distributed table.

    Walks never leave a group of points that steps of MEDOID_RADIUS connect. The next seeds are tried at once: those of a group of at
    most group_rows points in a task each, `seeds` of larger groups by passes over all points. Their attempts are taken in order; what
    the clusters of earlier ones take out of an attempt's histogram is subtracted from it. The next round starts at the first
    whose walk one may have disturbed: one that took points of its group, near points that the walk asked about. A point without neighbours is a loner whenever its turn comes, so these
    aren't tried; they count for others as long as their turn isn't over. (batch, turn) orders the clusters.
    """
    options, judge = {"max_steps": max_steps, "seed": seed}, Judge(window, min_successes)
    groups = stored(components_within(points, MEDOID_RADIUS * (1 + 1e-6)).select(F.col("node").alias("contig_idx"), F.col("component").alias("near_group")))
    sizes = groups.groupBy("near_group").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("near_group", (F.col("n") > group_rows).alias("large"))
    groups = groups.join(sizes, "near_group")
    ranks = seed_order(points).select("contig_idx", F.col("seed_rank").alias("rank"))
    alive = points.select("contig_idx", "v", "length").join(ranks, "contig_idx").join(groups, "contig_idx", "left")
    alive = stored(alive.select("contig_idx", "v", "length", "rank", F.col("near_group").isNull().alias("lone"), "near_group", F.coalesce("large", F.lit(False)).alias("large")))
    done, batch, at, results = [], 0, 0, {}
    while True:
        rows = alive.where(~F.col("lone") & (F.col("rank") >= at)).orderBy("rank").limit(seeds * AHEAD).collect()
        if not rows and not at:
            break
        commits, until = [], None
        if not rows:  # round again: every loner has had its turn
            at, until, results = 0, 1 << 62, {}
        else:
            ahead = [_Point(r["contig_idx"], np.array(r["v"]), r["rank"]) for r in rows]
            of_group, new = Counter(), ([], [])
            for p, r in zip(ahead, rows):
                of_group[key := None if r["large"] else r["near_group"]] += 1
                if p.id not in results and of_group[key] <= (seeds if r["large"] else OF_GROUP):
                    new[r["large"]].append(p)
            results |= _walks(alive, new[0], options) if new[0] else {}
            results |= _attempts(alive, new[1], options) if new[1] else {}
            tries = [(p, results[p.id], judge.ball(results[p.id].close, results[p.id].mass)) for p in ahead if p.id in results]
            taken = _taken(alive, tries)
            places, gone, before, as_thought = {p.id: k for k, (p, _, _) in enumerate(tries)}, np.zeros(len(ahead), bool), {}, True
            every, near_groups = np.array([p.v for p in ahead]), {p.id: r["near_group"] for p, r in zip(ahead, rows)}

            def less(k: int) -> np.ndarray:
                return tries[k][1].mass - sum((m for h, m in taken.by_place.get(k, {}).items() if any(j in before for j in h)), np.zeros(N_BINS, np.int64))

            def hidden(k: int) -> bool:
                met = {j for h in taken.by_group.get(near_groups[tries[k][0].id], ()) for j in h if j in before}
                return _disturbed(tries[k][1].touched, [before[j] for j in sorted(met)])

            for n, start in enumerate(ahead):
                at = start.rank + 1
                if gone[n]:
                    continue
                k = places.get(start.id)
                if k is None or hidden(k):
                    at = start.rank
                    break
                found = results.pop(start.id)
                kind, radius, observed, anew = judge(found.close, less(k))
                if kind is not None:
                    medoid = found.touched[found.medoid]
                    commits.append((start.rank, found.medoid, medoid, kind, radius, observed))
                    before[k] = (medoid, radius or 0.0)
                    gone |= units(every, medoid[None])[:, 0] <= round((radius or 0.0) * UNIT)
                    as_thought = tries[k][2] == (kind, radius)
                if anew:
                    at, until = 0, at
                    break
                if not as_thought:
                    break
            # what no cluster disturbed holds in the next round too, less what clusters took
            left = {p.id: k for p, g in zip(ahead, gone) if not g and p.id in results for k in [places[p.id]]} if until is None and as_thought else {}
            results = {i: replace(results[i], mass=less(k)) for i, k in left.items() if not hidden(k)}
            if not commits and until is None:
                continue
        alive = _commit(alive, commits, at if until is None else until, batch)
        done.append(alive)
        alive = alive.where("kind is null").select(*OWN)
        batch += 1
    columns = ["contig_idx", "medoid", "kind", "radius", "observed_pvr", "batch", "turn"]
    last = alive.select("contig_idx", F.col("contig_idx").alias("medoid"), F.lit("loner").alias("kind"), F.lit(None).cast("double").alias("radius"), F.lit(None).cast("double").alias("observed_pvr"), F.lit(batch).alias("batch"), F.col("rank").alias("turn"))
    for table in done:
        last = last.unionByName(table.where("kind is not null").select(columns))
    return last


#: Columns of the points that are left.
OWN = ("contig_idx", "v", "length", "rank", "lone", "near_group", "large")


def _commit(alive: DataFrame, commits: list[tuple], until: int, batch: int) -> DataFrame:
    """alive with what becomes of each point: the first cluster that takes it, a loner if its turn was before `until`, or null."""

    names, turns, reach = np.array([c[1] for c in commits], np.int64), np.array([c[0] for c in commits], np.int64), np.array([-1 if c[4] is None else round(c[4] * UNIT) for c in commits], np.int64)
    balls = np.array([c[2] for c in commits])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, _, rank, lone = _columns(b)
            medoid, kind, radius, observed, turn = [None] * len(ids), [None] * len(ids), [None] * len(ids), [None] * len(ids), [None] * len(ids)
            first = np.full(len(ids), len(commits))
            for i, k, u in _near(_matrix(b["v"]), balls, max(0, int(reach.max()))) if len(ids) and commits else ():
                hit = ((u <= reach[k]) | (ids[i] == names[k])) & ~(lone[i] & (rank[i] < turns[k]))
                np.minimum.at(first, i[hit], k[hit])
            for i in np.flatnonzero(first < len(commits)).tolist():
                turn[i], medoid[i], _, kind[i], radius[i], observed[i] = commits[first[i]]
            for i in np.flatnonzero((first == len(commits)) & lone & (rank < until)).tolist():
                medoid[i], kind[i], turn[i] = int(ids[i]), "loner", int(rank[i])
            columns = [pa.array(medoid, pa.int64()), pa.array(kind, pa.string()), pa.array(radius, pa.float64()), pa.array(observed, pa.float64()), pa.array(turn, pa.int64())]
            yield pa.record_batch([*[b[c] for c in OWN], *columns], names=[*OWN, "medoid", "kind", "radius", "observed_pvr", "turn"])

    kinds = dict(alive.dtypes)
    own = ", ".join(f"{c} {kinds[c]}" for c in OWN)
    out = alive.select(*OWN).mapInArrow(run, own + ", medoid long, kind string, radius double, observed_pvr double, turn long")
    return stored(out.withColumn("batch", F.lit(batch)))


def medoid_clusters(latent: DataFrame, by: str | None = None, part_rows: int = PART_ROWS, **options: int) -> DataFrame:
    """(cluster, contig_idx, medoid, kind, radius, observed_pvr): clusters of latent (contig_idx, v, length), numbered from 1; with `by` within each of its values, and with that column.

    Points further apart than X_MAX never meet in a histogram or a cluster, so what pairs within X_MAX connect are parts
    that are clustered by themselves, each with its own ratio; with `by` its values are the parts. A part of at most part_rows
    points is a task; a larger one is clustered in rounds over all tasks, see clusters_in_rounds, with the same result.
    """
    points = stored(normalised(latent.select(F.col("contig_idx").cast("long"), "v", "length", *[by] * bool(by))))
    if by:
        points = points.withColumnRenamed(by, "part")
    else:
        parts = components_within(points, X_MAX * (1 + 1e-6))
        points = stored(points.join(parts.select(F.col("node").alias("contig_idx"), F.col("component").alias("part")), "contig_idx"))
    sizes = stored(points.groupBy("part").agg(F.count(F.lit(1)).alias("n")))
    kind = dict(points.dtypes)["part"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("contig_idx")
        ids = rows["contig_idx"].to_numpy()
        found = MedoidClusterer(np.stack(rows["v"].to_list()), rows["length"].to_numpy(), ids=ids, normalised=True, **options)
        out = [pd.DataFrame({"cluster": n, "contig_idx": ids[c.members], "medoid": ids[c.medoid], "kind": c.kind, "radius": np.nan if c.radius is None else c.radius, "observed_pvr": np.nan if c.observed_pvr is None else c.observed_pvr}) for n, c in enumerate(found, 1)]
        return pd.concat(out).assign(part=rows["part"].iloc[0])

    same = F.col("part").eqNullSafe(F.col("of"))
    alone = points.join(sizes.where("n = 1").select(F.col("part").alias("of")), same, "left_semi")
    none = F.lit(None).cast("double")
    out = alone.select(F.lit(1).cast("long").alias("cluster"), F.col("contig_idx").cast("long"), F.col("contig_idx").cast("long").alias("medoid"), F.lit("loner").alias("kind"), none.alias("radius"), none.alias("observed_pvr"), "part")
    small = points.join(sizes.where((F.col("n") > 1) & (F.col("n") <= part_rows)).select(F.col("part").alias("of")), same, "left_semi")
    out = out.unionByName(small.groupBy("part").applyInPandas(run, SCHEMA + f", part {kind}"))
    for r in sizes.where(F.col("n") > part_rows).select("part").toLocalIterator():  # each fills all tasks
        own = points.where(F.col("part").eqNullSafe(F.lit(r["part"]).cast(kind))).drop("part")
        found = stored(clusters_in_rounds(own, **options))
        numbers = numbered(found.select("batch", "turn").distinct(), [F.col("batch"), F.col("turn")]).select("batch", "turn", (F.col("i") + 1).alias("cluster"))
        found = found.join(numbers, ["batch", "turn"])
        out = out.unionByName(found.select("cluster", F.col("contig_idx").cast("long"), F.col("medoid").cast("long"), "kind", "radius", "observed_pvr", F.lit(r["part"]).cast(kind).alias("part")))
    if by:
        return out.withColumnRenamed("part", by)
    out = stored(out.withColumnRenamed("cluster", "within"))
    numbers = numbered(out.select("part", "within").distinct(), [F.col("part"), F.col("within")]).select("part", "within", (F.col("i") + 1).alias("cluster"))
    return out.join(numbers, ["part", "within"]).select("cluster", "contig_idx", "medoid", "kind", "radius", "observed_pvr")


def metadata(members: DataFrame, contigs: DataFrame) -> DataFrame:
    """(name, radius, peak valley ratio, kind, bp, ncontigs, medoid) of every cluster; missing numbers are null."""
    named = members.join(contigs.select("contig_idx", "name", "length"), "contig_idx")
    stats = named.groupBy("cluster").agg(F.first("medoid").alias("m"), F.first("kind").alias("kind"), F.first("radius").alias("radius"), F.first("observed_pvr").alias("pvr"), F.sum(F.col("length").cast("long")).alias("bp"), F.count(F.lit(1)).alias("ncontigs"))
    medoids = contigs.select(F.col("contig_idx").alias("m"), F.col("name").alias("medoid"))
    return stats.join(medoids, "m").select(F.col("cluster").cast("string").alias("name"), F.round("radius", 3).alias("radius"), F.round("pvr", 2).alias("peak valley ratio"), "kind", "bp", "ncontigs", "medoid")
