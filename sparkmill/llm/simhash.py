"""SimHash near-duplicates, linked by multi-index hashing with Hamming balls in each fingerprint segment."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmill.llm.graph import components, forest
from sparkmill.llm.shared import materialize, regrouped, small_batches

BITS = 64
#: A segment value that more fingerprints have than this is cut in blocks, which are joined pair by pair.
HOT = 20_000
#: Hot segment values up to this many are broadcast, beyond it they are joined by a shuffle.
BROADCAST_HOT = 100_000
#: From so many distinct fingerprints on, two segments of 32 bits keep groups small where three of 21 no longer do.
TWO_SEGMENTS_FROM = 1 << 24
#: Odd multipliers that make further fingerprint words of a shingle's hash.
MORE = np.random.default_rng(6).integers(0, 1 << 63, 32, dtype=np.uint64) | np.uint64(1)


def shingle_hashes(text: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of the word shingles in order, repeats included; of all words together if they are fewer, none without words. A-Z lower-cased."""
    ws = text.lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(ws), xxhash.xxh64_intdigest
    if len(ws) <= shingle:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(ws) - shingle + 1]
    return np.fromiter((digest(joined[x:y], seed) for x, y in zip(starts.tolist(), ends[shingle - 1 :].tolist())), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """64 bits, each 1 if over half of the hashes have it."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[k : k + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """64 bits, each 1 if over half of the shingles' XXH64 have it; 0 without words. A-Z lower-cased, words of non-space."""
    return majority(shingle_hashes(text, shingle, seed))


def wide_fingerprint(text: bytes, shingle: int, words: int) -> list[int]:
    """So many words of 64 bits, independent fingerprints of the set of shingles (repeats left out)."""
    h, out = np.unique(shingle_hashes(text, shingle)), []
    for k in range(words):
        g = h * MORE[k]
        g ^= g >> np.uint64(29)
        g *= np.uint64(0xBF58476D1CE4E5B9)
        out.append(majority(g ^ (g >> np.uint64(32))))
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp long) for every row; the 64 bits as a signed long. Null and blank texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_py() or b"", shingle) for x in b.column(1)], np.uint64)
            yield pa.record_batch([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, fp long")


def segments(m: int) -> list[tuple[int, int]]:
    """(shift, width) of m segments that make up the 64 bits."""
    cuts = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def probe_rows(fps: np.ndarray, m: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, side, index) of rows of fingerprint words: side 0 files a row under each segment of each word, side 1 looks up the segments' Hamming balls.

    Two words within a distance have a segment that differs in at most distance // m bits. Of two different segment
    values only the smaller one looks up the other: flips must set the highest bit that they change.
    """
    u, keys, sides, owners = fps.view(np.uint64), [], [], []
    every = np.arange(len(u))
    for k in range(u.shape[1]):
        for j, (shift, width) in enumerate(segments(m)):
            value = (u[:, k] >> np.uint64(shift)) & np.uint64((1 << width) - 1)
            top = np.uint64(k * m + j) << np.uint64(58)
            keys.append(value | top)
            sides.append(np.zeros(len(u), np.int8))
            owners.append(every)
            for r in range(1, radius + 1):
                for flips in combinations(range(width), r):
                    mask = np.uint64(sum(1 << b for b in flips))
                    up = (value >> np.uint64(flips[-1])) & np.uint64(1) == 0
                    keys.append((value[up] ^ mask) | top)
                    sides.append(np.ones(int(up.sum()), np.int8))
                    owners.append(every[up])
    return np.concatenate(keys).view(np.int64), np.concatenate(sides), np.concatenate(owners)


class Nodes:
    """Nodes with the words of their fingerprints, and how many bits those of linked ones may differ in."""

    def __init__(self, node: np.ndarray, fp: np.ndarray, distance: int, *more: np.ndarray) -> None:
        self.node, self.fps, self.distance = node, [x.view(np.uint64) for x in (fp, *more)], distance

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        differ = np.bitwise_count(self.fps[0][i] ^ self.fps[0][j])
        for fp in self.fps[1:]:
            differ = differ + np.bitwise_count(fp[i] ^ fp[j])
        return differ <= self.distance

    def forest(self, us: list[np.ndarray], vs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        u, v = np.concatenate([self.node[:0], *us]), np.concatenate([self.node[:0], *vs])
        return forest(u, v) if len(u) else (u, v)

    def close(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of the indices a and b that are near, as spanning stars."""
        us, vs = [], []
        for i in range(0, len(a), 1024):
            for j in range(0, len(b), 1024):
                x, y = a[i : i + 1024], b[j : j + 1024]
                p, q = np.nonzero(self.near(x[:, None], y[None, :]))
                u, v = self.forest([self.node[x[p]]], [self.node[y[q]]])
                us.append(u)
                vs.append(v)
        return self.forest(us, vs)

    def link_groups(self, starts: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges among the rows of a group (sorted by side) that are near; two lookups are no pair. starts: of the groups, and the end."""
        sizes = np.diff(starts)
        small, group, us, vs = np.repeat(sizes <= 64, sizes), np.repeat(np.arange(len(sizes)), sizes), [], []
        for t in range(1, int(min(64, sizes.max(initial=0)))):
            i = np.flatnonzero(small[:-t] & (group[:-t] == group[t:]) & (side[:-t] == 0))
            if not len(i):
                break
            i = i[self.near(i, i + t)]
            us.append(self.node[i])
            vs.append(self.node[i + t])
        for g in np.flatnonzero(sizes > 64):
            s, e = starts[g], starts[g + 1]
            filed = s + int((side[s:e] == 0).sum())
            if filed > s:
                u, v = self.close(np.arange(s, filed), np.arange(s, e))
                us.append(u)
                vs.append(v)
        return self.forest(us, vs)


def hot_keys(nodes: DataFrame, words: int, m: int, hot: int) -> DataFrame:
    """(hot_key, blocks): segment values under which more than `hot` nodes are filed, and in how many blocks they are cut."""
    keys = [
        F.shiftrightunsigned(F.get("fps", F.lit(k)), shift).bitwiseAND((1 << width) - 1).bitwiseOR((k * m + j) << 58) for k in range(words) for j, (shift, width) in enumerate(segments(m))
    ]
    return nodes.select(F.explode(F.array(*keys)).alias("hot_key")).groupBy("hot_key").count().where(F.col("count") > hot).select("hot_key", F.ceil(F.col("count") / hot).cast("int").alias("blocks"))


def near_links(nodes: DataFrame, distance: int, m: int, words: int = 1, radius: int | None = None, hot: int = HOT, judged: int = 1) -> DataFrame:
    """Edges (u, v) that connect nodes (node long, fps array<long>: words of 64 bits) whose first `judged` words differ in at most `distance` bits in all and that a segment brings together.

    With one word and the radius distance // m that is every such pair. More words and any radius bring nodes together as
    soon as one segment of any word differs in at most radius bits. No group emits all its pairs; a segment value that more
    than `hot` nodes have is cut in blocks by node, each pair of blocks a group, and lookups go to every block.
    """
    if words * m > 32:
        raise ValueError("more than 32 segments")
    if not 1 <= judged <= words:
        raise ValueError("as many words are judged as there are, one at least")
    radius = distance // m if radius is None else radius
    own_words = [f"fp{k}" for k in range(judged)]
    names = ["key", "side", "node", *own_words]

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, 4096 // words)
        for b in regrouped(batches, 4096):
            for k in range(0, b.num_rows, step):
                part = b.slice(k, step)
                node, fps = part.column(0).to_numpy(), part.column(1).flatten().to_numpy().reshape(-1, words)
                key, side, at = probe_rows(fps, m, radius)
                yield pa.record_batch([pa.array(x) for x in (key, side, node[at], *(fps[at, w] for w in range(judged)))], names=names)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def out(rows: list[np.ndarray]) -> pa.RecordBatch:
            groups, (side, node, fp, *more) = rows[: len(keys)], rows[len(keys) :]
            new = np.concatenate([[True], np.any([g[1:] != g[:-1] for g in groups], axis=0)])
            u, v = Nodes(node, fp, distance, *more).link_groups(np.append(np.flatnonzero(new), len(node)), side)
            return pa.record_batch({"u": u, "v": v})

        for b in regrouped(batches, 200_000):
            rows = [c.to_numpy() for c in b.columns]
            held = rows if held is None else [np.concatenate([h, r]) for h, r in zip(held, rows)]
            cut = int(np.flatnonzero(np.any([g != g[-1] for g in held[: len(keys)]], axis=0))[-1:].sum()) + 1  # the last group may go on
            if cut > 1:
                yield out([h[:cut] for h in held])
                held = [h[cut:] for h in held]
        if held is not None and len(held[0]):
            yield out(held)

    rows = nodes.select("node", "fps").mapInArrow(probes, "key long, side byte, node long, " + ", ".join(f"{w} long" for w in own_words))
    keys, found = ["key"], None
    if nodes.count() > hot:
        found = materialize(hot_keys(nodes, words, m, hot), "hot")
        n_hot = found.count()
        if n_hot:
            keys = ["key", "i", "j"]
            rows = rows.join(F.broadcast(found) if n_hot <= BROADCAST_HOT else found, F.col("key") == F.col("hot_key"), "left")
            blocks = F.coalesce("blocks", F.lit(1))
            own = F.pmod(F.xxhash64("node"), blocks).cast("int")
            pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: F.struct(F.when(F.col("side") == 0, F.least(own, b)).otherwise(b).alias("i"), F.when(F.col("side") == 0, F.greatest(own, b)).otherwise(b).alias("j")))
            rows = rows.select(*names, F.explode(pairs).alias("pair")).select("key", "pair.i", "pair.j", "side", "node", *own_words)
    return rows.repartition(*keys).sortWithinPartitions(*keys, "side", "node").mapInArrow(link, "u long, v long")


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4, m: int | None = None, hot: int = HOT) -> DataFrame:
    """id, fp (signed long) and component (smallest id reachable by links of at most `distance` differing bits), per row.

    Equal fingerprints are one node; copies are never paired. m: number of segments (by default from the number of nodes).
    Null ids are kept and never name a component unless it has no other; repeated rows stay.
    """
    own = materialize(fingerprints(docs, id_col, text_col, shingle), "fp")
    nodes = materialize(own.groupBy(F.col("fp").alias("node")).agg(F.min("id").alias("first")), "nodes")
    m = m or (max(3, distance // 2 + 1) if nodes.count() < TWO_SEGMENTS_FROM else 2)
    roots = components(near_links(nodes.select("node", F.array("node").alias("fps")), distance, m, hot=hot))
    named = component_names(nodes, roots)
    return own.join(named, F.col("fp") == F.col("node")).select(F.col("id").alias(id_col), "fp", "component")


def component_names(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, component): the smallest id of what roots (node, root) connects; nodes: (node, first). Stored tables, so that a large component's join can be split."""
    rooted = nodes.select("node", "first").join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    rooted = materialize(rooted, "rooted")
    names = materialize(rooted.groupBy("root").agg(F.min("first").alias("component")), "names")
    return materialize(rooted.join(names, "root").select("node", "component"), "classes")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """docs without near copies: of every component of simhash_classes the row with the smallest id stays, one row if that id is repeated.

    Rows whose component has no id but null stay.
    """
    return keep_first(docs, simhash_classes(docs, id_col, text_col, **options), id_col)


def keep_first(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that name the component that found (id, component) gives them, once each, and those whose component is null."""
    kept = materialize(found.where(F.col("component").isNull() | (F.col(id_col) == F.col("component"))).select(F.col(id_col).alias("kept_id")), "kept")
    ids = kept.where("kept_id is not null")
    once = ids.groupBy("kept_id").count().where("count > 1").limit(1).count() == 0
    named = docs.join(ids if once else ids.distinct(), F.col(id_col) == F.col("kept_id"), "left_semi")
    if not once:
        named = named.dropDuplicates([id_col])
    return named.unionByName(docs.where(F.col(id_col).isNull())) if kept.where("kept_id is null").limit(1).count() else named
