"""Near copies: SimHash multi-index hashing brings candidates together, the exact similarity of word-shingle sets decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmill.llm.graph import components
from sparkmill.llm.shared import materialize, small_batches
from sparkmill.llm.simhash import component_names, keep_first, near_links, shingle_hashes, wide_fingerprint

#: Candidates' fingerprints are made of pairs of words, which a changed word upsets less than longer shingles.
CANDIDATE_SHINGLE = 2
#: Words of 64 bits and segments of each; a segment's ball has radius 1. The same at every size, so that what is found doesn't
#: depend on how many rows there are: unlike texts that share a segment value are told apart by the first words.
WORDS, SEGMENTS, RADIUS = 4, 3, 1
#: Bits of the first JUDGED words that candidates may differ in: a quarter. Pairs of similarity 0.8 differ in 6 to 10 of a word on
#: average, unlike texts in 32. One word isn't enough: of unlike texts that share one of its segments one in 16 pairs passes, and from
#: half a million texts on these connect nearly all of them. Of two words one in 40,000 does.
JUDGED, CANDIDATE_DISTANCE = 2, 32
#: Sets that one task compares; what candidates connect beyond that is compared with its middle first, then in blocks.
TOGETHER = 1_000
#: Up to so many larger groups, their names and sizes are broadcast, beyond it they are joined by a shuffle.
FEW = 10_000
#: Middles of so many bytes are broadcast, more are joined by a shuffle.
BROADCAST_BYTES = 8 << 20


def shingle_set(text: bytes, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """Ascending XXH64 of the different shingles; of all words together if they are fewer, none without words. A-Z lower-cased."""
    return np.unique(shingle_hashes(text, shingle, seed))


def node_of(shingles: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int.from_bytes(xxhash.xxh3_64_digest(shingles.tobytes()), "big", signed=True)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets; two empty ones are alike."""
    n = len(np.intersect1d(a, b, assume_unique=True))
    return n / (len(a) + len(b) - n) if len(a) or len(b) else 1.0


def similar_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs of at least that similarity which connect all such pairs: a search from every set among those not yet reached.

    Sets count what they share by postings; these are made anew whenever half of the sets have been reached.
    """
    sizes, links = np.array([len(s) for s in sets]), []
    left = np.ones(len(sets), bool)

    def postings() -> tuple[np.ndarray, np.ndarray]:
        own = np.flatnonzero(left)
        values, owners = np.concatenate([sets[i] for i in own]), np.repeat(own, sizes[own])
        order = np.argsort(values, kind="stable")
        return values[order], owners[order]

    values, owners = postings()
    n, indexed = len(sets), len(sets)
    for first in range(len(sets)):
        if not left[first]:
            continue
        left[first], n, queue = False, n - 1, [first]
        while queue and n:
            i = queue.pop()
            if 2 * n <= indexed:
                (values, owners), indexed = postings(), n
            s, e = np.searchsorted(values, sets[i]), np.searchsorted(values, sets[i], "right")
            lens = e - s
            at = np.repeat(s - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
            found, shared = np.unique(owners[at], return_counts=True)
            ok = left[found] & (shared >= similarity * (sizes[i] + sizes[found] - shared) - 1e-9)
            for j in found[ok].tolist():
                links.append((i, j))
                queue.append(j)
            left[found[ok]] = False
            n -= int(ok.sum())
    return links


def verified(held: DataFrame, keys: list[str], shingle: int, similarity: float) -> DataFrame:
    """Links (u, v) of at least the similarity that connect all such links among the rows (node, t) of each group."""
    k = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, nodes, sets = None, [], []

        def out() -> pa.RecordBatch:
            links = similar_links(sets, similarity)
            u, v = (pa.array([nodes[x[i]] for x in links], pa.int64()) for i in (0, 1))
            return pa.record_batch([u, v], names=["u", "v"])

        for b in batches:
            for *own, node, t in zip(*[c.to_pylist() for c in b.columns[:-1]], b.column(k + 1)):
                if own != group:
                    if len(nodes) > 1:
                        yield out()
                    group, nodes, sets = own, [], []
                if not nodes or nodes[-1] != node:  # rows repeated as a whole bring a node again
                    nodes.append(node)
                    sets.append(shingle_set(t.as_py(), shingle))
        if len(nodes) > 1:
            yield out()

    return held.select(*keys, "node", "t").repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(run, "u long, v long")


def middle_links(held: DataFrame, n_large: int, shingle: int, similarity: float, together: int) -> DataFrame:
    """The links of n_large components (root, node, fp, t) of more than `together` nodes.

    Every set is compared with the component's middle, the set whose fingerprint is nearest to the majority of bits. What is
    not similar to the middle, as a rule a small rest, is cut in blocks, and each is compared with every block of the
    component, so no link of the rest is lost; all others are connected by the middle. No task holds more than two blocks.
    """
    bits = [F.sum(F.call_function("getbit", F.col("fp"), F.lit(i)).cast("long")) * 2 > F.count(F.lit(1)) for i in range(64)]
    top = held.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.array(*[b.cast("long") for b in bits]).alias("bits"))
    top = top.select("root", "n", F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda x, i: x.bitwiseOR(F.call_function("shiftleft", F.get("bits", i), i))).alias("top"))
    few = n_large <= FEW
    side = lambda df: F.broadcast(df) if few else df
    sizes = materialize(top, "majorities", few)
    far = F.bit_count(F.col("fp").bitwiseXOR(F.col("top")))
    middles = held.join(side(sizes), "root").groupBy("root").agg(F.min(F.struct(far.alias("far"), "node", "t")).alias("one"))
    middles = materialize(middles.select("root", F.col("one.node").alias("middle"), F.col("one.t").alias("middle_t")), "middles", few)
    small = middles.agg(F.coalesce(F.sum(F.octet_length("middle_t")), F.lit(0))).first()[0] <= BROADCAST_BYTES

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, middle_set = None, np.zeros(0, np.uint64)
        for b in batches:
            ok = []
            for t, middle, middle_t in zip(b["t"], b["middle"].to_pylist(), b["middle_t"]):
                if middle != last:
                    last, middle_set = middle, shingle_set(middle_t.as_py(), shingle)
                ok.append(jaccard(shingle_set(t.as_py(), shingle), middle_set) >= similarity - 1e-9)
            yield pa.record_batch([b["root"], b["node"], b["middle"], pa.array(ok, pa.bool_())], names=["root", "node", "middle", "ok"])

    judged = held.join(F.broadcast(middles) if small else middles, "root").select("root", "node", "t", "middle", "middle_t")
    judged = materialize(judged.mapInArrow(compare, "root long, node long, middle long, ok boolean"), "judged")
    rest = judged.where(~F.col("ok")).select("root", "node")
    counts = side(materialize(rest.groupBy("root").agg(F.count(F.lit(1)).alias("left")).join(side(sizes.select("root", "n")), "root"), "rest", few))
    here, there = F.ceil(F.col("left") / together).cast("int"), F.ceil(F.col("n") / together).cast("int")
    left_block, own_block = F.pmod(F.xxhash64("node"), here).cast("int"), F.pmod(F.xxhash64(F.lit(1), "node"), there).cast("int")
    rows = held.select("root", "node", "t").join(counts, "root")
    every = rows.select("root", F.explode(F.sequence(F.lit(0), here - 1)).alias("i"), own_block.alias("j"), "node", "t")
    rest = rows.join(rest.select(F.col("root").alias("of"), F.col("node").alias("one")), (F.col("root") == F.col("of")) & (F.col("node") == F.col("one")), "left_semi")
    rest = rest.select("root", left_block.alias("i"), F.explode(F.sequence(F.lit(0), there - 1)).alias("j"), "node", "t")
    stars = judged.where(F.col("ok") & (F.col("node") != F.col("middle"))).select(F.col("node").alias("u"), F.col("middle").alias("v"))
    return stars.unionByName(verified(every.unionByName(rest), ["root", "i", "j"], shingle, similarity))


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, together: int = TOGETHER) -> DataFrame:
    """id and component (smallest id reachable by links of at least the similarity of shingle sets), per row.

    Equal sets are one node. SimHash words of the nodes' pairs of words go through multi-index hashing; nodes that it
    connects are candidates only, and links among them are verified on whole sets. Blank and null texts are one node. Null
    ids are kept and never name a component unless it has no other; repeated rows stay.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).select("id", F.xxhash64("t").alias("x"), "t")
    kind = dict(rows.dtypes)["id"]

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, fps = [], []
            for t in b.column(2):
                t = t.as_py() or b""
                nodes.append(node_of(shingle_set(t, shingle)))
                own = np.array(wide_fingerprint(t, CANDIDATE_SHINGLE, WORDS), np.uint64).view(np.int64)
                fps.append(own.tolist() if t.strip() else None)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(nodes, pa.int64()), pa.array(fps, pa.list_(pa.int64()))], names=["id", "x", "node", "fps"])

    every = materialize(rows.mapInArrow(name, f"id {kind}, x long, node long, fps array<long>"), "sets")
    one = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "x", "fps")).alias("one")
    nodes = materialize(every.groupBy("node").agg(one).select("node", F.col("one.id").alias("first"), F.col("one.x").alias("first_x"), F.col("one.fps").alias("fps")), "nodes")
    near = components(near_links(nodes.where("fps is not null"), CANDIDATE_DISTANCE, SEGMENTS, WORDS, RADIUS, judged=JUDGED))
    wanted = materialize(nodes.join(near, "node").select("root", "node", F.get("fps", F.lit(0)).alias("fp"), "first", "first_x"), "wanted")
    large = wanted.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > together).select("root")
    n_large = large.count()
    # texts are shuffled at every size: whether the other side may be broadcast depends on the input
    held = rows.join(wanted.hint("merge"), rows["id"].eqNullSafe(wanted["first"]) & (rows["x"] == wanted["first_x"])).select("root", "node", "fp", "t")
    if n_large:
        held = materialize(held, "held")
        side = F.broadcast(large) if n_large <= FEW else large
        links = verified(held.join(side, "root", "left_anti"), ["root"], shingle, similarity)
        links = links.unionByName(middle_links(held.join(side, "root", "left_semi"), n_large, shingle, similarity, together))
    else:
        links = verified(held, ["root"], shingle, similarity)
    named = component_names(nodes, components(links))
    return every.select("id", "node").join(named, "node").select(F.col("id").alias(id_col), "component")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """docs without near copies: of every component of similar_classes the row with the smallest id stays."""
    return keep_first(docs, similar_classes(docs, id_col, text_col, **options), id_col)
