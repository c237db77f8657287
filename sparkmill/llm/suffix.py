"""Removal of repeated byte strings by a sparse enhanced suffix array and its common-prefix interval tree."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmill.llm.shared import delete_table, materialize, small_batches, write_table

#: Bytes of the gram that anchors are chosen by.
GRAM = 50
#: Bytes that a worker hashes at a time, besides the margins.
TILE = 1 << 20
#: Contexts of a task that sorts suffixes, on average.
BUCKET = 10_000
#: A gram with more contexts than this is lengthened by content until its groups are smaller.
HOT = 30_000
#: An odd base of the polynomial gram hash (a fixed value).
BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, i < n."""
    up = np.full(n, BASE, np.uint64)
    down = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _sliding(x: np.ndarray, w: int, best: np.ufunc) -> np.ndarray:
    """best of x[j : j + w] for every j, in linear time."""
    n = len(x) - w + 1
    blocks = np.resize(x, -(-len(x) // w) * w)
    blocks[len(x) :] = x[-1]
    blocks = blocks.reshape(-1, w)
    left = best.accumulate(blocks, axis=1).ravel()
    right = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(right[:n], left[w - 1 : w - 1 + n])


class Anchors:
    """Positions that every string of min_len bytes has in common wherever it stands: its grams of least hash."""

    def __init__(self, min_len: int, gram: int, tile: int = TILE) -> None:
        self.min_len, self.gram, self.width, self.tile = min_len, gram, min_len - gram + 1, tile

    def find(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Anchors of the documents buf[offsets[d] : offsets[d + 1]], ascending."""
        n, w, k, found = len(buf), self.width, self.gram, []
        up, down = _powers(self.tile + 4 * self.min_len)
        for s in range(0, n, self.tile):
            lo, hi = max(0, s - w), min(n, s + self.tile + w + k)
            m = hi - lo
            if m < self.min_len:
                continue
            sums = np.zeros(m + 1, np.uint64)
            np.cumsum((buf[lo:hi].astype(np.uint64) + np.uint64(1)) * up[:m], out=sums[1:])
            h = (sums[k:] - sums[:-k]) * down[: m - k + 1]
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
            least = _sliding(h, w, np.minimum)
            at = np.arange(lo, lo + len(least))
            least[at + self.min_len > offsets[np.searchsorted(offsets, at, "right")]] = 0
            pad = np.zeros(w - 1, np.uint64)
            most = _sliding(np.concatenate([pad, least, pad]), w, np.maximum)
            i = np.flatnonzero((h == most) & (most > 0)) + lo
            found.append(i[(i >= s) & (i < s + self.tile)])
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def _common(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of the rows of a and b, whose lengths are la and lb."""
    out = np.minimum(la, lb)
    for k in range(0, len(a), 4096):
        differs = a[k : k + 4096] != b[k : k + 4096]
        first = np.where(differs.any(axis=1), differs.argmax(axis=1), a.shape[1])
        out[k : k + 4096] = np.minimum(out[k : k + 4096], first)
    return out


def _order(rows: np.ndarray, lens: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Lexicographic order of byte strings within groups."""
    _, rank = np.unique(rows.view(f"S{rows.shape[1]}").ravel(), return_inverse=True)
    return np.lexsort((lens, rank, group))


def _least_between(common: list[int]):
    """lcp of any two ranks from those of neighbours, by doubling."""
    levels = [common]
    while len(levels[-1]) > 1 << (len(levels) - 1):
        x, step = levels[-1], 1 << (len(levels) - 1)
        levels.append([min(p, q) for p, q in zip(x, x[step:])])

    def ask(i: int, j: int) -> int:
        i, j = (i, j) if i < j else (j, i)
        k = (j - i).bit_length() - 1
        return min(levels[k][i], levels[k][j - (1 << k)])

    return ask


def interval_tree(right: list[int], left_rank: list[int], left_common: list[int], min_len: int) -> tuple[list[int], list[int], list[int]]:
    """Left and right extents of every suffix of a group, and its maximal repeat group.

    right: common prefixes of neighbours in suffix order; left_rank: rank of each suffix's left context; left_common: common
    lengths of neighbouring ranks. A stack scan closes the common-prefix intervals from the deepest up. The members of an
    interval are held in the order of their left contexts, the smaller child put into the larger, so that left extensions
    diverge between neighbours: where a neighbour's left extension and the interval's depth make up min_len, both suffixes
    occur again with those extents and are of one group. All occurrences are found, not only neighbouring suffixes.
    """
    n = len(left_rank)
    lefts, rights, of = [0] * n, [0] * n, [*range(n)]
    ask = _least_between(left_common)

    def top(x: int) -> int:
        while of[x] != x:
            of[x] = of[of[x]]
            x = of[x]
        return x

    def merged(a: list[int], b: list[int], depth: int) -> list[int]:
        if len(a) < len(b):
            a, b = b, a
        for x in b:
            at = bisect_left(a, x)
            for y in a[max(0, at - 1) : at + 1]:
                shared = ask(x, y)
                if shared + depth >= min_len:
                    for z in (x, y):
                        lefts[z] = max(lefts[z], shared)
                        rights[z] = max(rights[z], depth)
                    p, q = top(x), top(y)
                    of[max(p, q)] = min(p, q)
            a.insert(at, x)
        return a

    stack: list[tuple[int, list[int]]] = []
    members = [left_rank[0]]
    for i in range(1, n + 1):
        depth = right[i - 1] if i < n else -1
        while stack and stack[-1][0] >= depth:
            d, held = stack.pop()
            members = merged(held, members, d)
        if i < n:
            stack.append((depth, members))
            members = [left_rank[i]]
    return lefts, rights, [top(x) for x in range(n)]


def repeats(group: np.ndarray, lefts: list[bytes], rights: list[bytes], min_len: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left extent, right extent, index of the first member of its repeat group) of every context; 0, 0 if it occurs once."""
    n = len(group)
    a = np.frombuffer(b"".join(x[::-1].ljust(min_len - gram, b"\0") for x in lefts), np.uint8).reshape(n, -1)
    b = np.frombuffer(b"".join(x.ljust(min_len, b"\0") for x in rights), np.uint8).reshape(n, -1)
    la, lb = (np.fromiter(map(len, x), np.int64, n) for x in (lefts, rights))
    by_right, by_left = _order(b, lb, group), _order(a, la, group)
    g = group[by_right]
    cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), n]
    right = _common(b[by_right[1:]], b[by_right[:-1]], lb[by_right[1:]], lb[by_right[:-1]])
    left = _common(a[by_left[1:]], a[by_left[:-1]], la[by_left[1:]], la[by_left[:-1]])
    place = np.empty(n, np.int64)
    place[by_left] = np.arange(n)
    ranks = place[by_right]
    out_l, out_r, out_g = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)
    for s, e in zip(cuts, cuts[1:]):
        if e - s == 2:
            i, j = by_right[s], by_right[s + 1]
            if left[s] + right[s] >= min_len:
                out_l[[i, j]], out_r[[i, j]], out_g[[i, j]] = left[s], right[s], min(i, j)
        elif e - s > 2:
            x, y, z = interval_tree(right[s : e - 1].tolist(), (ranks[s:e] - s).tolist(), left[s : e - 1].tolist(), min_len)
            own = by_left[s:e]
            out_l[own], out_r[own], out_g[own] = x, y, own[z]
    return out_l, out_r, out_g


def _text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary"))
    return docs.select(F.col(id_col).alias("id"), text.alias("t")).select("id", F.xxhash64("t").alias("x"), "t")


def _same(left: DataFrame, right: DataFrame) -> Column:
    return left["id"].eqNullSafe(right["rid"]) & (left["x"] == right["rx"])


def repeat_extents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = 400, gram: int = GRAM, bucket: int = BUCKET, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(occurrences, repeats): the anchors (id, x, pos, h, c), with all places of a context in a text, of grams that occur again, and (h, c, l, r, g): bytes to the left and right of the anchors with context c that occur again, and the maximal repeat group.

    Every string of min_len bytes holds an anchor: the least hash among its grams, which depends on the string alone. So
    equal strings have anchors of equal gram h, and the context c (what can share a string of min_len with the anchor) says
    what repeats. Contexts that occur twice are settled by their count; of each distinct one that may share a string with another (alike_contexts)
    a single copy goes to the suffix array of its gram's bucket. A gram of more than `hot` distinct contexts is lengthened by content first (lengthened).
    """
    small_batches(docs.sparkSession)
    find = Anchors(min_len, gram)
    wide = min_len - gram
    half = -(-wide // 2)
    base = _text(docs, id_col, text_col)
    kind = dict(base.dtypes)["id"]

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).cast(pa.large_binary()) if b.column(2).type != pa.large_binary() else b.column(2)
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            if not len(texts) or offsets[0] == offsets[-1]:
                continue
            data = memoryview(texts.buffers()[2])[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            at = find.find(np.frombuffer(data, np.uint8), offsets)
            d = np.searchsorted(offsets, at, "right") - 1
            pos = at - offsets[d]
            lefts = np.minimum(pos, wide)
            ends = np.minimum(at + min_len, offsets[d + 1])
            hashes, digest, window = [], xxhash.xxh3_64_intdigest, xxhash.xxh32_intdigest
            grams = [digest(data[x : x + gram]) for x in at.tolist()]
            for s, e, left in zip((at - lefts).tolist(), ends.tolist(), lefts.tolist()):
                hashes.append(digest(data[s:e], left))
            h, c = (np.array(x, np.uint64).view(np.int64) for x in (grams, hashes))
            sides = []
            for begin, size, fits in ((at - half, half + gram, lefts >= half), (at, gram + half, ends - at >= gram + half)):
                sides.append((np.array([window(data[x : x + size], 1 + len(sides)) if ok else 0 for x, ok in zip(begin.tolist(), fits.tolist())], np.uint32).view(np.int32), ~fits))
            order = np.lexsort((pos, c, h, d))  # a text that goes round and round has the same context at many places: one row
            d, h, c, sides = d[order], h[order], c[order], [(x[order], no[order]) for x, no in sides]
            first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1]) | (c[1:] != c[:-1])])) if len(d) else d
            places = pa.ListArray.from_arrays(pa.array(np.append(first, len(d)).astype(np.int32)), pa.array(pos[order].astype(np.int32)))
            own = pa.array(d[first])
            yield pa.record_batch([b.column(0).take(own), b.column(1).take(own), places, pa.array(h[first]), pa.array(c[first]), *[pa.array(x[first], mask=no[first]) for x, no in sides]], names=["id", "x", "pos", "h", "c", "a", "b"])

    every = base.mapInArrow(anchors, f"id {kind}, x long, pos array<int>, h long, c long, a int, b int")
    path = write_table(every, "anchors")
    found = base.sparkSession.read.schema(every.schema).parquet(path)
    again = found.groupBy("h").agg(F.sum(F.size("pos")).alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("n > 1")
    again = materialize(again.select("h", (F.col("c0") != F.col("c1")).alias("varied")), "grams")
    found = materialize(found.join(again, "h"), "repeated")
    delete_table(base.sparkSession, path)  # most anchors occur once; what follows reads the others only
    contexts = found.groupBy("h", "c", "varied").agg(F.sum(F.size("pos")).alias("n"), F.min(F.struct("id", "x", F.get("pos", F.lit(0)).alias("pos"), "a", "b")).alias("one"))
    contexts = materialize(contexts.select("h", "c", "varied", "n", F.col("one.id").alias("rid"), F.col("one.x").alias("rx"), F.col("one.pos").alias("pos"), "one.a", "one.b"), "contexts")

    varied = alike_contexts(contexts.where("varied"))
    sizes = varied.groupBy("h").agg(F.count(F.lit(1)).alias("m"))
    total, largest = sizes.agg(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.max("m"), F.lit(0))).first()
    buckets = max(1, -(-total // bucket))
    wanted = varied.groupBy("rid", "rx").agg(F.collect_list(F.struct("h", "c", "pos")).alias("wanted"))
    cut = base.join(wanted, _same(base, wanted)).select("t", "wanted")

    def context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                out: list[tuple] = []
                for t, rows in zip(b.column(0)[k : k + 256].to_pylist(), b.column(1)[k : k + 256].to_pylist()):
                    out += [(r["h"], r["c"], t[max(0, (p := r["pos"]) - wide) : p], t[p : p + min_len]) for r in rows]
                yield _batch(out, [pa.int64(), pa.int64(), pa.binary(), pa.binary()], ["h", "c", "l", "r"])

    parts = cut.mapInArrow(context, "h long, c long, l binary, r binary")

    def settle(group: pa.Table) -> pa.Table:
        rows = {(s, c): (h, left, right) for s, h, c, left, right in zip(*[group[x].to_pylist() for x in ("s", "h", "c", "l", "r")])}
        keys, values = [*rows], [*rows.values()]
        _, g = np.unique(np.array([s for s, _ in keys], np.int64), return_inverse=True)
        left, right, of = repeats(g, [x for _, x, _ in values], [y for _, _, y in values], min_len, gram)
        hit = np.flatnonzero(left + right)
        h, c = np.array([v[0] for v in values], np.int64), np.array([k[1] for k in keys], np.int64)
        return pa.table({"h": h[hit], "c": c[hit], "l": left[hit].astype(np.int32), "r": right[hit].astype(np.int32), "g": c[of[hit]]})

    schema = "h long, c long, l int, r int, g long"
    parts, alike = parts.withColumn("s", F.col("h")), None
    if largest > hot:
        parts = materialize(parts, "parts")
        many = sizes.where(F.col("m") > hot).select("h")
        groups, alike = lengthened(parts.join(many, "h", "left_semi").drop("s"), min_len, gram, hot)
        own = parts.join(many, "h", "left_semi").drop("s").join(groups, ["h", "c"])
        parts = parts.join(many, "h", "left_anti").unionByName(own)
        buckets += -(-groups.count() // bucket)
    settled = parts.withColumn("bucket", F.pmod("s", F.lit(buckets))).groupBy("bucket").applyInArrow(settle, schema)
    settled = settled if alike is None else settled.unionByName(alike)
    settled = materialize(settled.groupBy("h", "c").agg(F.max("l").alias("l"), F.max("r").alias("r"), F.min("g").alias("g")), "settled")
    copied = contexts.where("n > 1").select("h", "c", F.lit(wide).alias("l"), F.lit(min_len).alias("r"), F.col("c").alias("g"))
    extents = settled.unionByName(copied).groupBy("h", "c").agg(F.max("l").alias("l"), F.max("r").alias("r"), F.min("g").alias("g"))
    return found.select("id", "x", "pos", "h", "c"), materialize(extents, "extents")


def alike_contexts(contexts: DataFrame) -> DataFrame:
    """Those of distinct contexts (h, c, a, b) that may share a string of the least length with another of their gram.

    Such a string has half of what it has besides the gram, or more, on one side of it; so both contexts have the gram with that half on its left (a), or on
    its right (b), in common. In large corpora most grams stand in many texts by chance, and most contexts go here before any bytes are fetched. a and b are hashes: a collision
    costs a comparison.
    """
    sides = contexts.select("h", "c", F.explode(F.array_compact(F.array("a", "b"))).alias("k"))
    again = sides.groupBy("h", "k").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("h", "k")
    kept = sides.join(again, ["h", "k"], "left_semi").select("h", "c").distinct()
    return materialize(contexts.join(kept, ["h", "c"], "left_semi"), "alike")


def lengthened(parts: DataFrame, min_len: int, gram: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """Groups of at most `hot` contexts (h, c, s) of grams that more have, and extents (h, c, l, r, g) of contexts that share a whole string.

    parts: (h, c, l, r). Two contexts that have a string of min_len around a window of w bytes in common, have the window
    in common with half of the missing bytes more on its left or on its right. So every group that is still too large goes on with both
    longer windows, by their content, and no match is lost; one context may be in several groups. At min_len the window
    itself is the repeated string, and its members need no sorting.
    """
    def windows(width: int, more: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out: list[tuple] = []
                for h, c, left, right, reach in zip(*[b[x].to_pylist() for x in ("h", "c", "l", "r", "reach")]):
                    for a in {y for x in reach for y in (x, x + more)}:
                        if a <= len(left) and width - a <= len(right):
                            out.append((h, c, a, xxhash.xxh3_64_intdigest(left[len(left) - a :] + right[: width - a]) - (1 << 63)))
                yield _batch(out, [pa.int64(), pa.int64(), pa.int32(), pa.int64()], ["h", "c", "a", "k"])

        return run

    width, small, reach = gram, [], parts.withColumn("reach", F.array(F.lit(0)))
    while True:
        more = -(-(min_len - width) // 2)
        width += more
        last = width == min_len
        every = materialize(reach.mapInArrow(windows(width, more), "h long, c long, a int, k long"), "windows")
        sizes = every.groupBy("h", "a", "k").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("g")).where("m > 1")
        sizes = materialize(sizes, "window-sizes")
        large = (F.col("m") > hot) | F.lit(last)
        small.append(every.join(sizes.where(~large), ["h", "a", "k"]).select("h", "c", F.xxhash64(F.lit(width), "h", "a", "k").alias("s")))
        rest = every.join(sizes.where(large), ["h", "a", "k"])
        if last or sizes.where(large).limit(1).count() == 0:
            break
        reach = parts.join(rest.groupBy("h", "c").agg(F.collect_list("a").alias("reach")), ["h", "c"])
    groups = small[0]
    for x in small[1:]:
        groups = groups.unionByName(x)
    alike = rest.select("h", "c", F.col("a").alias("l"), (min_len - F.col("a")).alias("r"), "g")
    return materialize(groups, "groups"), alike.where(F.lit(last))


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = 400, **options: int) -> DataFrame:
    """(gram, group, id, start, end): every occurrence of every maximal repeat group, not only neighbours in suffix order.

    An occurrence is the widest run about one anchor, up to min_len to its right and what a string of min_len leaves to its
    left, that occurs again. Longer repeats have several anchors. Null texts have none; repeated rows are occurrences of their own.
    """
    found, extents = repeat_extents(docs, id_col, text_col, min_len, **options)
    rows = found.join(extents, ["h", "c"]).select(F.col("h").alias("gram"), F.col("g").alias("group"), F.col("id").alias(id_col), F.explode("pos").alias("pos"), "l", "r")
    return rows.select("gram", "group", id_col, (F.col("pos") - F.col("l")).alias("start"), (F.col("pos") + F.col("r")).alias("end"))


def whole_words(text: bytes, start: int, end: int) -> int:
    """Words of the text that lie wholly within a run."""
    run = text[start:end]
    n = len(run.split())
    if n and start and not text[start - 1 : start].isspace() and not run[:1].isspace():
        n -= 1
    if n and not text[end : end + 1].isspace() and end < len(text) and not run[-1:].isspace():
        n -= 1
    return n


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = 400, min_words: int = 0, whole_rows: bool = False, as_text: bool = False, **options: int) -> DataFrame:
    """id, n_bytes, spans (start, end of the maximal removed runs), kept (remaining bytes) for every row of docs; with whole_rows also `row`, a struct of all columns of docs.

    A byte goes if a string of min_len bytes that covers it also starts anywhere else, in the same document or another, as
    the input stands. min_words: only runs of at least so many whole words go. as_text: kept is text, without characters of
    which only a part remains. Null texts are empty; repeated rows are documents of their own and remove each other.
    """
    found, extents = repeat_extents(docs, id_col, text_col, min_len, **options)
    own = F.transform("pos", lambda p: F.struct((p - F.col("l")).alias("s"), (p + F.col("r")).alias("e")))
    spans = found.join(extents, ["h", "c"]).select(F.col("id").alias("rid"), F.col("x").alias("rx"), own.alias("own"))
    spans = spans.groupBy("rid", "rx").agg(F.flatten(F.collect_list("own")).alias("spans"))
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary"))
    base = docs.select(F.col(id_col).alias("id"), text.alias("t"), (F.struct("*") if whole_rows else F.struct(F.lit(0))).alias("row")).select("id", F.xxhash64("t").alias("x"), "t", "row")
    kind, row = (dict(base.dtypes)[c] for c in ("id", "row"))
    pieces = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, gone = [], []
            for t, found in zip(b.column(1), b.column(2).to_pylist()):
                t, runs = t.as_py(), []
                for s, e in sorted((max(0, x["s"]), min(len(t), x["e"])) for x in found or ()):
                    if runs and s <= runs[-1]["end"]:
                        runs[-1]["end"] = max(e, runs[-1]["end"])
                    else:
                        runs.append({"start": s, "end": e})
                if min_words:
                    runs = [r for r in runs if whole_words(t, r["start"], r["end"]) >= min_words]
                marks = [0, *(m for r in runs for m in (r["start"], r["end"])), len(t)]
                rest = b"".join(t[x:y] for x, y in zip(marks[::2], marks[1::2])) if runs else t
                kept.append(rest.decode("utf-8", "ignore") if as_text else rest)
                gone.append(runs)
            yield pa.record_batch([b.column(0), pa.array(gone, pieces), pa.array(kept, pa.string() if as_text else pa.binary()), b.column(3), b.column(4)], names=["id", "spans", "kept", "n_bytes", "row"])

    rows = base.join(spans, _same(base, spans), "left").select("id", "t", "spans", F.octet_length("t").cast("long").alias("n_bytes"), "row")
    out = rows.mapInArrow(run, f"id {kind}, spans array<struct<start:int,end:int>>, kept {'string' if as_text else 'binary'}, n_bytes long, row {row}")
    return out.select(F.col("id").alias(id_col), *["row"] * whole_rows, "n_bytes", "spans", "kept")
