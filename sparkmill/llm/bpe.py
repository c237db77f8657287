"""Byte-level BPE encoding and decoding by a given vocabulary of ranks."""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkmill.llm.shared import small_batches

#: Characters of a chunk and of its overlap with the next.
CHUNK, OVERLAP = 1_024, 64
#: Chunks that are worked through together where they are read; a text's further ones are dealt over all tasks in runs of so many.
RUN = 64
#: A match that ends so near the end of a chunk may look further in the whole text (contractions have up to three characters).
LOOK = 3
#: Pieces whose ids a worker remembers at a time, and the longest of them.
CACHE, CACHED = 200_000, 64


class Pieces(dict):
    """Pre-token -> its ids; the pair of lowest rank is merged until none has a rank. Short ones are remembered."""

    def __init__(self, ranks: dict[bytes, int], merge: Callable[[bytes], list[int]]) -> None:
        self.ranks, self.merge = ranks, merge

    def __missing__(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8", "replace")
        rank = self.ranks.get(raw)
        ids = [rank] if rank is not None else list(self.merge(raw))
        if len(self) >= CACHE:
            self.clear()
        if len(piece) <= CACHED:
            self[piece] = ids
        return ids


class Codec:
    """Encodes and decodes with one vocabulary; made once in a Python worker."""

    def __init__(self, ranks: bytes, pattern: str) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.pattern = regex.compile(pattern)
        merge = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})._core_bpe.encode_single_piece
        self.known = Pieces(self.ranks, merge)
        self.bytes_of = {i: b for b, i in self.ranks.items()}

    def cut(self, chunk: str, at: int) -> tuple[list[int], list[str]]:
        """Starts, counted from `at`, and pre-tokens of a chunk by itself."""
        if not self.pattern.groups:
            found = self.pattern.findall(chunk)
            ends = [*accumulate(map(len, found), initial=at)]
            if ends[-1] == at + len(chunk):  # matches follow each other without a gap
                return ends[:-1], found
        matches = [*self.pattern.finditer(chunk)]
        return [m.start() + at for m in matches], [m.group() for m in matches]

    def tokenise(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[list[int], list[str]]:
        """Starts and pre-tokens of a text: of its overlapping chunks each by itself, stitched at the first boundary that neighbours share.

        A match looks only forward, so from a true boundary on, whoever has it cuts as the whole text is cut. Where two
        chunks share none (a match longer than the overlap), the text is cut on from the last true boundary until it meets
        one of a later chunk.
        """
        cuts = [self.cut(text[s : s + chunk + overlap], s) for s in range(0, len(text), chunk)]
        starts, pieces, k, at = [], [], 0, 0
        while k < len(cuts):
            own, found = cuts[k]
            if k + 1 == len(cuts):
                starts += own[at:]
                pieces += found[at:]
                break
            seam, seen = (k + 1) * chunk, min(len(text), (k + 1) * chunk + overlap)
            sure = own[bisect_left(own, seam) : bisect_right(own, seen if seen == len(text) else seen - LOOK)]
            x = stitch(sure, cuts[k + 1][0][: overlap + 1])
            if x is not None:
                end = bisect_left(own, x)
                starts += own[at:end]
                pieces += found[at:end]
                k, at = k + 1, bisect_left(cuts[k + 1][0], x)
                continue
            if at >= len(own):
                break
            for m in self.pattern.finditer(text, own[at]):
                if m.start() >= seam:
                    k = m.start() // chunk
                    at = bisect_left(cuts[k][0], m.start())
                    if at < len(cuts[k][0]) and cuts[k][0][at] == m.start():
                        break
                starts.append(m.start())
                pieces.append(m.group())
            else:
                break
        return starts, pieces

    def ids(self, pieces: list[str]) -> list[int]:
        """Ids of pre-tokens, each by itself."""
        return [*chain.from_iterable(map(self.known.__getitem__, pieces))]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def _codec(ranks: bytes, pattern: str) -> Codec:
    return Codec(ranks, pattern)


def stitch(tail: list[int], head: list[int]) -> int | None:
    """The first boundary that two overlapping chunks share; from there on both are cut alike, as a match looks only forward."""
    return min(set(tail).intersection(head), default=None)


def vocabulary(df: DataFrame, ranks_path: str) -> Broadcast:
    """The rank file, under a megabyte, for the Python workers."""
    with open(ranks_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, run: int = RUN, decoded: bool = False) -> DataFrame:
    """(id, ids array<int>) for every row, with decoded also what decode makes of the ids; a null text has no ids, repeated rows stay, special tokens are ordinary text.

    Every text is cut into overlapping chunks, which are pre-tokenised each by itself and stitched at the first boundary that
    neighbours have in common; then each piece is encoded by itself. A text of more than `run` chunks is dealt over all
    tasks in overlapping runs of so many, which are stitched in the same way and put together by document; one of which two
    runs share no boundary (a match longer than the overlap) is stitched as a whole. Rows are told apart by their place in the one scan. The pattern's
    matches must leave no gaps in a text of so many chunks.
    """
    small_batches(docs.sparkSession)
    span = chunk * run
    vocab = vocabulary(docs, ranks_path)
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    kind = dict(base.dtypes)["id"]

    def lists(rows: list[list[int]]) -> pa.ListArray:
        ends = np.cumsum([0, *map(len, rows)], dtype=np.int64)
        flat = np.fromiter(chain.from_iterable(rows), np.int32, int(ends[-1]))
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))

    names = ["id", "ids", *["decoded"] * decoded]
    schema = f"id {kind}, ids array<int>" + ", decoded binary" * decoded

    def back(codec: Codec, ids: list[list[int]]) -> list[pa.Array]:
        return [pa.array([codec.decode(x) for x in ids], pa.binary())] * decoded

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocab.value, pattern)
        for b in batches:
            for k in range(0, b.num_rows, 100):  # ids take some ten times the memory of the text
                part = b.slice(k, 100)
                ids = [codec.ids(codec.tokenise(t.as_py(), chunk, overlap)[1]) for t in part.column(1)]
                yield pa.record_batch([part.column(0), lists(ids), *back(codec, ids)], names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, key, text in zip(*[c.to_pylist() for c in b.columns]):
                starts = [*range(0, len(text), span)]
                for k, s in enumerate(starts):
                    yield pa.record_batch([pa.array([row], pa.int64()), pa.array([key], b.schema.field(1).type), pa.array([k], pa.int32()), pa.array([s == starts[-1]]), pa.array([text[s : s + span + overlap]])], names=["row", "id", "k", "last", "t"])

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocab.value, pattern)
        for b in batches:
            head, tail, bounds = [], [], []
            for k, t in zip(b["k"].to_pylist(), b["t"].to_pylist()):
                s = np.array(codec.tokenise(t, chunk, overlap)[0], np.int64)
                # a boundary is sure where the match before it ends early enough to have seen all that it looks at
                head.append((s[s <= overlap] + k * span).tolist())
                tail.append((s[(s >= span) & (s <= len(t) - LOOK)] + k * span).tolist())
                bounds.append(s.tolist())
            yield pa.record_batch([*b.columns, *[pa.array(x, pa.list_(pa.int64())) for x in (head, tail, bounds)]], names=[*b.schema.names, "head", "tail", "bounds"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocab.value, pattern)
        for b in batches:
            ids, raw = [], []
            for k, t, bounds, begin, end, torn in zip(*[b[c].to_pylist() for c in ("k", "t", "bounds", "begin", "end", "torn")]):
                own: list[int] = []
                if not torn:
                    begin, end = begin - k * span, len(t) if end is None else end - k * span
                    marks = [x for x in bounds if begin <= x < end] + [end]
                    own = codec.ids([t[x:y] for x, y in zip(marks, marks[1:])])
                ids.append(own)
                raw.append(t[:span] if torn else None)
            yield pa.record_batch([b["row"], b["id"], b["k"], lists(ids), pa.array(raw, pa.string())], names=["row", "id", "k", "ids", "raw"])

    def whole(group: pa.Table) -> pa.Table:
        group = group.sort_by("k")
        raw, codec = group["raw"].to_pylist(), _codec(vocab.value, pattern)
        ids = list(chain.from_iterable(group["ids"].to_pylist())) if raw[0] is None else codec.ids(codec.tokenise("".join(raw), chunk, overlap)[1])
        return pa.Table.from_arrays([group["id"].slice(0, 1).combine_chunks(), lists([ids]), *back(codec, [ids])], names=names)

    here = base.where(F.length("t") <= span).mapInArrow(near, schema)
    far = base.where(F.length("t") > span).select(F.monotonically_increasing_id().alias("row"), "id", "t")
    far = far.mapInArrow(cut, f"row long, id {kind}, k int, last boolean, t string").repartition("row", "k")
    far = far.mapInArrow(pretokenise, f"row long, id {kind}, k int, last boolean, t string, head array<bigint>, tail array<bigint>, bounds array<bigint>")
    order = Window.partitionBy("row").orderBy("k")
    far = far.withColumn("end", F.array_min(F.array_intersect("tail", F.lead("head").over(order)))).drop("head", "tail")
    far = far.withColumn("begin", F.coalesce(F.lag("end").over(order), F.lit(0))).withColumn("torn", F.max(F.col("end").isNull() & ~F.col("last")).over(Window.partitionBy("row")))
    far = far.repartition("row", "k").mapInArrow(pieces, f"row long, id {kind}, k int, ids array<int>, raw string")
    far = far.groupBy("row").applyInArrow(whole, schema)
    return here.unionByName(far).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """`encoded` with a column `decoded`: the tokens' raw bytes, concatenated. Null ids decode to no bytes."""
    vocab = vocabulary(encoded, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocab.value, pattern)
        at = None
        for b in batches:
            at = b.schema.names.index(ids_col) if at is None else at
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                out = [codec.decode(x.values.to_pylist()) if x.is_valid else b"" for x in part.column(at)]
                yield pa.record_batch([*part.columns, pa.array(out, pa.binary())], names=[*b.schema.names, "decoded"])

    return encoded.mapInArrow(run, ", ".join([f"`{c}` {t}" for c, t in encoded.dtypes] + ["decoded binary"]))
