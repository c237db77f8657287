"""Encoding and decoding by a merge-type piece vocabulary with scores: an agenda of adjacent symbol pairs."""

from __future__ import annotations

import codecs
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from sparkmill.llm.shared import small_batches

#: The character that stands for a space within pieces, and the text that the unknown piece decodes to.
SPACE, UNKNOWN = "▁", " ⁇ "
#: Words whose ids a worker remembers at a time, the longest of them and of those that are merged together, and how many go together.
CACHE, SHORT, TOGETHER = 600_000, 32, 4_096
#: Rows of a batch that are encoded at a time.
ROWS = 400
#: What stands in an agenda for a pair that makes no piece, and among symbols for none.
NO_PAIR, GONE = np.int32(2**31 - 1), -(1 << 40)
_WORDS = regex.compile(f"{SPACE}+[^{SPACE}]*")


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    """One replacement character for each byte that belongs to no character."""
    return "�", error.start + 1


codecs.register_error("sparkmill-each-byte", _each_byte)


class Codec:
    """Encodes and decodes by one model; made once in a Python worker.

    A word is what stands between spaces, with its space before it; no piece goes beyond it. Takes merge-type models with byte
    pieces that put a space first and leave characters as they are, without user-defined, unused and many-word pieces; others
    are refused.
    """

    def __init__(self, model: bytes, check: bool = False) -> None:
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(model)
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        norm, train = spec.normalizer_spec, spec.trainer_spec
        normal = {p.piece: (i, p.score) for i, p in enumerate(spec.pieces) if p.type == kinds.NORMAL}
        if train.model_type != train.BPE or train.treat_whitespace_as_suffix or not train.byte_fallback:
            raise ValueError("not a merge-type vocabulary with byte pieces and spaces before words")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("the model's normalisation changes texts")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in spec.pieces) or any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("user-defined, unused and many-word pieces are not supported")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model) if check else None
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == kinds.BYTE}
        surface = {kinds.CONTROL: "", kinds.UNKNOWN: train.unk_surface or UNKNOWN}
        self.bytes_of = [bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else surface.get(p.type, p.piece.replace(SPACE, " ")).encode() for p in spec.pieces]
        self.control = {i for i, p in enumerate(spec.pieces) if p.type == kinds.CONTROL}
        self.spaced = {i for p, (i, _) in normal.items() if p.startswith(SPACE)}
        self.char_id = np.full(0x110000, -1, np.int64)
        for p, (i, _) in normal.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        # every way to join two pieces to a third: its place in the agenda (equal scores are equal) and the piece
        best_first = {score: k for k, score in enumerate(sorted({score for _, score in normal.values()}, reverse=True))}
        self.n = len(spec.pieces)
        ways = sorted((normal[p[:k]][0] * self.n + normal[p[k:]][0], best_first[score], i) for p, (i, score) in normal.items() for k in range(1, len(p)) if p[:k] in normal and p[k:] in normal)
        self.ways = {key: (place, i) for key, place, i in ways}
        keys, places, made = np.array([*ways, (1 << 62, NO_PAIR, -1)], np.int64).T  # the last one stops the search
        self.keys, self.places, self.made = keys.copy(), places.astype(np.int32), made.astype(np.int32)
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _symbols(self, words: list[str]) -> np.ndarray:
        """Pieces of the words' characters; one that has no piece stands as -1 - its code point."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        ids = self.char_id[points]
        return np.where(ids < 0, -1 - points, ids)

    def _agenda(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of pairs in the agenda, NO_PAIR for those that make no piece."""
        key = np.where((left >= 0) & (right >= 0), left * self.n + right, -1)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.places[at], NO_PAIR)

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words of at most SHORT characters, one word after the other, and how many each has: of each the adjacent pair whose piece scores highest is merged, the leftmost of equal ones, until no pair is a piece.

        A row of a matrix holds a word's symbols, one of another matrix the agenda of its pairs; each round takes every
        word's best pair.
        """
        lengths = np.array([len(w) for w in words])
        flat, wide = self._symbols(words), int(lengths.max())
        cells = np.arange(wide) < lengths[:, None]
        symbols = np.full((len(words), wide + 1), GONE, np.int64)
        symbols[:, :wide][cells] = flat
        agenda = np.full((len(words), wide), NO_PAIR, np.int32)
        agenda[:, :] = self._agenda(symbols[:, :-1], symbols[:, 1:])
        done, rows, steps = symbols.copy(), np.arange(len(words)), np.arange(wide + 1)
        while len(rows):
            i = agenda.argmin(axis=1)
            best = agenda[np.arange(len(rows)), i]
            over = best == NO_PAIR
            if over.any():
                done[rows[over]] = symbols[over]
                rows, symbols, agenda, i = rows[~over], symbols[~over], agenda[~over], i[~over]
                if not len(rows):
                    break
            each = np.arange(len(rows))
            piece = self.made[np.searchsorted(self.keys, symbols[each, i] * self.n + symbols[each, i + 1])]
            shift = steps + (steps > i[:, None])
            symbols = np.take_along_axis(np.pad(symbols, ((0, 0), (0, 1)), constant_values=GONE), shift, axis=1)
            agenda = np.take_along_axis(np.pad(agenda, ((0, 0), (0, 1)), constant_values=NO_PAIR), shift[:, :-1], axis=1)
            symbols[each, i] = piece
            agenda[each, i] = self._agenda(symbols[each, i], symbols[each, i + 1])
            behind = np.maximum(i - 1, 0)
            agenda[each, behind] = np.where(i > 0, self._agenda(symbols[each, behind], symbols[each, i]), agenda[each, behind])
        left = done != GONE
        return done[left], left.sum(axis=1)

    def merged_long(self, word: str) -> np.ndarray:
        """The same of one word of any length: the agenda is a heap by score and place, in which pairs whose symbols have changed since are passed over."""
        symbols, ways, n = self._symbols([word]).tolist(), self.ways, self.n
        end = len(symbols)
        after, before = [*range(1, end + 1)], [*range(-1, end - 1)]
        key = lambda x, y: x * n + y if x >= 0 and y >= 0 else -1
        heap = [(*ways[k][:1], i, k) for i, k in enumerate(map(key, symbols, symbols[1:])) if k in ways]
        heapify(heap)
        while heap:
            _, left, k = heappop(heap)
            right = after[left]
            if right == end or symbols[left] == GONE or key(symbols[left], symbols[right]) != k:
                continue
            symbols[left], symbols[right] = ways[k][1], GONE
            after[left] = beyond = after[right]
            if beyond < end:
                before[beyond] = left
            for x, y in ((left, beyond), (before[left], left)):
                if x >= 0 and y < end and (k := key(symbols[x], symbols[y])) in ways:
                    heappush(heap, (ways[k][0], x, k))
        return np.array([s for s in symbols if s != GONE], np.int64)

    def _ids(self, symbols: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Ids of each word's symbols; a character without a piece becomes its bytes."""
        points = -1 - symbols
        n = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        out, starts = np.repeat(symbols, n).astype(np.int32), np.cumsum(n) - n
        for point in np.unique(points[points >= 0]).tolist():
            at = starts[points == point]
            for k, byte in enumerate(chr(point).encode()):
                out[at + k] = self.byte_id[byte]
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])] * out.itemsize
        raw, marks = out.tobytes(), ends.tolist()
        return [raw[x:y] for x, y in zip(marks, marks[1:])]

    def learn(self, words: set[str]) -> None:
        """Have the ids of all these words, those of late being remembered."""
        if len(self.known) > CACHE // 2:
            self.old, self.known = {w: ids for w, ids in self.known.items() if len(w) <= SHORT}, {}
        fresh = []
        for w in words.difference(self.known):
            ids = self.old.get(w)
            if ids is None:
                fresh.append(w)
            else:
                self.known[w] = ids
        fresh.sort(key=len)  # words of like length share a matrix
        short = [SPACE + w for w in fresh if len(w) < SHORT]
        ids = [*chain.from_iterable(self._ids(*self.merged(short[k : k + TOGETHER])) for k in range(0, len(short), TOGETHER))]
        for w in fresh[len(short) :]:
            symbols = self.merged_long(SPACE + w)
            ids += self._ids(symbols, np.array([len(symbols)]))
        new = dict(zip(fresh, ids))
        if self.library:
            truth = self.library.encode([w.replace(SPACE, " ") for w in fresh], num_threads=1)
            for w, ids in zip(fresh, truth):
                if w and new[w] != array("i", ids).tobytes():
                    raise ValueError(f"the library encodes {w!r} in another way")
        self.known.update(new)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Words without a space in them and of further leading spaces are looked up without their first space."""
        cut = []
        for t in texts:
            words = t.replace(SPACE, " ").split(" ") if t else []
            if t and not all(words):  # spaces that follow each other belong to the next word
                words = [w[1:] for w in _WORDS.findall(SPACE + t.replace(" ", SPACE))]
            cut.append(words)
        self.learn(set(chain.from_iterable(cut)))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.int32) for words in cut]

    def decode(self, ids: list[int]) -> str:
        """The pieces' text; the space that encoding puts first is dropped, bytes that make no character are replaced one by one."""
        if not self.control.isdisjoint(ids):  # characters don't go over a control piece
            kept = [[*g] for control, g in groupby(ids, self.control.__contains__) if not control]
            return "".join([self._decode(g, k == 0) for k, g in enumerate(kept)])
        return self._decode(ids, True)

    def _decode(self, ids: list[int], first: bool) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        if first and ids and ids[0] in self.spaced:
            raw = raw[1:]
        return raw.decode("utf-8", "sparkmill-each-byte")


@lru_cache(maxsize=2)
def _codec(model: bytes, check: bool) -> Codec:
    return Codec(model, check)


def vocabulary(df: DataFrame, model_path: str) -> Broadcast:
    """The model file, under a megabyte, for the Python workers."""
    with open(model_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False, check: bool = True) -> DataFrame:
    """(id, ids array<int>) of every row, with `decoded` also the text that decode makes of the ids: no begin or end ids, no sampling.

    A text is cut into words at spaces, over which no piece goes, so merges within one don't touch another; the words that are
    new to a worker are merged by score-ordered agendas, those of a batch together, and with `check` encoded by the library
    too: a difference is an error. Texts are worked through where they are read, nothing is shuffled.

    A null text has no ids; the texts of control pieces are ordinary text; repeated rows stay; the id may be null; no rows
    give none. Other columns are not read, whatever their names.
    """
    small_batches(docs.sparkSession)
    vocab = vocabulary(docs, model_path)
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    names = ["id", "ids", *["decoded"] * decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocab.value, check)
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                part = b.slice(k, ROWS)
                ids = codec.encode(part.column(1).to_pylist())
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int64)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))
                texts = [pa.array([codec.decode(x.tolist()) for x in ids], pa.string())] if decoded else []
                yield pa.record_batch([part.column(0), lists, *texts], names=names)

    return base.mapInArrow(run, f"id {dict(base.dtypes)['id']}, ids array<int>" + ", decoded string" * decoded).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """`encoded` with a column of decoded texts after its own; null ids decode to the empty text. A column of that name is replaced."""
    vocab = vocabulary(encoded, model_path)
    rows = encoded.drop(decoded_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocab.value, False)
        for b in batches:
            at = b.schema.names.index(ids_col)
            for k in range(0, b.num_rows, ROWS):
                part = b.slice(k, ROWS)
                out = [codec.decode(x.values.to_pylist()) if x.is_valid else "" for x in part.column(at)]
                yield pa.record_batch([*part.columns, pa.array(out, pa.string())], names=[*b.schema.names, decoded_col])

    return rows.mapInArrow(run, ", ".join([f"`{c}` {t}" for c, t in rows.dtypes] + [f"`{decoded_col}` string"]))
