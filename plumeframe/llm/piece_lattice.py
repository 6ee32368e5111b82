"""SentencePiece encoding and decoding by a relational lattice.

Encoding. A text is the prefix mark and its characters, with spaces as marks, as in SentencePiece. It falls apart
into words at places that no piece crosses, so the best segmentation of the text is that of its words. Each distinct
word is segmented once: its substrings up to the longest piece are exploded and equi-joined with the piece table; the
matching edges are grouped by word, and a Viterbi fold over the word's positions (``aggregate``) keeps the best edge
into each position and walks back to where its pieces start. Characters without a piece become their UTF-8 byte
pieces. Documents are dealt over chunks of bounded size, one a task. A chunk numbers its words as they first occur, and gets
back the cuts of each number: the words themselves move once, towards the lattice.

Weights. The vocabulary at hand is a merge list, whose scores are minus the merge rank. As log probabilities they
would favour many short pieces, so an edge weighs -ln(256 + rank), the Zipf law of the rank, in fixed point. The ids are
the best path under these weights; a merge-order encoder may cut a word differently. Decoding gives back the text
exactly. A vocabulary with log probabilities is used as it is (``zipf=False``).

The piece table is broadcast; its size is checked against ``MAX_PIECES``. Words of more than ``FOLD_CHARS`` characters
(rows of signs, encoded data) are segmented by the same recurrence in a loop, in linear time, where they occur.

Cases. NULL text: NULL ids; empty text: no ids, decoded as empty. A mark character in a text is encoded as bytes, so that it
comes back as itself. Ties go to the shorter last piece, then the larger id. Repeated rows are encoded each. Texts of
any length are encoded whole. Input columns named like outputs are replaced.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from plumeframe.llm.common import schema_with, without

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNIT = 1 << 14
FALLBACK = -100 * UNIT
FOLD_CHARS = 48
# An edge is one number: stop and start (6 bits each), id + 1 (20 bits), cost (31 bits). So is the best way into a
# position: its score above start and id + 1, so that numbers compare like (score, start, id).
ID_BITS, COST_BITS = 20, 31
STEP_BITS = 6 + ID_BITS
ALPHABET = 256
MAX_PIECES = (1 << ID_BITS) - 2
CHUNK_BYTES = 32 << 20
SLICE_CHARS = 2 << 20
# Letters and digits part from other signs; the underscore and the raised two are joined with both in some pieces.
FINE = rf"{MARK}*+(?:(?:[^\W_²]++|[^\w{MARK}]++)(?:[_²]++(?:[^\W_²]++|[^\w{MARK}]++)?+)*+|(?:[_²]++(?:[^\W_²]++|[^\w{MARK}]++)?+)++)|{MARK}++"
COARSE = rf"{MARK}*[^{MARK}]+|{MARK}+"
RUN = re.compile(COARSE)


@dataclass
class Pieces:
    """A vocabulary: weight and id of each piece, the bytes each id stands for, and how texts fall into words."""

    edges: dict[str, tuple[int, int]]
    content: list[bytes]
    first_byte: int
    pattern: str
    longest: int


def load_pieces(model: str = MODEL, zipf: bool = True) -> Pieces:
    vocabulary = sentencepiece.SentencePieceProcessor(model_file=model)
    size = vocabulary.get_piece_size()
    if size > MAX_PIECES:
        raise ValueError(f"{size} pieces; {MAX_PIECES} at most")
    edges, content, first_byte = {}, [], 0
    for i in range(size):
        piece = vocabulary.id_to_piece(i)
        if vocabulary.is_byte(i):
            value = int(piece[3:5], 16)
            first_byte = i - value
            content.append(bytes([value]))
        elif vocabulary.is_control(i) or vocabulary.is_unknown(i) or vocabulary.is_unused(i):
            content.append(b"")
        else:
            score = vocabulary.get_score(i)
            weight = -math.log(256 - min(score, 0.0)) if zipf else min(score, 0.0)
            edges[piece] = max(round(weight * UNIT), 1 - (1 << COST_BITS)), i
            content.append(piece.replace(MARK, " ").encode())
    for pattern in (FINE, COARSE):
        if all(re.fullmatch(pattern, p) and len(re.findall(pattern, p)) == 1 for p in edges):
            return Pieces(edges, content, first_byte, pattern, max(map(len, edges)))
    raise ValueError("a piece holds a space after another character: texts do not fall apart into words")


def viterbi(word: str, pieces: Pieces) -> list[int]:
    """Ids of the best path, by the same recurrence and ties as the fold."""
    best = [(0, 0, -1)]
    for stop in range(1, len(word) + 1):
        options = [(best[stop - 1][0] + FALLBACK, stop - 1, -1)]
        for start in range(max(0, stop - pieces.longest), stop):
            edge = pieces.edges.get(word[start:stop])
            if edge:
                options.append((best[start][0] + edge[0], start, edge[1]))
        best.append(max(options))
    ids, at = [], len(word)
    while at:
        _, start, piece = best[at]
        ids.extend([piece] if piece >= 0 else [pieces.first_byte + b for b in reversed(word[start:at].encode())])
        at = start
    return ids[::-1]


def _parts(text: str) -> list[str]:
    """The text after the prefix mark, spaces as marks, cut at the mark characters of its own."""
    return [part.replace(" ", MARK) for part in f" {text}".split(MARK)] if text else []


def _best_edges(edges: str, word: str, pieces: Pieces) -> Column:
    """The best way into each position of the word, position 0 first: a fold over the edges in the order of their ends."""
    step = (1 << STEP_BITS) - 1
    alphabet = F.array(*[F.lit(_tail(*pieces.edges[chr(c)]) if chr(c) in pieces.edges else -FALLBACK).cast("long") for c in range(ALPHABET)])

    def into(best: Column, edge: Column) -> Column:
        stop = F.shiftright(edge, COST_BITS + STEP_BITS)
        place = F.shiftright(edge, COST_BITS).bitwiseAND(step)
        before = F.get(best, F.shiftright(place, ID_BITS)).bitwiseAND(~step)
        way = before + place - F.shiftleft(edge.bitwiseAND((1 << COST_BITS) - 1), STEP_BITS)
        # Longer pieces come first and mostly stay the best, so few edges write: the first into a position, and better ones.
        return F.when(F.get(best, stop) >= way, best).otherwise(F.concat(F.slice(best, F.lit(1), stop.cast("int")), F.array(way)))

    def letter(start: Column) -> Column:
        place = F.shiftleft(((start + 1) * 64 + start).cast("long"), COST_BITS + ID_BITS)
        return place + F.coalesce(F.get(alphabet, F.ascii(F.substring(F.col(word), start + 1, F.lit(1)))), F.lit(-FALLBACK))

    letters = F.transform(F.sequence(F.lit(0), F.length(word) - 1), letter)
    return F.aggregate(F.sort_array(F.concat(F.col(edges), letters)), F.array(F.lit(0).cast("long")), into)


def _cuts(best: str, word: str) -> Column:
    """Where the pieces of the best path start: bit i stands for position i."""
    one = F.lit(1).cast("long")

    def back(state: Column, _: Column) -> Column:
        # The state holds the position in its low 6 bits and the cuts found so far above them.
        at = state.bitwiseAND(63).cast("int")
        start = F.shiftright(F.get(best, at), ID_BITS).bitwiseAND(63)
        found = state - state.bitwiseAND(63) + start + F.call_function("shiftleft", one, (start + 6).cast("int"))
        return F.when(at > 0, found).otherwise(state)

    return F.shiftright(F.aggregate(F.sequence(F.lit(1), F.length(word)), F.length(word).cast("long"), back), 6)


def _tail(weight: int, piece: int) -> int:
    """Id and cost of an edge."""
    return ((piece + 1) << COST_BITS) - weight


def encode_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """``word, first, cuts`` of distinct ``word, first`` rows. Partitioned by word, nothing moves.

    Substrings of one character below ``ALPHABET`` are read from an array in the fold, all others meet the piece table.
    """
    # The empty piece at the start of each word keeps words of which no substring is a piece.
    table = [(p, _tail(*edge)) for p, edge in pieces.edges.items() if len(p) > 1 or ord(p) >= ALPHABET] + [("", -1)]
    known = F.broadcast(words.sparkSession.createDataFrame(table, "piece string, tail long"))
    size = F.length("word")
    # A word has a character at least; the outer form only keeps the optimizer from filtering one of the two uses of the words.
    starts = words.select("word", "first", F.explode_outer(F.sequence(F.lit(0), size - 1)).alias("start"))
    least = F.when(F.ascii(F.substring(F.col("word"), F.col("start") + 1, F.lit(1))) < ALPHABET, 2).otherwise(1) + F.col("start")
    some = F.when(least <= size, F.sequence(least, F.least(F.col("start") + pieces.longest, size))).otherwise(F.array().cast("array<int>"))
    stops = F.when(F.col("start") == 0, F.concat(F.array(F.lit(0)), some)).otherwise(some)
    spans = starts.select("word", "first", "start", F.explode(stops).alias("stop"))
    place = F.shiftleft((F.col("stop") * 64 + F.col("start")).cast("long"), COST_BITS + ID_BITS)
    edges = (
        spans.withColumn("piece", F.substring(F.col("word"), F.col("start") + 1, F.col("stop") - F.col("start")))
        .join(known, "piece")
        .select("word", "first", F.when(F.col("tail") >= 0, place + F.col("tail")).alias("edge"))
    )
    lattice = edges.groupBy("word").agg(F.collect_list("edge").alias("edges"), F.min("first").alias("first"))
    return lattice.withColumn("best", _best_edges("edges", "word", pieces)).select("word", "first", _cuts("best", "word").alias("cuts"))


def ids_at(word: str, cuts: int, pieces: Pieces) -> list[int]:
    """Ids of the pieces of a word that start at ``cuts``; characters without a piece as their bytes."""
    out: list[int] = []
    stop = len(word)
    while stop:
        start = (cuts & ((1 << stop) - 1)).bit_length() - 1
        edge = pieces.edges.get(word[start:stop])
        out.extend([edge[1]] if edge else [pieces.first_byte + b for b in reversed(word[start:stop].encode())])
        stop = start
    return out[::-1]


def text_of(ids: list[int], content: list[bytes]) -> str:
    """The text that ids stand for."""
    return b"".join(map(content.__getitem__, ids)).removeprefix(b" ").decode("utf-8", "replace")


def _texts(docs: pa.Table) -> Iterator[str | None]:
    """Texts of a chunk in an order that does not depend on how its rows arrived."""
    open_ = zstandard.ZstdDecompressor()
    for i in pc.sort_indices(docs, sort_keys=[("_key", "ascending"), ("_packed", "ascending")]):
        packed = docs["_packed"][i.as_py()]
        yield open_.decompress(packed.as_py()).decode() if packed.is_valid else None


def _numbered(chunk: pa.Table, pattern: re.Pattern) -> pa.Table:
    """The words of a chunk that the lattice segments, numbered as they first occur.

    Runs between spaces are collected first, as a word never crosses a space; only distinct ones are cut into words.
    """
    runs: dict[str, None] = {}
    for text in _texts(chunk):
        for part in _parts(text or ""):
            runs.update(dict.fromkeys(RUN.findall(part)))
    numbers: dict[str, int] = {}
    for run in runs:
        for word in pattern.findall(run):
            if word not in numbers:
                numbers[word] = len(numbers)
    short = [(i, w) for w, i in numbers.items() if len(w) <= FOLD_CHARS]
    at, words = zip(*short) if short else ((), ())
    return pa.table({"_chunk": pa.array([chunk["_chunk"][0].as_py()] * len(at), pa.int32()), "_at": pa.array(at, pa.int32()), "word": pa.array(words, pa.string())})


def _gathered(flat: np.ndarray, begins: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Stretches of ``flat`` one after the other."""
    return flat[np.repeat(begins - np.cumsum(count) + count, count) + np.arange(count.sum())]


class _ChunkIds(dict):
    """Place of each word of a chunk: its ids are found when it first occurs and laid one after the other; place 0 is the mark character."""

    def __init__(self, lists: pa.Table, pieces: Pieces):
        super().__init__()
        self.pieces, self.pattern = pieces, re.compile(pieces.pattern)
        at = lists["_at"].to_numpy()
        self.cuts = np.zeros(int(at.max(initial=-1)) + 1, np.int64)
        self.cuts[at] = lists["cuts"].to_numpy()
        mark = [pieces.first_byte + b for b in MARK.encode()]
        self.flat, self.sizes = array("i", mark), array("q", [len(mark)])
        self.content = np.frombuffer(b"".join(pieces.content), np.uint8)
        self.lengths = np.array([len(c) for c in pieces.content], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths

    def __missing__(self, word: str) -> int:
        # Words are numbered in the order in which they first occur, as they were when the lattice got them.
        at = len(self)
        ids = ids_at(word, int(self.cuts[at]), self.pieces) if len(word) <= FOLD_CHARS else viterbi(word, self.pieces)
        self.flat.extend(ids)
        self.sizes.append(len(ids))
        self[word] = at + 1
        return at + 1

    def decoded(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The bytes that each stretch of ids stands for."""
        ends = np.concatenate([[0], np.cumsum(self.lengths[ids])])[offsets]
        joined = _gathered(self.content, self.begins[ids], self.lengths[ids]).tobytes()
        return [joined[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]

    def encoded(self, texts: list[str | None]) -> tuple[pa.ListArray, pa.BooleanArray]:
        """Ids of the texts, and whether decoding gives each back."""
        places, ends = array("q"), []
        for text in texts:
            for i, part in enumerate(_parts(text or "")):
                if i:
                    places.append(0)
                places.extend(map(self.__getitem__, self.pattern.findall(part)))
            ends.append(len(places))
        at, sizes, flat = np.array(places, np.int64), np.array(self.sizes, np.int64), np.array(self.flat, np.int32)
        count = sizes[at]
        values = _gathered(flat, (np.cumsum(sizes) - sizes)[at], count)
        offsets = np.concatenate([[0], np.concatenate([[0], np.cumsum(count)])[ends]]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array([t is None for t in texts], pa.bool_()))
        same = [t is None or raw.removeprefix(b" ") == t.encode() for t, raw in zip(texts, self.decoded(values, offsets))]
        return lists, pa.array(same, pa.bool_())


def encode(docs: DataFrame, pieces: Pieces, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The columns of ``docs`` but the text, ``ids``: array<int>, and ``round_trip``: whether decoding the ids gives the text back."""
    spark = docs.sparkSession
    columns = without(docs, ("ids", "round_trip", "_chunk", "_key", "_packed"))
    others = [c for c in columns.columns if c != "text"]
    volume = columns.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, math.ceil(volume / chunk_bytes))
    keys = [c for c in ("doc_id",) if c in others]
    placed = columns.withColumn("_key", F.xxhash64(*keys, "text")).withColumn("_chunk", F.pmod("_key", F.lit(chunks)).cast("int"))
    shared = spark.sparkContext.broadcast(pieces)
    names = [*others, "_chunk", "_key"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            packed = [None if t is None else press.compress(t.encode()) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(packed, pa.binary())], names=[*names, "_packed"])

    # One chunk a task. No fewer partitions than other shuffles have, or Spark would deal the texts out a second time.
    partitions = max(chunks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    packed = placed.mapInArrow(pack, schema_with(placed.select(*names), _packed="binary")).repartitionById(partitions, "_chunk")

    # Both uses of the packed texts, and both of the words, read all columns of one exchange, so Spark runs it once.
    numbered = lambda chunk: _numbered(chunk, re.compile(shared.value.pattern))
    words = packed.groupBy("_chunk").applyInArrow(numbered, "_chunk int, _at int, word string").filter(F.col("word").isNotNull()).repartition("word")
    table = encode_words(words.groupBy("word").agg((F.min("_chunk").cast("long") + F.min("_at")).alias("first")), pieces)
    lists = words.join(table.filter(F.col("first") >= 0).select("word", "cuts").hint("shuffle_hash"), "word").select("_chunk", "_at", "cuts")

    def assemble(docs: pa.Table, lists: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.Table.from_pylist([], to_arrow_schema(out))
        chunk = _ChunkIds(lists, shared.value)
        slices, waiting, chars = [], [], 0
        for text in _texts(docs):
            waiting.append(text)
            chars += len(text or "")
            if chars >= SLICE_CHARS:
                slices.append(chunk.encoded(waiting))
                waiting, chars = [], 0
        slices.append(chunk.encoded(waiting))
        order = pc.sort_indices(docs, sort_keys=[("_key", "ascending"), ("_packed", "ascending")])
        found = docs.select(others).take(order)
        for name, kind, parts in zip(("ids", "round_trip"), (pa.list_(pa.int32()), pa.bool_()), zip(*slices)):
            found = found.append_column(name, pa.chunked_array(parts, kind))
        return found

    out = schema_with(columns.select(*others), ids="array<int>", round_trip="boolean")
    return packed.groupBy("_chunk").cogroup(lists.repartitionById(partitions, "_chunk").groupBy("_chunk")).applyInArrow(assemble, out)


def decode(encoded: DataFrame, pieces: Pieces, text: str = "text") -> DataFrame:
    """``encoded`` with the text of its ``ids``; ids outside the vocabulary are an error."""
    shared = encoded.sparkSession.sparkContext.broadcast(pieces)
    columns = without(encoded, (text,))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content = shared.value.content
        for batch in batches:
            texts = [text_of(ids.values.to_pylist(), content) if ids.is_valid else None for ids in batch["ids"]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text])

    return columns.mapInArrow(run, schema_with(columns, **{text: "string"}))
