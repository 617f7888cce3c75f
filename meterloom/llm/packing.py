"""Packing documents into training sequences: shortest pack first over the length histogram.

Documents are tokenized where they are read and cut into pieces of at most one
sequence. Only the histogram of piece lengths (at most one bin per length)
reaches the driver, which plans patterns of lengths and how often each occurs.
Pieces then find their place by their rank among pieces of their length: ranks
are counted per (length, salt) and shifted by the counts of the salts before,
so a length that a third of all pieces share is spread over many tasks.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterloom.llm.common import prepare, slices, texts
from meterloom.session import cut

SEQUENCE = 4096
END_ID = 2
#: Words remembered by a worker before it starts afresh.
MEMO = 600_000
#: More than the pieces of any one length.
RANKS = 1 << 48
#: Rows that share a (length, salt) at most, about.
SALT_ROWS = 5_000

# The vocabulary's pre-token classes within lower-cased Latin-1 text without white space.
LATIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\sa-zªµºß-öø-ÿ0-9²³¹¼-¾]+")
BEYOND = re.compile(r"[^!-~¡-ÿ]|<\|")


def packed(ids: list[int]) -> bytes:
    """Little-endian 32-bit."""
    return struct.pack(f"<{len(ids)}I", *ids)


class WordTokens:
    """Ids of white-space separated words, each tokenized once and remembered.

    The vocabulary drops white space and splits at it, so a text's ids are those
    of its words. Plain words skip the library's normalization; any other goes
    through the whole library.
    """

    def __init__(self, text: str):
        self.text = text
        self.ready = False

    def __getstate__(self):
        return {"text": self.text, "ready": False}

    def _setup(self) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(self.text)
        self.model = self.whole.model
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(plain)]
        self.letters = {**{b: b for b in plain}, **{b: 256 + i for i, b in enumerate(others)}}  # bytes as printable letters
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.ready = True

    def _piece(self, piece: str) -> bytes:
        spelled = piece.encode().decode("latin-1").translate(self.letters)
        found = self.pieces[piece] = packed([t.id for t in self.model.tokenize(spelled)])
        return found

    def _word(self, word: str) -> bytes:
        if BEYOND.search(word):
            return packed(self.whole.encode(word, add_special_tokens=False).ids)
        own = LATIN_PIECES.findall(word.lower())
        get = self.pieces.get
        if len(own) == 1:
            return get(own[0]) or self._piece(own[0])
        return b"".join([get(p) or self._piece(p) for p in own])

    def of(self, words: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each word."""
        if not self.ready:
            self._setup()
        if len(self.words) > MEMO:
            self.words.clear()
        if len(self.pieces) > MEMO:
            self.pieces.clear()
        memo = self.words
        for word in words:
            if word not in memo:
                memo[word] = self._word(word)
        return [memo[w] for w in words]

    def texts(self, column: pa.Array) -> Iterator[bytes]:
        """Ids of each text."""
        for lo, hi in slices(column):
            split = pc.ascii_split_whitespace(column.slice(lo, hi - lo))
            coded = split.flatten().dictionary_encode()
            known = pa.array(self.of(coded.dictionary.to_pylist()), pa.large_binary())
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]).astype(np.int32)
            words = pa.ListArray.from_arrays(ends, known.take(coded.indices))
            yield from pc.binary_join(words, pa.scalar(b"", pa.large_binary())).to_pylist()


def pieces_of(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, key``: each document's ids and the end id, cut every ``sequence`` ids.

    A null or empty text is the end id alone. ``key`` (crc32 of all the ids) tells
    apart documents that share an id.
    """
    prepare(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(WordTokens(file.read()))  # the size of the vocabulary
    end = packed([end_id])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "key"]
        kinds = [pa.int64()] * 6
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), shared.value.texts(batch.column(1))):
                ids += end
                total, key = len(ids) // 4, zlib.crc32(ids)
                for start in range(0, total, sequence):
                    part = ids[4 * start : 4 * (start + sequence)]
                    rows.append((doc_id, start, len(part) // 4, key if len(part) == len(ids) else zlib.crc32(part), total, key))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names)

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, key long")


def shortest_pack_first(histogram: dict[int, int], sequence: int) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns ``(count, lengths)`` holding every length of the histogram exactly as often as it occurs.

    Lengths are placed longest first. All pieces of a length go together to the
    pattern with the least in it, that is the most room, as far as its count
    reaches; a pattern used in part splits in two. When the emptiest pattern has
    no room left for the length, its pieces open new sequences.
    """
    by_room: dict[int, list[list]] = defaultdict(list)  # room left -> [count, lengths]
    rooms: list[int] = []  # rooms in use, ascending

    def put(room: int, count: int, lengths: tuple[int, ...]) -> None:
        if not by_room[room]:
            insort(rooms, room)
        by_room[room].append([count, lengths])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and rooms and rooms[-1] >= length:
            room = rooms[-1]
            pattern = by_room[room][-1]
            used = min(left, pattern[0])
            pattern[0] -= used
            if not pattern[0]:
                by_room[room].pop()
                if not by_room[room]:
                    rooms.pop()
            put(room - length, used, (*pattern[1], length))
            left -= used
        fit = sequence // length  # a new sequence is the emptiest until it is full
        if left // fit:
            put(sequence - fit * length, left // fit, (length,) * fit)
        if left % fit:
            put(sequence - left % fit * length, 1, (length,) * (left % fit))
    return [(count, lengths) for room in sorted(by_room) for count, lengths in by_room[room]]


def places(patterns: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """Columns ``length, first rank, first sequence, offset``, sorted: where runs of ranks of a length go, a sequence each."""
    used: dict[int, int] = defaultdict(int)
    out, base = [], 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            out.append((length, used[length], base, offset))
            used[length] += count
            offset += length
        base += count
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 4)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Every id of every document (a null or empty text: the end id alone) lies in
    one piece; a sequence's pieces follow each other from offset 0. Repeated rows
    are packed each; ties take ranks by id (nulls last), start and content. An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = cut(pieces_of(docs, tokenizer_path, id_col, text_col, sequence, end_id))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per length
    salts = max(1, -(-max(histogram.values(), default=0) // SALT_ROWS))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "key"), F.lit(salts)))
    own = Window.partitionBy("length", "salt").orderBy(F.col("doc_id").asc_nulls_last(), "start", "key")
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    # a row per length and salt: as many as there are groups of SALT_ROWS, and no more than lengths x salts
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = salted.withColumn("own", F.row_number().over(own)).join(before.select("length", "salt", F.coalesce("before", F.lit(0)).alias("before")), ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("own") - 1 + F.col("before"))
    return _placed(ranked, places(shortest_pack_first(histogram, sequence)))


def _placed(ranked: DataFrame, runs: np.ndarray) -> DataFrame:
    """Each rank's run by binary search. The table of runs has an entry per slot of a pattern: the lengths bound it, not the data."""
    shared = ranked.sparkSession.sparkContext.broadcast(runs)
    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        keys = table[:, 0] * RANKS + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(name).to_numpy(zero_copy_only=False) for name in ("length", "rank"))
            hit = np.searchsorted(keys, length * RANKS + rank, side="right") - 1
            sequence_id = table[hit, 2] + rank - table[hit, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(sequence_id), pa.array(table[hit, 3])], [*kept, "sequence_id", "offset"])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked.select(*kept, "rank").mapInArrow(run, schema)
