"""Byte-level BPE: whole pre-tokens through a minimal perfect hash, the rest by a heap over linked bytes.

Misses are merged side by side: each has a row of linked bytes and a heap in the
form of an implicit binary tree over its pairs, whose root is the pair of lowest
rank, leftmost among equals. A round merges every row's root and repairs the
paths of the three pairs it changes. Long pieces have a heap of their own.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame

from meterloom.llm.common import prepare, slices, texts

#: Words in each of the two generations that a worker remembers.
MEMO = 400_000
#: Longest piece, in bytes, that is merged in a row beside others; rows merged at once.
ROW_BYTES = 64
ROWS = 1 << 14
#: Displacements tried at once.
TRIES = 256

#: Bits of a position in a row, and a rank above all others.
POSITION = 7
NEVER = 1 << 40

# The pre-token pattern's classes within Latin-1, where the built-in regex module can apply them.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
NUMBERS = "0-9²³¹¼-¾"
SPACES = r"\t-\r \x85\xa0"
LATIN = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)
BEYOND = re.compile(r"[^\x00-\xff]")
#: Bytes after a blank that surely begin no further white space. Whatever stands before such a blank, a pre-token
#: begins with it, so a text's pre-tokens are those of its parts between such blanks.
_CUTS = np.array([b > 0x20 and b != 0x7F and b not in (0xC2, 0xE1, 0xE2, 0xE3) for b in range(256)])


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by id."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    found = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [found[i] for i in range(len(found))]


class PerfectHash:
    """Minimal perfect hash of a fixed set of byte strings: hash, then displace.

    Keys fall into buckets of about four; buckets are placed largest first, each
    with the smallest displacement that sends all its keys to free slots, of
    which there are as many as keys.
    """

    def __init__(self, keys: list[bytes]):
        self.size = n = len(keys)
        self.buckets = max(1, n // 4)
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
        if len(np.unique(hashes)) != n:
            raise ValueError("keys repeat")
        order: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, b in enumerate((hashes % np.uint64(self.buckets)).tolist()):
            order[b].append(i)
        self.displace = np.zeros(self.buckets, dtype=np.uint64)
        self.slots = np.full(n, -1, dtype=np.int64)
        taken = np.zeros(n, dtype=bool)
        tries = np.arange(TRIES, dtype=np.uint64)[:, None]
        for b in sorted(range(self.buckets), key=lambda b: -len(order[b])):
            own = order[b]
            if not own:
                break
            start = 0
            while True:
                d = tries + np.uint64(start)
                at = np.sort(self._slot(hashes[own][None, :], d), axis=1)
                good = ~taken[at].any(axis=1) & (at[:, 1:] != at[:, :-1]).all(axis=1)
                if good.any():
                    break
                start += TRIES
            self.displace[b] = start + int(good.argmax())
            at = self._slot(hashes[own], self.displace[b])
            taken[at], self.slots[at] = True, own
        self.marks = hashes[self.slots]

    def _slot(self, hashes: np.ndarray, displace) -> np.ndarray:
        mixed = (hashes ^ (np.asarray(displace) * np.array([0x9E3779B97F4A7C15], np.uint64))) * np.uint64(0xD6E8FEB86659FD93)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return ((mixed >> np.uint64(20)) % np.uint64(self.size)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Key number per hash, -1 for a hash of no key."""
        if not len(hashes) or not self.size:
            return np.full(len(hashes), -1, dtype=np.int64)
        slot = self._slot(hashes, self.displace[hashes % np.uint64(self.buckets)])
        return np.where(self.marks[slot] == hashes, self.slots[slot], -1)


class Codec:
    """Encoder and decoder for one vocabulary; picklable, built once on the driver."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.pattern = pattern
        self.perfect = PerfectHash(tokens)
        self._setup()

    def _setup(self) -> None:
        self.ranks = ranks = {t: i for i, t in enumerate(self.tokens)}
        self.any_text = regex.compile(self.pattern)
        self.memo: dict[str, tuple[bytes, int, bytes]] = {}
        self.older = self.memo
        # what two neighbouring tokens become: the left one's id above the right one's
        self.bits = len(self.tokens).bit_length()
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.joins = {
            ranks[t[:k]] << self.bits | ranks[t[k:]]: i for i, t in enumerate(self.tokens) for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks
        }
        self.spelled = [b"%d" % i for i in range(len(self.tokens))]
        order = np.array(sorted(self.joins), dtype=np.int64)
        self.pairs, self.become = order, np.array([self.joins[k] for k in order.tolist()], dtype=np.int64)

    def __getstate__(self):
        return {"tokens": self.tokens, "pattern": self.pattern, "perfect": self.perfect}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._setup()

    def split(self, text: str) -> list[str]:
        return (self.any_text if BEYOND.search(text) else LATIN).findall(text)

    def merge(self, piece: bytes) -> list[int]:
        """Lowest rank first, leftmost among equals: a heap of pairs over a linked list of bytes."""
        joined, bits, n = self.joins.get, self.bits, len(piece)
        ids = [self.single[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waits = [joined(a << bits | b) for a, b in zip(ids, ids[1:])]  # what each pair would become
        heap = [rank << 32 | i for i, rank in enumerate(waits) if rank is not None]
        waits.append(None)
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            i, rank = top & 0xFFFFFFFF, top >> 32
            if waits[i] != rank:
                continue  # one side has changed since
            j = after[i]
            k = after[i] = after[j]
            ids[i], ids[j], waits[j], waits[i] = rank, -1, None, None
            if k < n:
                before[k] = i
                waits[i] = new = joined(rank << bits | ids[k])
                if new is not None:
                    heapq.heappush(heap, new << 32 | i)
            if (h := before[i]) >= 0:
                waits[h] = new = joined(ids[h] << bits | rank)
                if new is not None:
                    heapq.heappush(heap, new << 32 | h)
        return [i for i in ids if i >= 0]

    def _joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What each pair of neighbours becomes, ``NEVER`` for none; an id below 0 stands for no neighbour."""
        key = np.where((left < 0) | (right < 0), -1, left << self.bits | right)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.become[at], NEVER)

    def merge_rows(self, pieces: list[bytes]) -> list[list[int]]:
        """``merge`` of many pieces of at most ``ROW_BYTES`` bytes."""
        size = np.array([len(p) for p in pieces])
        width = max(2, 1 << (int(size.max()) - 1).bit_length())  # leaves: one per pair, and the last byte's, which waits for nothing
        rows = np.arange(len(pieces))
        inside = np.arange(width) < size[:, None]
        ids = np.full((len(pieces), width + 1), -1, dtype=np.int64)  # the last column: no neighbour
        ids[:, :-1][inside] = np.array(self.single, dtype=np.int64)[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        after = np.broadcast_to(np.arange(1, width + 2), ids.shape).copy()
        after[rows, size - 1] = width
        before = np.broadcast_to(np.arange(-1, width), ids.shape).copy()
        before[:, 0] = width
        place = np.arange(width)
        heap = np.full((len(pieces), 2 * width), NEVER << POSITION, dtype=np.int64)
        heap[:, width:] = self._joined(ids[:, :-1], ids[:, 1:]) << POSITION | place
        for parent in range(width - 1, 0, -1):
            heap[:, parent] = np.minimum(heap[:, 2 * parent], heap[:, 2 * parent + 1])
        levels = width.bit_length() - 1
        while True:
            rows = rows[heap[rows, 1] < NEVER << POSITION]
            if not len(rows):
                break
            top = heap[rows, 1]
            i, rank = top & ((1 << POSITION) - 1), top >> POSITION
            j = after[rows, i]
            k = after[rows, j]
            h = before[rows, i]
            ids[rows, i], ids[rows, j], after[rows, i], before[rows, k] = rank, -1, k, i
            heap[rows, width + j] = NEVER << POSITION
            heap[rows, width + i] = self._joined(rank, ids[rows, k]) << POSITION | i
            known = h < width
            back, own = h[known], rows[known]
            heap[own, width + back] = self._joined(ids[own, back], rank[known]) << POSITION | back
            i, j = i + width, j + width
            h = np.where(known, h + width, i)
            for _ in range(levels):
                i, j, h = i >> 1, j >> 1, h >> 1
                for at in (i, j, h):
                    heap[rows, at] = np.minimum(heap[rows, 2 * at], heap[rows, 2 * at + 1])
        left = ids[:, :-1] >= 0
        flat, ends = ids[:, :-1][left].tolist(), np.cumsum(left.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def merge_all(self, pieces: list[bytes]) -> list[list[int]]:
        """``merge`` of each, short ones of like length in rows."""
        out: list[list[int]] = [[]] * len(pieces)
        order = sorted((len(p), i) for i, p in enumerate(pieces) if len(p) <= ROW_BYTES)
        for limit in (8, 16, 32, ROW_BYTES):
            own = [i for n, i in order if limit // 2 < n <= limit or (limit == 8 and n <= 4)]
            for start in range(0, len(own), ROWS):
                part = own[start : start + ROWS]
                for i, ids in zip(part, self.merge_rows([pieces[i] for i in part])):
                    out[i] = ids
        for i, p in enumerate(pieces):
            if len(p) > ROW_BYTES:
                out[i] = self.merge(p)
        return out

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each pre-token: the perfect hash first, the heap for what it misses."""
        raw = [p.encode() for p in pieces]
        found = self.perfect.find(np.array([xxhash.xxh3_64_intdigest(r) for r in raw], dtype=np.uint64)).tolist()
        tokens = self.tokens
        known = [i >= 0 and tokens[i] == r for i, r in zip(found, raw)]
        merged = iter(self.merge_all([r for r, hit in zip(raw, known) if not hit]))
        return [[i] if hit else next(merged) for i, hit in zip(found, known)]

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.encode_pieces(self.split(text)) for i in ids]

    def decode(self, ids: list[int]) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])

    def recall(self, words: list[str]) -> list[tuple[bytes, int, bytes]]:
        """Ids as text, their count and the decoded bytes of each word, from the worker's memory where it has them."""
        if len(self.memo) > MEMO:
            self.older, self.memo = self.memo, {}
        memo, older = self.memo, self.older
        new = []
        for w in words:
            if w not in memo:
                if w in older:
                    memo[w] = older[w]
                else:
                    new.append(w)
        split = [self.split(w) for w in new]
        pieces = list(dict.fromkeys([p for own in split for p in own]))
        ids_of = dict(zip(pieces, self.encode_pieces(pieces)))
        spelled, tokens = self.spelled, self.tokens
        for w, own in zip(new, split):
            ids = ids_of[own[0]] if len(own) == 1 else [i for p in own for i in ids_of[p]]
            memo[w] = (b" ".join([spelled[i] for i in ids]), len(ids), b"".join([tokens[i] for i in ids]))
        return [memo[w] for w in words]


def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def _words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """A text column's parts between blanks where pre-tokens surely begin, and the number of the first part of each text."""
    column = pa.concat_arrays([column])
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[: len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[: ends[-1]]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[: len(data) - 1] = (data[:-1] == 0x20) & _CUTS[data[1:]]
    cut[ends[1:][ends[1:] > 0] - 1] &= data[ends[1:][ends[1:] > 0] - 1] != 0x20  # a text's last byte is followed by no byte of its own
    cut[ends] = True
    starts = np.flatnonzero(cut).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(data))
    return words, np.searchsorted(starts, ends).astype(np.int32)


def _documents(made: Codec, column: pa.Array) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """Slice by slice, per text: its ids joined by blanks, the decoded bytes, the number of ids."""
    for lo, hi in slices(column):
        words, first = _words(column.slice(lo, hi - lo))
        coded = words.dictionary_encode()
        text, count, raw = zip(*made.recall(coded.dictionary.to_pylist())) if len(words) else ((), (), ())

        def joined(values: pa.Array, by: bytes) -> pa.Array:
            return pc.binary_join(pa.ListArray.from_arrays(first, values.take(coded.indices)), pa.scalar(by, pa.large_binary()))

        total = np.concatenate([[0], np.cumsum(np.array(count, dtype=np.int64)[coded.indices.to_numpy(zero_copy_only=False)])])
        yield joined(pa.array(text, pa.large_binary()), b" "), joined(pa.array(raw, pa.large_binary()), b""), np.diff(total[first])


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>, decoded binary`` of every whole text; no special tokens.

    A null or empty text has no ids. No shuffle: each row is encoded where it is read.
    """
    made = _shared(docs, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, decoded = [], []
            for texts_of_ids, raw, _ in _documents(made.value, batch.column(1)):
                ids += [np.array(t.split(), dtype=np.int32) for t in texts_of_ids.to_pylist()]
                decoded += raw.to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def encode_digest(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode_decode``, but each document's ids and decoded bytes as SHA-256: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    made = _shared(docs, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256
        for batch in batches:
            count, ids, decoded = [], [], []
            for texts_of_ids, raw, n in _documents(made.value, batch.column(1)):
                count += n.tolist()
                ids += [sha(t).hexdigest() for t in texts_of_ids.to_pylist()]
                decoded += [sha(d).hexdigest() for d in raw.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _shared(docs: DataFrame, path: str, pattern: str):
    """The codec as a broadcast: its size is the vocabulary's, whatever the data."""
    prepare(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast(codec(path, pattern))
