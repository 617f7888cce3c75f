"""Lines that many documents share, found through two Bloom filters.

Every task marks in two filters which cells its lines meet once and which twice
or more; the tasks' filters are merged cell by cell, a cell met once here and
once there counting as met twice. A line whose two cells are not both in the
twice-seen filter stands in one document only and goes no further. Only the
others, the suspected repeats, are shuffled, by a 128-bit digest, for the exact
count of their documents and the choice of the first. The lines to drop are sent
to the tasks that read the documents again, so no text is shuffled, as long as
they are few; otherwise each row is joined with its own.

A filter holds at most ``RANGE_KEYS`` lines, so what is broadcast is bounded:
more lines are dealt into ranges of their digests, each with filters of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.llm.common import BLANKS, attach, prepare, slices, texts
from meterloom.session import cut, shared_path

#: Repeated keys that are sent to the tasks (a few MB); more are joined to the rows that hold them.
SENT_KEYS = 1 << 17
#: Lines in one pair of filters; the twice-seen one has 2 x CELLS_PER_KEY bits a line (32 MB in all).
RANGE_KEYS = 1 << 24
CELLS_PER_KEY = 8
#: Bits of a filter's segment, the unit in which filters are merged.
SEGMENT = 1 << 20
#: Keys a task holds before it hands on its filters.
TASK_KEYS = 1 << 21

DIGEST = 16
_BLANKS = BLANKS.encode()


def _key(line: bytes, least: int) -> bytes:
    """Digest of the line without outer white space and case; empty for a line that is never dropped."""
    key = line.strip(_BLANKS).lower()
    if not key or (least > 1 and len(key.decode()) < least):
        return b""
    return xxhash.xxh3_128_digest(key)


def line_keys(docs: DataFrame, least: int = 1) -> DataFrame:
    """``doc_id, row, keys``: per row the digests of its different lines, one after the other.

    ``docs`` has ``doc_id`` and ``text``. ``row`` identifies a row by its id and
    whole text, so rows that repeat entirely share it, as they share their result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            for lo, hi in slices(column):
                keys = []
                for text in column.slice(lo, hi - lo).cast(pa.binary()).to_pylist():
                    own = {_key(line, least) for line in text.split(b"\n")}
                    own.discard(b"")
                    keys.append(b"".join(sorted(own)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(keys, pa.binary())], ["doc_id", "row", "keys"])

    return _with_row(docs).mapInArrow(run, "doc_id long, row struct<a:long,b:long>, keys binary")


def _with_row(docs: DataFrame) -> DataFrame:
    row = F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit(1), "doc_id", "text").alias("b"))
    return docs.select("doc_id", row.alias("row"), "text")


def _halves(keys: pa.Array | bytes) -> np.ndarray:
    """Two 64-bit numbers per digest."""
    return np.frombuffer(keys, dtype="<u8").reshape(-1, 2)


def _cells(halves: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """A cell in each half of the filter, numbered through."""
    mask = np.uint64(cells - 1)
    return (halves[:, 0] & mask).astype(np.int64), (halves[:, 1] & mask).astype(np.int64) + cells


def _range_of(halves: np.ndarray, ranges: int) -> np.ndarray:
    return ((halves[:, 0] >> np.uint64(36)) % np.uint64(ranges)).astype(np.int32)


def _coded(at: np.ndarray) -> bytes:
    """Cells of a segment: 32-bit numbers while those are shorter than the bits."""
    if len(at) * 32 < SEGMENT:
        return at.astype("<u4").tobytes()
    bits = np.zeros(SEGMENT, dtype=bool)
    bits[at] = True
    return np.packbits(bits).tobytes()


def _bits(coded: bytes) -> np.ndarray:
    if len(coded) * 8 == SEGMENT:
        return np.unpackbits(np.frombuffer(coded, dtype=np.uint8)).astype(bool)
    bits = np.zeros(SEGMENT, dtype=bool)
    bits[np.frombuffer(coded, dtype="<u4")] = True
    return bits


def _segments(halves: np.ndarray, cells: int) -> Iterator[tuple[int, bytes, bytes]]:
    """``segment, once, twice`` of some keys."""
    at, count = np.unique(np.concatenate(_cells(halves, cells)), return_counts=True)
    owner = at // SEGMENT
    edges = np.flatnonzero(np.diff(owner, prepend=-1, append=-1))
    for lo, hi in zip(edges, edges[1:]):
        inside = at[lo:hi] - owner[lo] * SEGMENT
        yield int(owner[lo]), _coded(inside), _coded(inside[count[lo:hi] > 1])


def twice_filter(keys: DataFrame, cells: int) -> DataFrame:
    """``segment, bits``: the cells that more than one of all ``keys`` meets, compressed."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            rows = list(_segments(_halves(b"".join(held)), cells))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["segment", "once", "twice"])

        for batch in batches:
            for blob in batch.column(0).to_pylist():
                held.append(blob)
                size += len(blob)
                if size >= TASK_KEYS * DIGEST:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, once, twice = None, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([zlib.compress(np.packbits(twice).tobytes(), 1)], pa.binary())], ["segment", "bits"])

        for batch in batches:
            for segment, one, two in zip(*(c.to_pylist() for c in batch.columns)):
                if segment != current:
                    if current is not None:
                        yield done()
                    current, once, twice = segment, np.zeros(SEGMENT, dtype=bool), np.zeros(SEGMENT, dtype=bool)
                new = _bits(one)
                twice |= (once & new) | _bits(two)
                once |= new
        if current is not None:
            yield done()

    parts = keys.select("keys").mapInArrow(build, "segment int, once binary, twice binary")
    return parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, bits binary")


def _suspects(keys: DataFrame, cells: int) -> DataFrame:
    """``doc_id, row, key`` of the keys both of whose cells are in the twice-seen filter."""
    whole = np.zeros(2 * cells // 8, dtype=np.uint8)
    for r in twice_filter(keys, cells).toLocalIterator():  # at most 2 x cells bits, segment by segment
        start = r["segment"] * SEGMENT // 8
        part = np.frombuffer(zlib.decompress(r["bits"]), dtype=np.uint8)[: len(whole) - start]
        whole[start : start + len(part)] = part
    shared = keys.sparkSession.sparkContext.broadcast(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value
        for batch in batches:
            blobs = batch.column("keys").to_pylist()
            every = b"".join(blobs)
            hit = np.ones(len(every) // DIGEST, dtype=bool)
            for at in _cells(_halves(every), cells):
                hit &= (seen[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            owner = np.repeat(np.arange(len(blobs)), [len(b) // DIGEST for b in blobs])[hit]
            found = np.frombuffer(every, dtype=f"S{DIGEST}")  # fixed width; trailing zero bytes are put back below
            kept = [bytes(k).ljust(DIGEST, b"\0") for k in found[hit].tolist()]
            rows = batch.select(["doc_id", "row"]).take(pa.array(owner))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(kept, pa.binary())], ["doc_id", "row", "key"])

    told = cut(keys.select("doc_id", "row", "keys").mapInArrow(run, "doc_id long, row struct<a:long,b:long>, key binary"))
    shared.destroy()
    return told


def suspected_repeats(keys: DataFrame, range_keys: int = RANGE_KEYS) -> DataFrame:
    """``doc_id, row, key`` of all lines that more than one row may hold, from a written table of ``line_keys``."""
    total = keys.agg(F.sum(F.octet_length("keys")).alias("n")).first()["n"] or 0
    total //= DIGEST
    ranges = max(1, -(-total // range_keys))
    cells = max(SEGMENT, 1 << (CELLS_PER_KEY * max(1, total // ranges) - 1).bit_length())
    if ranges == 1:
        return _suspects(keys, cells)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for place, blob in enumerate(batch.column("keys").to_pylist()):
                halves = _halves(blob)
                into = _range_of(halves, ranges)
                out += [(place, int(r), halves[into == r].tobytes()) for r in np.unique(into)]
            place, own, blobs = zip(*out) if out else ((), (), ())
            rows = batch.select(["doc_id", "row"]).take(pa.array(place, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(blobs, pa.binary()), pa.array(own, pa.int32())], ["doc_id", "row", "keys", "range"])

    dealt = keys.mapInArrow(deal, "doc_id long, row struct<a:long,b:long>, keys binary, range int")
    path = shared_path(keys.sparkSession, "lines")
    dealt.write.partitionBy("range").parquet(path)
    told = keys.sparkSession.read.schema(dealt.schema).parquet(path)
    found = [_suspects(told.where(F.col("range") == r), cells) for r in range(ranges)]
    every = found[0]
    for one in found[1:]:
        every = every.unionByName(one)
    return every


def line_dedup(
    docs: DataFrame, min_docs: int = 10, least: int = 1, keep: str = "none", id_col: str = "doc_id", text_col: str = "text",
    range_keys: int = RANGE_KEYS, sent_keys: int = SENT_KEYS,
) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped``: each document without the lines that at least ``min_docs`` documents hold.

    Lines end at ``\\n`` and are compared without outer white space and the case
    of A-Z; a key of fewer than ``least`` code points is never dropped. With
    ``keep="first"`` the first occurrence of each such line stays: in the row
    with the smallest id (nulls last, then a hash of the row), its first place.

    A null or empty text is one empty line. Every row counts as a document, also
    where rows repeat; rows alike in id and text have the same result, so with
    ``keep="first"`` each of them keeps the line. An empty table gives no rows.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep is none or first")
    spark = docs.sparkSession
    prepare(spark)
    rows = texts(docs, id_col, text_col)
    suspects = suspected_repeats(cut(line_keys(rows, least)), range_keys)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")
    groups = cut(suspects.groupBy("key").agg(F.count(F.lit(1)).alias("n"), first).where(F.col("n") >= min_docs))
    if groups.count() <= sent_keys:
        return _dropped(_with_row(rows), least, spark.sparkContext.broadcast({bytes(r["key"]): (r["first"]["row"] if keep == "first" else None) for r in groups.collect()}))
    hit = attach(suspects, groups, "key", "n")
    spared = F.col("row").eqNullSafe(F.col("first.row")) & F.lit(keep == "first")
    # a document's own lines: as bounded as its text
    lost = cut(hit.groupBy("row").agg(F.collect_set(F.when(~spared, F.col("key"))).alias("lost"), F.collect_set(F.when(spared, F.col("key"))).alias("spared")))
    return _dropped(_with_row(rows).join(lost, "row", "left").select("doc_id", "row", "text", "lost", "spared"), least, None)


def _dropped(rows: DataFrame, least: int, shared) -> DataFrame:
    """The result for ``rows`` with their own lost and spared keys, or with all of them in ``shared``: key to the row that keeps its first, if any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = shared.value if shared is not None else None
        for batch in batches:
            for lo, hi in slices(batch.column(2)):
                part = batch.slice(lo, hi - lo)
                kept, before, dropped = [], [], []
                texts_of = part.column(2).cast(pa.binary()).to_pylist()
                own = zip(part.column(3).to_pylist(), part.column(4).to_pylist()) if every is None else zip(part.column(1).field(0).to_pylist(), part.column(1).field(1).to_pylist())
                for text, (one, two) in zip(texts_of, own):
                    lines = text.split(b"\n")
                    stay = _stay(lines, least, set(one or ()), set(two or ())) if every is None else _rest(lines, least, every, (one, two))
                    kept.append(b"\n".join(stay))
                    before.append(len(lines))
                    dropped.append(len(lines) - len(stay))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(before, pa.int64()), pa.array(dropped, pa.int64())],
                    ["doc_id", "text", "n_lines", "n_dropped"],
                )

    return rows.mapInArrow(run, "doc_id long, text string, n_lines long, n_dropped long")


def _rest(lines: list[bytes], least: int, every: dict, row: tuple[int, int]) -> list[bytes]:
    """The lines whose key is not in ``every``; of a key whose first is in this ``row``, the first."""
    gone = {k for k in (_key(line, least) for line in lines) if k in every}
    once = {k for k in gone if every[k] == row}
    return _stay(lines, least, gone - once, once) if gone else lines


def _stay(lines: list[bytes], least: int, gone: set[bytes], once: set[bytes]) -> list[bytes]:
    """The lines whose key is not in ``gone``; of a key in ``once`` the first."""
    if not gone and not once:
        return lines
    out, left = [], set(once)
    for line in lines:
        key = _key(line, least)
        if key in left:
            left.remove(key)
        elif key in gone or key in once:
            continue
        out.append(line)
    return out
