"""Repeated passages across documents by content-defined chunks.

A gear hash rolls over the words of a text; a chunk ends where it is smallest
among ``REACH`` neighbouring words, so cuts depend on nearby words alone and
fall into step again right after an insertion. The unit that is deduplicated is
a run of chunks of at least ``LEAST`` words from each cut on, by its 128-bit
digest. A passage of more than 50 words always holds such a run whole: up to
``REACH + 2`` words in front and ``REACH`` behind may shift the cuts, the first
cut comes within ``REACH`` words and the run ends within ``LEAST + REACH - 1``.
Runs of one document that overlap and repeat the same other document are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterloom.llm.common import attach, prepare, slices
from meterloom.llm.exact_dedup import filter_cells, may_hold, member_filter
from meterloom.session import cut

REACH = 8
LEAST = 12
#: Joined runs of fewer words are not reported.
REPORTED = 17
#: Bytes of text hashed at once: every byte takes several 64-bit numbers on the way.
SLICE = 1 << 20
NO_ID = (1 << 63) - 1
U = np.uint64
# Odd multipliers of the word and run digests.
FIRST, SECOND = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of the texts (split at ASCII white space): text number, start and end in characters, 64-bit hash."""
    raw = np.frombuffer("\n".join(texts).encode(), dtype=np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.r_[True, blank, True].astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sizes = np.array([len(t.encode()) for t in texts], dtype=np.int64) + 1
    text_starts = np.cumsum(sizes) - sizes
    text = np.searchsorted(text_starts, starts, side="right") - 1
    points = np.cumsum(np.r_[0, (raw & 0xC0) != 0x80])  # characters before each byte
    before = points[text_starts[text]] if len(text) else text
    if not len(starts):
        return text, starts, ends, np.zeros(0, np.uint64)
    inside = np.flatnonzero(~blank)
    lengths = ends - starts
    place = np.arange(len(inside)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    odd = _mix(np.arange(1, 65, dtype=np.uint64)) | U(1)
    hashed = np.add.reduceat((raw[inside].astype(np.uint64) + U(1)) * odd[place & 63] + (place >> 6).astype(np.uint64), np.cumsum(lengths) - lengths)
    return text, points[starts] - before, points[ends] - before, _mix(hashed ^ lengths.astype(np.uint64))


def cuts_of(text: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Words after which a chunk ends: where the gear hash of the last three words is smallest among ``REACH`` in a row of one text."""
    n = len(hashes)
    if n < REACH:
        return np.zeros(0, np.int64)
    gear = hashes >> U(32)
    rolled = gear.copy()
    for back in (1, 2):
        rolled[back:] += np.where(text[back:] == text[:-back], gear[:-back] << U(back), U(0))
    low = (_mix(rolled) & U(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    width = 1
    while width < REACH:
        step = min(width, REACH - width)
        low = np.minimum(low[: len(low) - step], low[step:])
        width += step
    whole = text[: len(low)] == text[REACH - 1 :]
    return np.unique((low[whole] & U(0xFFFFFFFF)).astype(np.int64))


def runs_of(text: np.ndarray, hashes: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of chunks of at least ``LEAST`` words that start after each cut: first and last word (exclusive), two digests."""
    starts = cuts + 1
    at = np.searchsorted(starts, starts + LEAST)  # the first cut at least so far on
    fits = at < len(starts)
    starts, ends = starts[fits], starts[at[fits]]
    same = text[np.minimum(starts, len(text) - 1)] == text[ends - 1]
    starts, ends = starts[same], ends[same]
    digests = []
    for base, salt in ((FIRST, 0), (SECOND, 0x5851F42D4C957F2D)):
        own = _mix(hashes ^ U(salt))
        power, back = _powers(base, len(own) + 1), _powers(pow(base, -1, 1 << 64), len(own) + 1)
        sums = np.r_[U(0), np.cumsum(own * power[:-1], dtype=np.uint64)]
        digests.append(_mix((sums[ends] - sums[starts]) * back[starts] ^ (ends - starts).astype(np.uint64)))
    return starts, ends, *digests


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, word, words, start, stop, digest``: every run of chunks, positions in words and in characters."""
    prepare(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, hi in slices(batch.column(1), SLICE):
                text, first, last, hashes = words_of(batch.column(1).slice(lo, hi - lo).to_pylist())
                starts, ends, one, two = runs_of(text, hashes, cuts_of(text, hashes))
                if not len(starts):
                    continue
                origin = np.searchsorted(text, text[starts])  # first word of the text
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[lo:hi][text[starts]]), *(pa.array(x.astype(np.int32)) for x in (starts - origin, ends - starts, first[starts], last[ends - 1])), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))],
                    ["doc", "word", "words", "start", "stop", "one", "two"],
                )

    return rows.mapInArrow(run, "doc long, word int, words int, start int, stop int, one long, two long")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reported: int = REPORTED) -> DataFrame:
    """One row per passage that an earlier document has too: ``doc_id, start, stop, n_words, keep_doc_id, keep_word, copies``.

    ``start`` and ``stop`` are characters of ``doc_id``'s text, ``keep_word`` the
    word where the passage starts in the document that keeps it (the smallest id
    that has it; null ids count as one document larger than any), ``copies`` how
    often its most frequent part occurs. Repeats within one id are none. Texts
    of fewer than ``LEAST`` words, null and empty ones have no passages.
    """
    found = cut(runs(docs, id_col, text_col))
    digest = F.struct("one", "two").alias("digest")
    # only digest halves are counted over all runs; whatever repeats none of them is not shuffled any further
    twice = cut(found.groupBy("one").count().where("count > 1").select("one"))
    cells = filter_cells(twice.count(), 4)
    found = may_hold(found, member_filter(twice, "one", cells), "one", cells, "again").where("again").drop("again")
    groups = found.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "word")).alias("keep"), F.max("doc").alias("last")).where(F.col("n") > 1).where(F.col("keep.doc") != F.col("last"))
    groups = cut(groups.select(digest, "n", F.col("keep.doc").alias("keep_doc"), F.col("keep.word").alias("keep_word")))
    rows = found.select("doc", "word", "words", "start", "stop", digest)
    met = attach(rows, groups, "digest", "n").where(F.col("doc") != F.col("keep_doc"))
    # a group is one document's runs that one other document keeps: bounded by the document
    along = Window.partitionBy("doc", "keep_doc").orderBy("word", "words")
    reach = F.max(F.col("word") + F.col("words")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    opens = (reach.isNull() | (F.col("word") >= reach)).cast("int")
    joined = met.withColumn("opens", opens).withColumn("passage", F.sum("opens").over(along))
    passages = joined.groupBy("doc", "keep_doc", "passage").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), (F.max(F.col("word") + F.col("words")) - F.min("word")).alias("n_words"), F.min("keep_word").alias("keep_word"), F.max("n").alias("copies")
    ).where(F.col("n_words") >= reported)
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return passages.select(real("doc").alias("doc_id"), *(F.col(c).cast("long") for c in ("start", "stop", "n_words")), real("keep_doc").alias("keep_doc_id"), F.col("keep_word").cast("long"), "copies")
