"""Exact deduplication by two passes over a Bloom filter, in DataFrame operations only.

A filter is a table of blocks of ``BLOCK_CELLS`` cells; a digest names a block, a
cell of its first half and one of its second. Pass one counts how many rows fall
on a cell, and keeps the cells met more than once. Pass two joins every row with
its block, the table being broadcast: a row whose two cells are not both kept has
no equal and passes straight through; only the others shuffle, by digest. A false
positive costs a shuffled row and changes no result, so one plan serves every
size: the filter follows the number of rows up to ``MOST_CELLS`` per half (16 MB
in all), beyond which it lets more rows through to the shuffle. No filter is ever
a literal of the plan, which would copy it into every task and onto the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.llm.common import BLANKS, attach, prepare, texts
from meterloom.session import cut

MOST_CELLS = 1 << 26
LEAST_CELLS = 1 << 12
CELLS_PER_ROW = 16
BLOCK_CELLS = 4096  # cells of one row of a filter


def digest(text: Column) -> Column:
    """SHA-256 (binary) of the text without white space."""
    for blank in BLANKS:  # byte searches, several times faster than one regular expression
        text = F.replace(text, F.lit(blank), F.lit(""))
    return F.unhex(F.sha2(text, 256))


def _cells(key: str, cells: int) -> Column:
    """Two cells of one block: ``block, low, high``, a cell of the block's first half and one of its second."""
    mixed = F.xxhash64(F.col(key))
    half = min(cells, BLOCK_CELLS // 2)
    within = lambda salt: F.pmod(F.xxhash64(mixed, F.lit(salt)), F.lit(half)).cast("int")
    return F.struct(F.pmod(mixed, F.lit(cells // half)).alias("block"), within(0).alias("low"), (within(1) + half).alias("high"))


def _packed(hits: DataFrame) -> DataFrame:
    """``block, bits``: the words of every block that has a cell set, packed to 64 bits each."""
    one = F.expr("shiftleft(1L, cell & 63)")
    words = hits.groupBy("block", F.shiftright("cell", 6).alias("word")).agg(F.bit_or(one).alias("bits"))
    blocks = words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))  # BLOCK_CELLS / 64 at most
    every = F.sequence(F.lit(0), F.lit(BLOCK_CELLS // 64 - 1))
    return cut(blocks.select("block", F.transform(every, lambda w: F.coalesce(F.try_element_at("words", w), F.lit(0).cast("long"))).alias("bits")))


def _hits(keys: DataFrame, key: str, cells: int) -> DataFrame:
    at = keys.select(_cells(key, cells).alias("at"))
    return at.select("at.block", F.explode(F.array("at.low", "at.high")).alias("cell"))


def repeated_filter(keys: DataFrame, key: str, cells: int) -> DataFrame:
    """Filter of the cells on which more than one row of ``keys`` falls."""
    return _packed(_hits(keys, key, cells).groupBy("block", "cell").count().where("count > 1"))


def member_filter(keys: DataFrame, key: str, cells: int) -> DataFrame:
    """Filter of the cells of all ``keys``."""
    return _packed(_hits(keys, key, cells))


def may_hold(rows: DataFrame, seen: DataFrame, key: str, cells: int, name: str) -> DataFrame:
    """``rows`` with ``name``: whether both cells of ``key`` are in the filter.

    The filter, whose size ``cells`` fixes, is broadcast as a table; a row meets
    the one block that holds both its cells.
    """
    blocks = F.broadcast(seen.select(F.col("block").alias("__block"), F.col("bits").alias("__bits")))
    at = rows.withColumn("__at", _cells(key, cells)).withColumn("__block", F.col("__at.block"))
    met = at.join(blocks, "__block", "left")
    bit = lambda c: F.getbit(F.get("__bits", F.shiftright(c, 6)), F.col(c).bitwiseAND(F.lit(63))) == 1
    told = F.coalesce(bit("__at.low") & bit("__at.high"), F.lit(False))
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], told.alias(name))


def filter_cells(rows: int, per_row: int = CELLS_PER_ROW) -> int:
    """Cells per half for so many rows: a power of two, within the bounds."""
    return min(MOST_CELLS, max(LEAST_CELLS, 1 << (per_row * max(rows, 1) - 1).bit_length()))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical without white space; a null or blank text
    equals the empty one. Of equal texts the one with the most code points, then
    the smallest id (nulls last) stays. Of repeated rows with the same id and
    length, one is marked as kept. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    rows = cut(texts(docs, id_col, text_col).select("doc_id", F.length("text").cast("long").alias("points"), digest(F.col("text")).alias("sha")))
    cells = filter_cells(rows.count())
    told = may_hold(rows, repeated_filter(rows, "sha", cells), "sha", cells, "again")
    alone = told.where("not again").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    # nulls last among equal lengths: they rank as larger than any id
    rank = F.struct("points", F.col("doc_id").isNotNull().alias("known"), (-F.col("doc_id")).alias("minus"))
    shuffled = cut(told.where("again").select("doc_id", "points", "sha"))
    groups = cut(shuffled.groupBy("sha").agg(F.max(rank).alias("best"), F.count(F.lit(1)).alias("group_size")))
    joined = attach(shuffled, groups, "sha", "group_size").withColumn("keep_id", -F.col("best.minus"))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("best.points"))
    # only the rows equal to the one that stays are numbered, one per group unless rows repeat
    first = F.row_number().over(Window.partitionBy("sha").orderBy("doc_id")) == 1
    columns = ["doc_id", "keep_id", "group_size", "kept", "sha"]
    kept = joined.where(stays).withColumn("kept", first).select(columns)
    dropped = joined.where(~stays).withColumn("kept", F.lit(False)).select(columns)
    return alone.unionByName(kept).unionByName(dropped).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, by the same rule as ``exact_groups``.

    Rows without an equal are never shuffled; of the rest, each task forwards
    its best row per digest, so a text that fills a third of the table moves at
    most once per task.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = cut(docs.select(digest(text).alias("__sha")))
    cells = filter_cells(keys.count())
    told = may_hold(docs.withColumn("__sha", digest(text)), repeated_filter(keys, "__sha", cells), "__sha", cells, "__again")
    best = Window.partitionBy("__sha").orderBy(F.length(text).desc(), F.col(id_col).asc_nulls_last(), text)
    kept = told.where("__again").withColumn("__rank", F.row_number().over(best)).where("__rank = 1")
    return told.where("not __again").select(docs.columns).unionByName(kept.select(docs.columns))
