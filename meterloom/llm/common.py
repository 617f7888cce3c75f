"""Shared pieces of the text operators.

Conventions of every operator in this package: a null text is an empty one; the
input is reduced to the columns the operator needs before anything else, so
extra columns and clashing names never reach it; an empty table gives an empty
result; rows that repeat are separate rows unless the operator says otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.session import ship

#: Ends of the white space that splits words, and the words' pattern (fixed by the contracts).
BLANKS = " \t\n\x0b\x0c\r"
BATCH_BYTES = 16 << 20
#: Groups above 1 / HOT_SHARE of all rows count as hot, so there are fewer than HOT_SHARE of them.
HOT_SHARE = 1000


def prepare(spark: SparkSession) -> None:
    """Package on the workers; Arrow batches bounded by bytes, so that long texts cannot swell one."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` alone, null texts as empty ones."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id gives null."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def slices(column: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a text column holding about ``most`` bytes each (a longer text stands alone)."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if lengths:
        yield start, len(lengths)


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` inner-joined with their row of ``groups`` on ``key``, however uneven the keys.

    ``groups`` has one row per key, its row count in ``size``. Keys holding more
    than a thousandth of the rows number fewer than a thousand, so that part is
    broadcast; each of the others is small enough for a shuffle partition.
    Both inputs are read twice: pass written tables.
    """
    floor = groups.agg(F.sum(size)).scalar() / HOT_SHARE
    hot = groups.where(F.col(size) > floor)
    few = rows.join(F.broadcast(hot), key)
    many = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.where(F.col(size) <= floor), key)
    return few.unionByName(many)
