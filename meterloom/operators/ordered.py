"""Row-order operations that never put one oversized meter into one task.

A plain ``Window.partitionBy('id')`` gives a meter holding a third of all rows
to a single task. Rows are therefore dealt by range over the keys, all order
columns and a hash of the row, and written with the number of their range, the
*chunk*: a large meter covers many chunks, many small ones share one, and ties
or unknown times are split like anything else. Rows are windowed per (key,
chunk), one summary row per (key, chunk) is windowed per key, and the summary is
joined back on the partitioning the rows already have. There is one plan for
all sizes, and nothing is counted beforehand.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.functions.seeded import digest
from meterloom.session import cut

CHUNK, TIE = "_chunk", "_tie"


@dataclass(frozen=True)
class RowOrder:
    """Rows of each key, ordered by ``by``; rows that tie follow a hash of all their columns.

    ``bounded`` states that every key is small by construction (a resampled
    series, bounded by the calendar), so it need not be dealt out. ``dealt``
    states that the rows carry their chunk (see ``deal``).
    """

    keys: Sequence[str] = ("id",)
    by: Sequence[str] = ("date",)
    bounded: bool = False
    dealt: bool = False

    @property
    def place(self) -> list[str]:
        return [*self.keys, CHUNK] if self.dealt else list(self.keys)

    @property
    def within(self) -> list[str]:
        return [*self.by, TIE] if self.dealt else list(self.by)

    @property
    def local(self):
        return Window.partitionBy(*self.place).orderBy(*self.within)

    @property
    def backward(self):
        # reading backwards costs a sort; a frame up to the end would cost a pass per row
        return Window.partitionBy(*self.place).orderBy(*[F.col(c).desc() for c in self.within])

    @property
    def earlier(self):
        return Window.partitionBy(*self.keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)

    @property
    def later(self):
        return Window.partitionBy(*self.keys).orderBy(F.col(CHUNK).desc()).rowsBetween(Window.unboundedPreceding, -1)


def deal(df: DataFrame, order: RowOrder) -> tuple[DataFrame, RowOrder, bool]:
    """Rows with their chunk, the order on them, and whether this call dealt them out.

    Written, so that every later reading sees the same ranges.
    """
    if order.bounded or order.dealt:
        return df, order, False
    tied = df.withColumn(TIE, F.xxhash64(*df.columns))
    ranged = tied.repartitionByRange(*order.keys, *order.by, TIE).withColumn(CHUNK, F.spark_partition_id())
    return cut(ranged), RowOrder(order.keys, order.by, dealt=True), True


def undealt(df: DataFrame, own: bool) -> DataFrame:
    return df.drop(CHUNK, TIE) if own else df


def _back(rows: DataFrame, side: DataFrame, place: Sequence[str], also: Column | None = None, how: str = "inner") -> DataFrame:
    """Rows with the summary of their (key, chunk); an unknown key is a key like any other."""
    named = side.withColumnsRenamed({c: f"_at_{c}" for c in place})
    here = F.lit(True) if also is None else also
    for c in place:
        here = here & F.col(c).eqNullSafe(F.col(f"_at_{c}"))
    return rows.join(named, here, how).drop(*(f"_at_{c}" for c in place))


UPTO = (Window.unboundedPreceding, Window.currentRow)


def positions(df: DataFrame, order: RowOrder = RowOrder(), name: str = "pos", total: str | None = None) -> DataFrame:
    """Add the 1-based row position within the key and, if asked, the key's row count."""
    rows, order, own = deal(df, order)
    if not order.dealt:
        out = rows.withColumn(name, F.row_number().over(order.local).cast("long"))
        return out.withColumn(total, F.count(F.lit(1)).over(Window.partitionBy(*order.keys))) if total else out
    sizes = rows.groupBy(*order.place).agg(F.count(F.lit(1)).alias("_n"))
    cols = [F.coalesce(F.sum("_n").over(order.earlier), F.lit(0)).alias("_before")]
    if total:
        cols.append(F.sum("_n").over(Window.partitionBy(*order.keys)).alias(total))
    out = (
        _back(rows.withColumn("_rn", F.row_number().over(order.local)), sizes.select(*order.place, *cols), order.place)
        .withColumn(name, F.col("_before") + F.col("_rn"))
        .drop("_rn", "_before")
    )
    return undealt(out, own)


def running_sum(df: DataFrame, col: str, name: str, order: RowOrder = RowOrder()) -> DataFrame:
    """Add the sum of ``col`` over the key's rows up to and including this one."""
    rows, order, own = deal(df, order)
    part = F.coalesce(F.sum(col).over(order.local.rowsBetween(*UPTO)), F.lit(0))
    if not order.dealt:
        return rows.withColumn(name, part)
    sums = rows.groupBy(*order.place).agg(F.sum(col).alias("_s"))
    offsets = sums.select(*order.place, F.coalesce(F.sum("_s").over(order.earlier), F.lit(0)).alias("_before"))
    out = (
        _back(rows.withColumn("_part", part), offsets, order.place)
        .withColumn(name, F.col("_before") + F.col("_part"))
        .drop("_part", "_before")
    )
    return undealt(out, own)


def lagged(df: DataFrame, cols: dict[str, str], k: int = 1, order: RowOrder = RowOrder(), seen: str | None = None) -> DataFrame:
    """Add, for ``cols = {new: old}``, the value of ``old`` k rows earlier.

    ``seen`` names a boolean column telling whether such a row exists.
    """
    rows, order, own = deal(df, order)
    if not order.dealt:
        out = rows.withColumns({new: F.lag(old, k).over(order.local) for new, old in cols.items()})
        return out.withColumn(seen, F.row_number().over(order.local) > k) if seen else out
    rows = rows.withColumn("_rn", F.row_number().over(order.local)).withColumns({new: F.lag(old, k).over(order.local) for new, old in cols.items()})
    # the last k rows of each chunk, from the back; every earlier chunk of the key has a row, so k chunks suffice
    back = F.row_number().over(order.backward)
    ends = rows.select(*order.place, "_rn", back.alias("_back"), *dict.fromkeys(cols.values())).filter(F.col("_back") <= k)
    last = Window.partitionBy(*order.keys).orderBy(CHUNK).rowsBetween(-k, -1)
    tails = (
        ends.groupBy(*order.place)
        .agg(F.sort_array(F.collect_list(F.struct("_rn", *dict.fromkeys(cols.values())))).alias("_tail"))
        .select(*order.place, F.flatten(F.collect_list("_tail").over(last)).alias("_carry"))
        .withColumn("_carry", F.slice("_carry", F.greatest(F.size("_carry") - F.lit(k - 1), F.lit(1)), F.lit(k)))
    )
    # only a chunk's first k rows look into earlier chunks
    out = _back(rows, tails, order.place, F.col("_rn") <= k, "left")
    reach = F.try_element_at("_carry", (F.col("_rn") - F.lit(k + 1)).cast("int"))
    out = out.withColumns({new: F.when(F.col("_rn") > k, F.col(new)).otherwise(reach.getField(old)) for new, old in cols.items()})
    if seen:
        out = out.withColumn(seen, (F.col("_rn") > k) | reach.isNotNull())
    return undealt(out.drop("_rn", "_carry"), own)


def neighbours(df: DataFrame, col: str, order: RowOrder = RowOrder()) -> DataFrame:
    """Add ``pos`` and the nearest known values of ``col``.

    ``prev`` and ``next`` are ``struct(pos, value)`` of the last known row at or
    before this one and the first at or after it, null when there is none.
    """
    rows, order, own = deal(df, order)
    known = F.when(F.col(col).isNotNull(), F.struct(F.col("pos"), F.col(col).alias("value")))

    def near(rows: DataFrame) -> DataFrame:
        """``prev`` and ``next`` within the window partition of ``order.local``."""
        return rows.withColumn("_known", known).withColumn(
            "prev", F.last("_known", ignorenulls=True).over(order.local.rowsBetween(*UPTO))
        ).withColumn("next", F.last("_known", ignorenulls=True).over(order.backward.rowsBetween(*UPTO))).drop("_known")

    rows = rows.withColumn("pos", F.row_number().over(order.local).cast("long"))
    if not order.dealt:
        return near(rows)
    ends = rows.groupBy(*order.place).agg(
        F.count(F.lit(1)).alias("_n"), F.max(known).alias("_last"), F.min(known).alias("_first")
    ).withColumn("_before", F.coalesce(F.sum("_n").over(order.earlier), F.lit(0)))

    def moved(c: str) -> Column:
        entry = F.col(c)
        shifted = F.struct((entry["pos"] + F.col("_before")).alias("pos"), entry["value"].alias("value"))
        return F.when(entry.isNotNull(), shifted)

    carry = ends.withColumn("_last", moved("_last")).withColumn("_first", moved("_first")).select(
        *order.place, "_before",
        F.last("_last", ignorenulls=True).over(order.earlier).alias("_prev"),
        F.last("_first", ignorenulls=True).over(order.later).alias("_next"),
    )
    out = (
        _back(near(rows), carry, order.place)
        .withColumn("prev", F.coalesce(moved("prev"), F.col("_prev")))
        .withColumn("next", F.coalesce(moved("next"), F.col("_next")))
        .withColumn("pos", F.col("pos") + F.col("_before"))
        .drop("_before", "_prev", "_next")
    )
    return undealt(out, own)


SERIES = RowOrder(("id",), ("idx",), bounded=True)  # a resampled series


DIGEST_HEX = 4  # leading hex digits that form a bucket: 65,536 buckets per stratum


def _buckets(df: DataFrame, key: Sequence[str], seed, strata: Sequence[str], total: str):
    """Rows with digest and bucket, and per bucket the rows before it, its own rows and the stratum's rows.

    The bucket table has at most 65,536 rows per stratum whatever the input size.
    """
    marked = df.withColumn("_digest", digest(seed, *key)).withColumn("_bucket", F.substring("_digest", 1, DIGEST_HEX))
    sizes = marked.groupBy(*strata, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    every = Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(0))
    earlier = every.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *strata, "_bucket", "_n",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(every).alias(total),
    )
    return marked, offsets


def hash_rank(df: DataFrame, key: Sequence[str], seed, strata: Sequence[str] = (), name: str = "rank", total: str = "n") -> DataFrame:
    """Rank rows by a seeded digest of ``key`` (unique per stratum), without a global sort task.

    The digest's leading digits spread every stratum evenly over its buckets,
    so no task sees a whole stratum however large it is.
    """
    strata = list(strata)
    marked, offsets = _buckets(df, key, seed, strata, total)
    inside = Window.partitionBy(*strata, "_bucket").orderBy("_digest", *key)
    return (
        marked.withColumn("_rn", F.row_number().over(inside))
        .join(offsets.drop("_n"), [*strata, "_bucket"])
        .withColumn(name, F.col("_before") + F.col("_rn"))
        .drop("_digest", "_bucket", "_before", "_rn")
    )


def hash_head(df: DataFrame, key: Sequence[str], seed, wanted, strata: Sequence[str] = (), name: str = "head") -> DataFrame:
    """Flag the first ``wanted(n)`` rows of each stratum of n rows in the order of ``hash_rank``.

    Only the one bucket per stratum where the cut falls is ranked; every other
    row is compared with the cut, so the rows themselves are never shuffled.
    """
    strata = list(strata)
    slim = df.select(*strata, *[k for k in key if k not in strata])
    marked, offsets = _buckets(slim, key, seed, strata, "_total")
    goal = wanted(F.col("_total"))
    border = offsets.withColumn("_k", goal).filter((F.col("_before") < F.col("_k")) & (F.col("_k") <= F.col("_before") + F.col("_n")))
    border = cut(border.select(*strata, "_bucket", (F.col("_k") - F.col("_before")).alias("_r")))  # one row per stratum
    inside = Window.partitionBy(*strata, "_bucket").orderBy("_digest", *key)
    last = (
        marked.join(border, [*strata, "_bucket"])
        .withColumn("_rn", F.row_number().over(inside))
        .filter("_rn = _r")
        .select(*strata, F.struct("_digest", *key).alias("_cut"))
    )
    here = F.struct(digest(seed, *key).alias("_digest"), *key)
    if strata:
        # written first, so the join is planned from the table's true size
        out = df.join(cut(last), strata, "left")
    else:
        out = df.withColumn("_cut", last.select("_cut").scalar())
    return out.withColumn(name, F.coalesce(here <= F.col("_cut"), F.lit(False))).drop("_cut")

