"""SimHash near-duplicates: fingerprints, bit-sliced comparison within blocks, connected components.

Every document becomes a 64-bit fingerprint where it is read; from there on only
distinct fingerprints move. Two of them within ``radius`` bits agree on at least
one of ``radius + 1`` blocks of bits, so only fingerprints that share a block
value are compared. A block value shared by more than ``BUCKET`` fingerprints is
keyed once more by a block of the remaining bits; where even that leaves more, a
fingerprint meets all others within the radius at the values half-way between
them, which takes a fixed number of rows per fingerprint and no comparison. All
links are found whatever the sizes, and no step forms the pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterloom.llm.common import attach, prepare, slices
from meterloom.session import cut

BITS = 64
SHINGLE = 3
RADIUS = 2
SEED = 42
#: Fingerprints of one block value compared with each other at most.
BUCKET = 256
NO_ID = (1 << 63) - 1
ONES = np.array([0xFFFFFFFFFFFFFFFF], dtype=np.uint64)


def shingle_hashes(text: str, size: int = SHINGLE) -> list[int]:
    """XXH64 of the text's word shingles, repeats included; the whole sequence where words are fewer."""
    words = text.encode().lower().split()  # bytes: ASCII case and ASCII white space only
    if not words:
        return []
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()
    digest = xxhash.xxh64_intdigest
    if len(words) < size:
        return [digest(line, SEED)]
    return [digest(line[a:b], SEED) for a, b in zip(starts, stops[size - 1 :])]


def fingerprints(hashes: list[list[int]]) -> np.ndarray:
    """Majority of each bit over each document's hashes, as unsigned 64-bit numbers; no hashes give zero.

    Bits are counted in byte lanes: eight strided masks per number, summed over
    runs of at most 255 numbers and then over documents.
    """
    out = np.zeros(len(hashes), dtype=np.uint64)
    sizes = np.array([len(h) for h in hashes], dtype=np.int64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    numbers = np.array([x for h in hashes for x in h], dtype=np.uint64)
    sizes = sizes[full]
    ends = np.cumsum(sizes)
    runs = -(-sizes // 255)
    run_ends = np.cumsum(runs)
    run_of = np.repeat(np.arange(len(full)), runs)
    within = np.arange(run_ends[-1]) - (run_ends - runs)[run_of]
    run_starts = (ends - sizes)[run_of] + 255 * within
    lane = np.array([0x0101010101010101], dtype=np.uint64)
    for bit in range(8):
        sums = np.add.reduceat((numbers >> np.uint64(bit)) & lane, run_starts)
        counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), run_ends - runs, axis=0)
        majority = (2 * counts > sizes[:, None]).astype(np.uint64)
        for byte in range(8):
            out[full] |= majority[:, byte] << np.uint64(8 * byte + bit)
    return out


def with_fingerprint(docs: DataFrame, text_col: str, name: str, size: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the fingerprint of ``text_col`` as the signed long ``name``."""
    prepare(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias(f"{name}_text"), *keep)
    schema = T.StructType([T.StructField(name, T.LongType()), *(docs.schema[c] for c in keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            parts = [fingerprints([shingle_hashes(t, size) for t in column.slice(a, b - a).to_pylist()]) for a, b in slices(column)]
            marks = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(marks.view(np.int64)), *batch.columns[1:]], [name, *batch.schema.names[1:]])

    return rows.mapInArrow(run, schema)


def near_in_buckets(keys: np.ndarray, marks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links, as positions, among rows of equal key whose marks differ in at most ``radius`` bits.

    ``keys`` is sorted. Marks are stored as bit planes, 64 rows to a word. For
    each distance d between positions, all rows are compared with the row d
    further at once: the differing bits of a plane are added to carry-save
    counters that start so that they overflow above the radius, and words whose
    rows have all overflowed are dropped from the remaining planes.
    """
    n = len(keys)
    words = n // 64 + 2
    padded = np.zeros(64 * words, dtype=np.uint64)
    padded[:n] = marks
    planes = [np.packbits(((padded >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.uint64) for b in range(BITS)]
    planes = [np.concatenate([p, np.zeros(n // 64 + 3, np.uint64)]) for p in planes]
    width = radius.bit_length() if radius else 1
    begin = (1 << width) - (radius + 1)
    label = np.arange(n)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    d = 1
    while d < n:
        same = np.zeros(64 * words, dtype=np.uint8)
        same[: n - d] = keys[d:] == keys[:-d]
        alive = np.packbits(same, bitorder="little").view(np.uint64)
        at = np.flatnonzero(alive)
        if not len(at):
            break  # no bucket is longer
        alive = alive[at]
        skip, shift = d // 64, np.uint64(d % 64)
        counters = [np.full(len(at), ONES[0] if begin >> k & 1 else 0, dtype=np.uint64) for k in range(width)]
        for b, plane in enumerate(planes):
            other = plane[at + skip]
            if shift:
                other = (other >> shift) | (plane[at + skip + 1] << (np.uint64(64) - shift))
            carry = plane[at] ^ other
            for k in range(width):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            alive &= ~carry
            if b % 4 == 3:
                left = np.flatnonzero(alive)
                if len(left) < len(at):
                    at, alive, counters = at[left], alive[left], [c[left] for c in counters]
                    if not len(at):
                        break
        if len(at):
            lanes = np.flatnonzero(np.unpackbits(alive.view(np.uint8), bitorder="little"))
            first = at[lanes // 64] * 64 + lanes % 64
            pairs.append((first, first + d))
        d += 1
    if pairs:
        one, two = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
        while True:
            low = np.minimum(label[one], label[two])
            old = label.copy()
            np.minimum.at(label, one, low)
            np.minimum.at(label, two, low)
            label = label[label]
            if (label == old).all():
                break
    linked = np.flatnonzero(label != np.arange(n))
    return label[linked], linked


def _blocks(bits: list[int], count: int) -> list[list[int]]:
    """``bits`` in ``count`` consecutive parts of nearly equal length."""
    edges = [round(i * len(bits) / count) for i in range(count + 1)]
    return [bits[a:b] for a, b in zip(edges, edges[1:])]


def _value(bits: list[int]) -> Column:
    """The bits of ``mark`` at these positions, others zero."""
    mask = sum(1 << b for b in bits)
    return F.col("mark").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def _filled(rows: DataFrame) -> DataFrame:
    """Rows whose key others share, with the key's number of rows."""
    counts = rows.groupBy("table", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(counts, ["table", "value"])


def _compared(rows: DataFrame, radius: int) -> DataFrame:
    """Links within each key of at most ``BUCKET`` rows."""
    dealt = rows.select(F.xxhash64("table", "value").alias("key"), "mark").repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_key, rest_mark = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def links(keys, marks):
            a, b = near_in_buckets(keys, marks.view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(marks[a]), pa.array(marks[b])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate([rest_key, batch.column(0).to_numpy()])
            marks = np.concatenate([rest_mark, batch.column(1).to_numpy()])
            last = np.searchsorted(keys, keys[-1])  # the last key may go on in the next batch
            yield links(keys[:last], marks[:last])
            rest_key, rest_mark = keys[last:], marks[last:]
        yield links(rest_key, rest_mark)

    return dealt.mapInArrow(run, "a long, b long")


def near_links(marks: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``a, b`` that connect the same distinct ``mark`` values as all pairs within ``radius`` bits do."""
    first = _blocks(list(range(BITS)), radius + 1)
    keyed = marks.select("mark", F.explode(F.array(*(F.struct(F.lit(i).alias("table"), _value(b).alias("value")) for i, b in enumerate(first)))).alias("k")).select("mark", "k.table", "k.value")
    found = cut(_filled(keyed))
    small, large = found.where(F.col("n") <= BUCKET), found.where(F.col("n") > BUCKET)

    deeper, flips = [], []
    for i, block in enumerate(first):
        rest = [b for b in range(BITS) if b not in set(block)]
        for j, sub in enumerate(_blocks(rest, radius + 1)):
            table = len(first) + i * (radius + 1) + j
            deeper.append(F.when(F.col("table") == i, F.struct(F.lit(table).alias("table"), _value([*block, *sub]).alias("value"))))
            flips.append((table, [b for b in rest if b not in set(sub)]))
    again = large.select("mark", F.explode(F.filter(F.array(*deeper), lambda s: s.isNotNull())).alias("k")).select("mark", "k.table", "k.value")
    found = cut(_filled(again))
    small = small.unionByName(found.where(F.col("n") <= BUCKET))
    return _compared(small, radius).unionByName(_half_way(found.where(F.col("n") > BUCKET), flips, radius)).distinct()


def _half_way(rows: DataFrame, flips: list[tuple[int, list[int]]], radius: int) -> DataFrame:
    """Links within crowded keys: marks meet at every value within half the radius of both.

    Marks that meet at a value lie within the radius of each other. For an odd
    radius one side comes one bit closer, so values are reached at both distances.
    """
    if radius > 3:
        raise ValueError("crowded keys are split for a radius of 3 at most")
    near, far = radius // 2, radius - radius // 2

    def masks(bits: list[int], most: int) -> list[int]:
        found = [0] + ([1 << b for b in bits] if most else [])
        if most == 2:
            found += [1 << a | 1 << b for i, a in enumerate(bits) for b in bits[:i]]
        return found

    def values(most: int) -> DataFrame:
        by_table = F.lit(None).cast("array<long>")
        for table, bits in flips:
            own = [m - (1 << 64) if m >> 63 else m for m in masks(bits, most)]
            by_table = F.when(F.col("table") == table, F.array(*map(F.lit, own))).otherwise(by_table)
        return rows.select("mark", F.explode(by_table).alias("mask")).select("mark", F.col("mark").bitwiseXOR(F.col("mask")).alias("at")).distinct()

    close = values(near)
    # at most 65 distinct marks lie within one bit of a value
    hub = close.groupBy("at").agg(F.min("mark").alias("a"), F.collect_set("mark").alias("all"))
    links = hub.select("a", F.explode("all").alias("b")).where("a != b")
    if far > near:
        links = links.unionByName(values(far).join(hub.select("at", "a"), "at").select("a", F.col("mark").alias("b")).where("a != b"))
    return links


def components(links: DataFrame) -> DataFrame:
    """``node, root``: every node of a link with the smallest node connected to it.

    Alternates two steps until nothing changes: each node hands its larger
    neighbours to its smallest neighbour, then its smaller ones. Smallest
    neighbours are aggregated before they are joined back, duplicates vanish
    each round, and rounds grow with the logarithm of the diameter.
    """
    def told(df):
        r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        return r["n"], r["h"]

    edges = cut(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    state = told(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()
        lowest = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(lowest, "b").where("a != m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        edges = cut(small.unionByName(lowest.select(F.col("m").alias("a"), "b")).distinct())
        before, state = state, told(edges)
        if state == before:
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _groups(rows: DataFrame, radius: int) -> DataFrame:
    """``mark, n, root, first``: each distinct mark, its rows, its component and the smallest id in that."""
    marks = cut(rows.groupBy("mark").agg(F.min("id").alias("own"), F.count(F.lit(1)).alias("n")))
    roots = components(near_links(marks.select("mark"), radius))
    linked = cut(marks.join(roots, marks["mark"] == roots["node"]).select("mark", "n", "own", "root"))
    firsts = linked.groupBy("root").agg(F.min("own").alias("first"))
    found = linked.join(firsts, "root").select("mark", "n", "root", "first")
    alone = marks.join(linked.select("mark"), "mark", "left_anti").select("mark", "n", F.col("mark").alias("root"), F.col("own").alias("first"))
    return cut(found.unionByName(alone))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``.

    Null, empty and blank texts have the fingerprint zero and link like any
    other. A component's id is the smallest id in it; null ids count as larger
    than any, and a component of nulls alone has a null id. Repeated rows share
    a component. An empty table gives no rows.
    """
    narrow = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))
    rows = cut(with_fingerprint(narrow, "text", "mark", size, ["id"]))
    joined = attach(rows, _groups(rows, radius), "mark", "n")
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return joined.select(real("id").alias("doc_id"), F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), real("first").alias("component_id"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of ``docs`` per component, with all its columns: the one with the smallest id (nulls last), then text."""
    marked = cut(with_fingerprint(docs, text_col, "__mark", size))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    rows = marked.select(key.alias("id"), F.col("__mark").alias("mark"))
    best = attach(rows, _groups(rows, radius), "mark", "n").groupBy("root").agg(F.min(F.struct("id", "mark")).alias("best"))
    keep = best.select(F.col("best.id").alias("__id"), F.col("best.mark").alias("__mark"))
    found = marked.withColumn("__id", key).join(keep, ["__id", "__mark"])
    once = Window.partitionBy("__id", "__mark").orderBy(F.col(text_col).asc_nulls_first())
    return found.withColumn("__place", F.row_number().over(once)).where("__place = 1").select(docs.columns)
