"""Ranked lexical search for many items at once, sharing the sums that items have in common.

Items are mined for term sets they share: terms that stand in the same items
become one node, then the pair of nodes that most items hold together becomes a
node of its own, again and again. The result is a graph in which every item is a
sum of few nodes. Per block of documents each node's accumulator is computed
once and feeds all items above it.

A first pass reads the documents whole and writes, per document, its length and
its occurrences of item terms; statistics of the collection are counted from
that table, and the second pass scores it. Items are taken in blocks, so what is
broadcast is bounded by a block, and only the best documents of each task and
item are shuffled.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterloom.llm.common import prepare, slices, texts
from meterloom.session import cut

#: Items scored together, about.
ITEMS = 512
#: Documents whose accumulators are held at once.
DOCS = 256
#: Pairs of nodes looked at when mining one block; beyond it the rest of the graph stays as it is, results do not change.
PAIRS = 4_000_000

# A term is a maximal run of ASCII letters, digits and characters beyond ASCII.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Byte by byte: upper case A-Z lowered, everything that ends a term a blank.
_PLAIN = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)], dtype=np.uint8)


def terms_of(text: str | None) -> list[str]:
    """All terms of a text, repeats included."""
    return TERM.findall((text or "").translate(_LOWER))


@dataclass
class Sharing:
    """Terms numbered by node, and the sums above them.

    ``terms`` in the order of their numbers, ``first`` the node of each; nodes
    from ``atoms`` on are sums of two earlier ones, level by level in ``levels``
    as ``(node, left, right)``; ``members`` are the nodes that add up to an item.
    """

    terms: list[str]
    first: np.ndarray
    atoms: int
    nodes: int
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    members: list[list[int]]

    def additions(self) -> int:
        """Accumulators added per document, against one per term and item without sharing."""
        return sum(len(own) for own, _, _ in self.levels) + sum(map(len, self.members))


def share(items: list[set[str]], pairs: int = PAIRS) -> Sharing:
    """The graph of term sets that ``items`` share."""
    holders: dict[str, list[int]] = defaultdict(list)
    for i, own in enumerate(items):
        for term in own:
            holders[term].append(i)
    alike: dict[tuple[int, ...], list[str]] = defaultdict(list)
    for term, at in holders.items():
        alike[tuple(at)].append(term)
    sets = sorted(alike)
    terms, first = [], []
    for node, at in enumerate(sets):
        for term in sorted(alike[at]):
            terms.append(term)
            first.append(node)
    within: list[set[int]] = [set() for _ in items]
    users: list[int] = []  # the items of a node as bits
    for node, at in enumerate(sets):
        users.append(sum(1 << i for i in at))
        for i in at:
            within[i].add(node)
    depth, made = [0] * len(sets), []
    together: Counter = Counter()
    seen = 0
    for own in within:
        shared = sorted(n for n in own if users[n].bit_count() > 1)
        seen += len(shared) * (len(shared) - 1) // 2
        if seen > pairs:
            break
        together.update((a, b) for k, a in enumerate(shared) for b in shared[k + 1 :])
    heap = [(-n, a, b) for (a, b), n in together.items() if n > 1]
    heapq.heapify(heap)
    while heap:
        n, a, b = heapq.heappop(heap)
        both = users[a] & users[b]
        if both.bit_count() != -n:  # some of its items have meanwhile joined one of the two elsewhere
            if both.bit_count() > 1:
                heapq.heappush(heap, (-both.bit_count(), a, b))
            continue
        new = len(users)
        users.append(both)
        users[a] &= ~both
        users[b] &= ~both
        depth.append(max(depth[a], depth[b]) + 1)
        made.append((new, a, b))
        beside: Counter = Counter()
        for i in range(len(items)):
            if both >> i & 1:
                within[i] -= {a, b}
                beside.update(m for m in within[i] if users[m].bit_count() > 1)
                within[i].add(new)
        seen += len(beside)
        if seen <= pairs:
            for other, count in beside.items():
                if count > 1:
                    heapq.heappush(heap, (-count, other, new))
    levels = []
    for level in range(1, max(depth, default=0) + 1):
        own = [m for m in made if depth[m[0]] == level]
        levels.append(tuple(np.array(c, dtype=np.int64) for c in zip(*own)))
    return Sharing(terms, np.array(first, dtype=np.int64), len(sets), len(users), levels, [sorted(w) for w in within])


def postings(docs: DataFrame, terms: list[str]) -> DataFrame:
    """``doc_id, n, terms array<int>, counts array<int>``: documents with a term, their length in terms, the numbers of ``terms`` in them and how often."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)  # those of one block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.string())
        for batch in batches:
            column = batch.column(1)
            for lo, hi in slices(column):
                yield _counted(batch.column(0).slice(lo, hi - lo), column.slice(lo, hi - lo), known)

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>")


def _counted(ids: pa.Array, column: pa.Array, known: pa.Array) -> pa.RecordBatch:
    column = pa.concat_arrays([column])  # offsets from zero
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[: len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    plain = pa.StringArray.from_buffers(len(column), pa.py_buffer(offsets), pa.py_buffer(_PLAIN[data[offsets[0] : offsets[-1]]]))
    split = pc.ascii_split_whitespace(plain)
    owner = np.repeat(np.arange(len(column)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    coded = split.flatten().dictionary_encode()
    place = pc.index_in(coded.dictionary, known).fill_null(-1).to_numpy(zero_copy_only=False)
    some = pc.greater(pc.binary_length(coded.dictionary), 0).to_numpy(zero_copy_only=False)
    at = coded.indices.to_numpy(zero_copy_only=False)
    n = np.bincount(owner, weights=some[at], minlength=len(column)).astype(np.int64)
    term = place[at].astype(np.int64)
    hit = term >= 0
    pair, count = np.unique(owner[hit] * len(known) + term[hit], return_counts=True)
    owner, term = np.divmod(pair, max(len(known), 1))
    keep = n > 0
    ends = np.searchsorted(owner, np.arange(len(column) + 1)).astype(np.int32)
    made = [pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32))) for v in (term, count)]
    every = pa.RecordBatch.from_arrays([ids, pa.array(n), *made], ["doc_id", "n", "terms", "counts"])
    return every.filter(pa.array(keep))


def _frequencies(found: DataFrame, size: int) -> np.ndarray:
    """Documents per term number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size, dtype=np.int64)
        for batch in batches:
            own += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(own[at])], ["term", "df"])

    counts = found.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    out = np.zeros(size, dtype=np.int64)
    for term, df in counts.collect():  # the terms of one block of items
        out[term] = df
    return out


def _best(found: DataFrame, plan: Sharing, weights: np.ndarray, total: int, length: int, k: int) -> DataFrame:
    """``item, doc_id, score``: each task's ``k`` best documents of every item."""
    shared = found.sparkSession.sparkContext.broadcast((plan, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, weights = shared.value
        members = np.array([m for own in plan.members for m in own], dtype=np.int64)
        holding = np.array([i for i, own in enumerate(plan.members) if own], dtype=np.int64)
        starts = np.cumsum([0, *(len(own) for own in plan.members if own)])[:-1]
        best = [np.zeros(0, dtype=np.int64) for _ in range(4)]  # item, whether the id is null, id, score
        least = np.ones(len(plan.members), dtype=np.int64)
        for batch in batches:
            for lo in range(0, len(batch), DOCS):
                part = batch.slice(lo, DOCS)
                known = part.column("doc_id")
                empty, ids = known.is_null().to_numpy(zero_copy_only=False), known.fill_null(0).to_numpy(zero_copy_only=False)
                sums = _accumulate(part, plan, weights, total, length)[members]
                scores = np.add.reduceat(sums, starts, axis=0) if len(starts) else sums
                item, doc = np.nonzero(scores >= least[holding][:, None])
                new = (holding[item], empty[doc].astype(np.int64), ids[doc], scores[item, doc])
                best = [np.concatenate(pair) for pair in zip(best, new)]
                order = np.lexsort((best[2], best[1], -best[3], best[0]))
                owner = best[0][order]
                best = [b[order[np.arange(len(order)) - np.searchsorted(owner, owner) < k]] for b in best]
                count = np.bincount(best[0], minlength=len(least))
                full = np.flatnonzero(count == k)
                least[full] = best[3][np.cumsum(count)[full] - 1]
        item, empty, ids, score = best
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(ids, mask=empty.astype(bool)), pa.array(score)], ["item", "doc_id", "score"])

    return found.mapInArrow(run, "item int, doc_id long, score long")


def _accumulate(part: pa.RecordBatch, plan: Sharing, weights: np.ndarray, total: int, length: int) -> np.ndarray:
    """Accumulators of all nodes (rows) for a batch of documents (columns)."""
    n = part.column("n").to_numpy(zero_copy_only=False)
    most = 100 - 90 + 90 * n * total // length
    terms = part.column("terms")
    owner = np.repeat(np.arange(len(part)), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
    term = terms.flatten().to_numpy(zero_copy_only=False)
    times = part.column("counts").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    value = weights[term] * (1_000_000_000 * times // (1000 * times + 8 * most[owner]))
    out = np.zeros((plan.nodes, len(part)), dtype=np.int64)
    node = plan.first[term]
    edges = np.flatnonzero(np.diff(owner * plan.atoms + node, prepend=-1))  # terms stand in the order of their nodes
    if len(edges):
        out[node[edges], owner[edges]] = np.add.reduceat(value, edges)
    for own, left, right in plan.levels:
        out[own] = out[left] + out[right]
    return out


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: int = ITEMS
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents with the highest score above 0 for every item.

    Terms are maximal runs of letters, digits and characters beyond ASCII, A-Z
    lower-cased; a term's weight is ``floor(1000 ln((2N+2)/(2df+1)))`` and its
    part of the score ``weight * (10^9 tf div (1000 tf + 8 m))`` with
    ``m = 10 + 90 n N div L``, all in 64-bit integers. Equal scores go by
    ascending id, null ids last. A null text has no terms; a document without
    terms does not count in N and an item without terms has no rows. Repeated
    documents and repeated items are each taken for themselves. Empty tables give
    no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = texts(docs, id_col, text_col)
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    blocks = max(1, -(-asked.count() // block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    out = None
    for number in range(blocks):
        own = [(r["item_id"], r["text"]) for r in asked.where(F.col("block") == number).collect()]  # about ``block`` items
        plan = share([set(terms_of(text)) for _, text in own])
        if not plan.terms:
            continue
        found = cut(postings(rows, plan.terms))
        totals = found.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
        total, length = totals["docs"], totals["terms"] or 0
        weights = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1))) for df in _frequencies(found, len(plan.terms)).tolist()], dtype=np.int64)
        names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(own)], "item int, item_id long")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        ranked = _best(found, plan, weights, total, length, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        top = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = top if out is None else out.unionByName(top)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
