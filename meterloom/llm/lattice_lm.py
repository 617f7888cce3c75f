"""Language-model scores from a subword lattice.

A word's probability mixes its discounted share of the training tokens with the
marginal probability of all its segmentations into pieces of an existing
vocabulary. The vocabulary's own scores give the pieces their first weights;
expectation-maximisation over the training words then re-estimates them, since
a piece model's ranks say little about how often a piece occurs here. Texts are
independent sequences of words and one end.

No text is shuffled. Each task numbers the distinct words of a few megabytes of
text (a *block*) and writes the block's dictionary and its documents as
compressed word numbers. Dictionaries are counted and scored by word, sent back
by block, and meet their documents there; every table involved grows in
proportion to the text, and one block bounds what a task holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.llm.common import prepare, slices
from meterloom.session import cut

#: Bytes of text whose words are numbered together.
BLOCK_BYTES = 8 << 20
SMOOTH = 0.1
#: Probability left to single bytes, for characters that no piece covers.
BYTE_MASS = 1e-3
EM_ROUNDS = 2
#: Weight of the vocabulary's own scores in the re-estimate, in pieces.
PRIOR = 1000.0
SPACE = "▁"
#: Words of one length that run through the recursion at once.
LANES = 4096
STEP = np.uint64(0x9E3779B97F4A7C15)


class Lattice:
    """Piece weights and the log-space recursions over all segmentations of a word."""

    def __init__(self, pieces: list[str], scores: list[float]):
        order = np.argsort(-np.asarray(scores), kind="stable")
        rank = np.empty(len(pieces))
        rank[order] = np.arange(len(pieces))
        weight = 1 / (rank + 10)  # scores that fall with the rank, as frequencies do
        self.prior = weight / weight.sum() if len(pieces) else weight
        self.longest = max(map(len, pieces), default=1)
        marks = np.array([_mark(p) for p in pieces], dtype=np.uint64)
        by = np.argsort(marks)
        self.marks, self.ids = marks[by], by
        self.set(self.prior)

    def set(self, share: np.ndarray) -> None:
        with np.errstate(divide="ignore"):
            self.log = np.append(np.log(share * (1 - BYTE_MASS)), -np.inf)  # the last for no piece

    def arcs(self, codes: np.ndarray) -> np.ndarray:
        """Piece number by (length - 1, start, word) for words of one length, codes as characters x words."""
        size, lanes = codes.shape
        out = np.full((min(self.longest, size), size, lanes), len(self.ids), dtype=np.int64)
        mark = np.zeros((size, lanes), dtype=np.uint64)
        for n in range(1, len(out) + 1):
            mark = (mark[: size - n + 1] ^ codes[n - 1 :]) * STEP
            mark ^= mark >> np.uint64(29)
            if len(self.marks):
                at = np.minimum(np.searchsorted(self.marks, mark), len(self.marks) - 1)
                out[n - 1, : size - n + 1] = np.where(self.marks[at] == mark, self.ids[at], len(self.ids))
        return out

    @staticmethod
    def bytes_log(codes: np.ndarray) -> np.ndarray:
        """Log weight of each character spelled in bytes."""
        width = 1 + (codes > 0x7F).astype(int) + (codes > 0x7FF) + (codes > 0xFFFF)
        return width * np.log(BYTE_MASS / 256)

    def forward(self, codes: np.ndarray, arcs: np.ndarray) -> np.ndarray:
        """Log probability of every prefix."""
        size, lanes = codes.shape
        single = self.bytes_log(codes)
        alpha = np.full((size + 1, lanes), -np.inf)
        alpha[0] = 0
        for j in range(1, size + 1):
            ends = [alpha[j - 1] + single[j - 1]]
            ends += [alpha[j - n] + self.log[arcs[n - 1, j - n]] for n in range(1, min(j, len(arcs)) + 1)]
            alpha[j] = _log_sum(ends)
        return alpha

    def expected(self, codes: np.ndarray, arcs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece, over words of one length."""
        size, lanes = codes.shape
        single = self.bytes_log(codes)
        alpha = self.forward(codes, arcs)
        beta = np.full((size + 1, lanes), -np.inf)
        beta[size] = 0
        out = np.zeros(len(self.ids) + 1)
        for i in range(size - 1, -1, -1):
            most = min(size - i, len(arcs))
            arms = [self.log[arcs[n - 1, i]] + beta[i + n] for n in range(1, most + 1)]
            beta[i] = _log_sum([single[i] + beta[i + 1], *arms])
            for n, arm in enumerate(arms, 1):
                out += np.bincount(arcs[n - 1, i], weight * np.exp(alpha[i] + arm - alpha[size]), len(out))
        return out[:-1]


def _mark(piece: str) -> np.uint64:
    mark = np.zeros(1, dtype=np.uint64)
    for c in piece:
        mark = (mark ^ np.uint64(ord(c))) * STEP
        mark ^= mark >> np.uint64(29)
    return mark[0]


def _log_sum(parts: list[np.ndarray]) -> np.ndarray:
    stacked = np.stack(parts)
    top = stacked.max(0)
    return top + np.log(np.exp(stacked - np.where(np.isfinite(top), top, 0)).sum(0))


def same_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of words of one length and their codes as characters x words, the boundary mark in front."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    order = np.argsort(sizes, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(sizes[order]) > 0, True]) if len(words) else []
    for lo, hi in zip(edges, edges[1:]):
        size = int(sizes[order[lo]])
        lanes = max(1, min(LANES, (1 << 18) // (size + 1)))
        for a in range(lo, hi, lanes):
            rows = order[a : min(a + lanes, hi)]
            flat = np.frombuffer("".join([SPACE + words[i] for i in rows]).encode("utf-32-le"), dtype=np.uint32)
            yield rows, np.ascontiguousarray(flat.reshape(len(rows), size + 1).T).astype(np.uint64)


def read_pieces(path: str) -> tuple[list[str], list[float]]:
    """Pieces of a vocabulary file and their scores, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids]


def word_log10(words: DataFrame, lattice: Lattice) -> DataFrame:
    """``words`` with the log10 marginal probability of each word's segmentations as ``lattice``."""
    shared = words.sparkSession.sparkContext.broadcast(lattice)  # the size of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("word").to_pylist()
            out = np.zeros(len(found))
            for rows, codes in same_length(found):
                out[rows] = shared.value.forward(codes, shared.value.arcs(codes))[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out / np.log(10))], [*batch.schema.names, "lattice"])

    return words.mapInArrow(run, f"{', '.join(f'{n} {t}' for n, t in words.dtypes)}, lattice double")


def reestimate(words: DataFrame, lattice: Lattice, rounds: int = EM_ROUNDS) -> Lattice:
    """Piece weights by expectation-maximisation, each distinct word of ``words`` counting once, as an unseen word would."""
    total = len(lattice.ids)
    for _ in range(rounds):
        shared = words.sparkSession.sparkContext.broadcast(lattice)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            uses = np.zeros(total)
            for batch in batches:
                for rows, codes in same_length(batch.column(0).to_pylist()):
                    uses += shared.value.expected(codes, shared.value.arcs(codes), np.ones(len(rows)))
            some = np.flatnonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(uses[some])], ["piece", "uses"])

        # one row per piece of the vocabulary reaches the driver
        rows = words.select("word").mapInArrow(run, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
        uses = PRIOR * lattice.prior
        for r in rows:
            uses[r["piece"]] += r["uses"]
        lattice.set(uses / uses.sum() if total else uses)
    return lattice


def numbered(docs: DataFrame, held: str) -> DataFrame:
    """Blocks: ``block, kind, doc_id, held, n_words, ids`` per document (kind 1), ``block, kind, number, word, uses`` per distinct word (kind 0).

    ``uses`` counts the word in rows that are not held out.
    """
    schema = "block long, kind int, number long, doc_id long, held boolean, n_words long, ids binary, word string, uses long"
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.string(), pa.int64()]

    def rows(**given) -> pa.RecordBatch:
        size = len(next(iter(given.values())))
        return pa.RecordBatch.from_arrays([given[n].cast(k) if n in given else pa.nulls(size, k) for n, k in zip(names, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            text, out = batch.column("text"), batch.column(held)
            for lo, hi in slices(text, BLOCK_BYTES):
                block += 1
                split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(text.slice(lo, hi - lo))))
                sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
                coded = split.flatten().dictionary_encode()
                ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.uint32)
                ends = np.cumsum(sizes)
                bare = pc.equal(pc.binary_length(coded.dictionary), 0).to_numpy(zero_copy_only=False)
                sizes[sizes == 1] -= bare[ids[ends[sizes == 1] - 1]]  # a blank text splits into one empty word
                learns = np.repeat(~out.slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(bool), np.diff(np.r_[0, ends]))
                uses = np.bincount(ids[learns], minlength=len(bare))
                number, size = np.flatnonzero(~bare), hi - lo
                whole = [pack(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), sizes.tolist())]
                yield rows(block=pa.array(np.full(size, block)), kind=pa.array(np.ones(size, np.int32)), doc_id=batch.column("doc_id").slice(lo, size), held=out.slice(lo, size), n_words=pa.array(sizes), ids=pa.array(whole, pa.binary()))
                yield rows(block=pa.array(np.full(len(number), block)), kind=pa.array(np.zeros(len(number), np.int32)), number=pa.array(number), word=coded.dictionary.take(pa.array(number)), uses=pa.array(uses[number]))

    return docs.mapInArrow(run, schema)


def _summed(parts: DataFrame, end_base: float, end_score: float, end_known: int) -> DataFrame:
    """Documents with the sums over their words: each block's dictionary comes first, then its documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        block, fresh, table = None, [], np.zeros((3, 0))
        for batch in batches:
            blocks, kinds = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("block", "kind"))
            edges = np.flatnonzero(np.r_[True, (np.diff(blocks) != 0) | (np.diff(kinds) != 0), True]) if len(blocks) else []
            for lo, hi in zip(edges, edges[1:]):
                part = batch.slice(lo, hi - lo)
                if blocks[lo] != block:
                    block, fresh, table = blocks[lo], [], np.zeros((3, 0))
                if kinds[lo] == 0:
                    fresh.append([part.column(n).to_numpy(zero_copy_only=False) for n in ("number", "base", "score", "known")])
                    continue
                if fresh:
                    number, *values = (np.concatenate(c) for c in zip(*fresh))
                    table, fresh = np.zeros((3, number.max() + 1)), []
                    table[:, number] = values
                sums = np.array([table[:, np.frombuffer(unpack(x), dtype=np.uint32)].sum(1) if n else np.zeros(3) for x, n in zip(part.column("ids").to_pylist(), part.column("n_words").to_pylist())])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held"), pc.add(part.column("n_words"), 1), pa.array(sums[:, 2].astype(np.int64) + end_known), pa.array(sums[:, 0] + end_base), pa.array(sums[:, 1] + end_score)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )

    return parts.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def lm_scores(docs: DataFrame, pieces_path: str, id_col: str = "doc_id", text_col: str = "text", held_col: str | None = None) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` (log10).

    The boolean column ``held_col`` marks rows that nothing is learned from
    (null or no column: learned from). A null or blank text is one end. Repeated
    rows count each. With nothing to learn from, words have their lattice
    probability alone. An empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    flag = F.coalesce(F.col(held_col), F.lit(False)) if held_col else F.lit(False)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), flag.alias("held"))
    parts = cut(numbered(narrow, "held"))
    entries = parts.where("kind = 0").select("block", "number", "word", "uses")
    words = cut(entries.groupBy("word").agg(F.sum("uses").alias("c")))
    seen = words.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).first()
    ends = parts.where("kind = 1 and not held").count()
    tokens, distinct = (seen["n"] or 0) + ends, seen["v"] + (ends > 0)
    discount = seen["once"] / (seen["once"] + 2 * seen["twice"]) if seen["once"] and seen["twice"] else 0.5
    back = discount * distinct / tokens if tokens else 1.0

    lattice = reestimate(words.where("c > 0"), Lattice(*read_pieces(pieces_path)))
    base = lambda c: F.log10((c + SMOOTH) / (tokens + SMOOTH * (distinct + 1)))
    own = F.greatest(F.col("c") - discount, F.lit(0.0)) / max(tokens, 1)
    # log10(own + back * 10^lattice), from the larger part so that long words do not vanish
    rest = F.col("lattice") + float(np.log10(back))
    mixed = F.when(own > 0, F.greatest(F.log10(own), rest) + F.log10(1 + F.pow(F.lit(10.0), -F.abs(F.log10(own) - rest)))).otherwise(rest)
    valued = word_log10(words, lattice).select("word", base(F.col("c")).alias("base"), mixed.alias("score"), (F.col("c") > 0).cast("double").alias("known"))

    scored = entries.select("block", "number", "word").join(valued, "word").select("block", F.lit(0).alias("kind"), "number", "base", "score", "known")
    empty = F.lit(None)
    scored = scored.select("*", empty.cast("long").alias("doc_id"), empty.cast("boolean").alias("held"), empty.cast("long").alias("n_words"), empty.cast("binary").alias("ids"))
    written = parts.where("kind = 1").select("block", "kind", "number", empty.cast("double").alias("base"), empty.cast("double").alias("score"), empty.cast("double").alias("known"), "doc_id", "held", "n_words", "ids")
    met = scored.unionByName(written).repartition("block").sortWithinPartitions("block", "kind")

    end_base = float(np.log10((ends + SMOOTH) / (tokens + SMOOTH * (distinct + 1))))
    end_score = float(np.log10((ends - discount) / tokens)) if ends else end_base
    out = _summed(met, end_base, end_score, int(ends > 0))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
