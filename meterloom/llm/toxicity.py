"""Toxicity: a bidirectional gated recurrent network with attention over overlapping windows of words, in numpy.

A word's input is a hashed word vector plus the mean of its hashed character
n-gram vectors, so unseen forms of a known stem still count. Each window of
``WINDOW`` words runs through a GRU in both directions, attention pools the
states, and one logit comes out. A text scores as its highest window; every
word lies in a window and neighbouring windows overlap.

The fit takes labelled rows only, at most ``SAMPLE`` of each class in the order of a
hash of the id. Training starts from the short texts of the sample, where a
label says most about a window, then adds the windows of long clean texts that
score too high.
"""

from __future__ import annotations

import pickle
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterloom.llm.common import prepare

#: Most labelled rows that the model is fitted on: toxic ones, clean ones.
SAMPLE = (2000, 4000)
#: Training texts have at most so many words; longer ones of the sample serve to find errors.
SHORT = 320
WINDOW, STRIDE = 12, 8
BUCKETS, SIZE, STATE, HEADS = 1 << 16, 16, 8, 8
GRAMS = (3, 4, 5)
EPOCHS, BAGS = 6, 24
#: Short texts of each class seen in an epoch, drawn anew each time.
EPOCH_TEXTS = 1500
#: Buckets met in fewer training texts stay zero: a rare word says nothing about its text.
LEAST_TEXTS = 4
DECAY = np.float32(1e-4)
#: Windows run through the network at once.
BLOCK = 8192
SEED = 7


def _sigmoid(x):
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


@dataclass
class Words:
    """Distinct words as hashed features: one word bucket each, and n-gram buckets with the offsets of each word's run."""

    word: np.ndarray
    grams: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray


def features(words: list[str]) -> Words:
    """Hash whole words and their character n-grams, in blocks of words."""
    parts = [_features(words[lo : lo + BLOCK]) for lo in range(0, max(1, len(words)), BLOCK)]
    sizes = np.concatenate([p.sizes for p in parts])
    return Words(np.concatenate([p.word for p in parts]), np.concatenate([p.grams for p in parts]), np.cumsum(sizes) - sizes, sizes)


def _features(words: list[str]) -> Words:
    """Of one block: words and n-grams with boundary marks, over one array of code points."""
    marked = ["<" + (w.strip(string.punctuation) or w) + ">" for w in words]
    text = "".join(marked)
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(m) for m in marked], dtype=np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    step = np.uint64(0x9E3779B97F4A7C15)
    # whole words: a polynomial over the positions within the word
    place = (np.arange(len(codes)) - starts[owner]).astype(np.uint64)
    mixed = (codes + np.uint64(1)) * step ^ (place + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    whole = np.add.reduceat(mixed, starts) if len(words) else mixed[:0]
    hashes, owners = [], []
    for n in GRAMS:
        if len(codes) < n:
            continue
        value = np.full(len(codes) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            value = (value ^ codes[k : k + len(value)]) * step
            value ^= value >> np.uint64(31)
        inside = owner[: len(value)] == owner[n - 1 :]
        hashes.append((value[inside] >> np.uint64(7)) % np.uint64(BUCKETS))
        owners.append(owner[: len(value)][inside])
    own = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    order = np.argsort(own, kind="stable")
    grams = (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64))[order].astype(np.int32)
    counts = np.bincount(own, minlength=len(words))
    return Words(((whole >> np.uint64(9)) % np.uint64(BUCKETS)).astype(np.int64), grams, np.cumsum(counts) - counts, counts)


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per window over texts of so many words laid end to end: its text, first position and number of words."""
    counts = np.where(sizes > 0, np.maximum(1, -(-(sizes - WINDOW) // STRIDE) + 1), 0)
    text = np.repeat(np.arange(len(sizes)), counts)
    within = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = within * STRIDE
    return text, (np.cumsum(sizes) - sizes)[text] + first, np.minimum(WINDOW, sizes[text] - first)


class Network:
    """Parameters, forward pass and gradients."""

    def __init__(self, seed: int = SEED):
        draw = np.random.default_rng(seed)
        f = np.float32
        self.p = {"word": draw.normal(0, 0.05, (BUCKETS, SIZE)).astype(f), "gram": draw.normal(0, 0.05, (BUCKETS, SIZE)).astype(f)}
        for side in "fb":
            self.p["W" + side] = draw.normal(0, SIZE**-0.5, (SIZE, 3 * STATE)).astype(f)
            self.p["U" + side] = draw.normal(0, STATE**-0.5, (STATE, 3 * STATE)).astype(f)
            self.p["b" + side] = np.zeros(3 * STATE, f)
        self.p["A"] = draw.normal(0, STATE**-0.5, (2 * STATE, HEADS)).astype(f)
        self.p["a"] = np.zeros(HEADS, f)
        self.p["v"] = draw.normal(0, HEADS**-0.5, HEADS).astype(f)
        self.p["o"] = draw.normal(0, STATE**-0.5, 2 * STATE).astype(f)
        self.p["c"] = np.zeros(1, f)
        self.seen = {k: np.full_like(x, 1e-6) for k, x in self.p.items()}

    def restrict(self, words: Words, numbers: np.ndarray, text: np.ndarray) -> None:
        """Zero the buckets that fewer than ``LEAST_TEXTS`` texts meet, for good."""
        met = {"word": np.zeros(BUCKETS, np.int64), "gram": np.zeros(BUCKETS, np.int64)}
        edges = np.searchsorted(text, np.arange(0, text[-1] + 65, 64))
        for lo, hi in zip(edges, edges[1:]):  # 64 texts at a time, to bound the pairs held
            if lo == hi:
                continue
            pairs = np.unique((text[lo:hi] - text[lo]) << 32 | numbers[lo:hi])
            own, owner = pairs & ((1 << 32) - 1), pairs >> 32
            grams, _, sizes = _runs(words, own)
            for name, rows, texts in (("word", words.word[own], owner), ("gram", grams, np.repeat(owner, sizes))):
                met[name] += np.bincount(np.unique(texts * BUCKETS + rows) % BUCKETS, minlength=BUCKETS)
        self.fixed = {name: n < LEAST_TEXTS for name, n in met.items()}
        for name, rows in self.fixed.items():
            self.p[name][rows] = 0

    def inputs(self, words: Words) -> np.ndarray:
        """One vector per distinct word."""
        out = self.p["word"][words.word]
        has = np.flatnonzero(words.sizes)
        for lo in range(0, len(has), 1 << 15):  # in blocks, to bound what is gathered
            part = has[lo : lo + (1 << 15)]
            a, b = words.starts[part[0]], words.starts[part[-1]] + words.sizes[part[-1]]
            sums = np.add.reduceat(self.p["gram"][words.grams[a:b]], words.starts[part] - a, axis=0)
            out[part] += sums / np.sqrt(words.sizes[part], dtype=np.float32)[:, None]
        return out

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Input part of the gates for each distinct word, a last row for padding."""
        return {s: np.vstack([x @ self.p["W" + s] + self.p["b" + s], np.zeros((1, 3 * STATE), np.float32)]) for s in "fb"}

    def forward(self, gates, at: np.ndarray, real: np.ndarray, keep: bool = False):
        """Logit per window. ``at``: positions x windows of word numbers; ``real``: which are words."""
        p, h = self.p, STATE
        states = np.zeros((WINDOW, at.shape[1], 2 * h), np.float32)
        trace = {}
        for side, order in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
            s = np.zeros((at.shape[1], h), np.float32)
            base = 0 if side == "f" else h
            for t in order:
                g, u = gates[side][at[t]], s @ p["U" + side]
                zr = _sigmoid(g[:, : 2 * h] + u[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                n = np.tanh(g[:, 2 * h :] + r * u[:, 2 * h :])
                new = (n + z * (s - n)) * real[t][:, None]
                if keep:
                    trace[side, t] = (s, z, r, n, u[:, 2 * h :])
                s = new
                states[t, :, base : base + h] = s
        e = np.tanh(states @ p["A"] + p["a"])
        w = e @ p["v"]
        w = np.where(real > 0, w, np.float32(-1e9))
        w = np.exp(w - w.max(0))
        w /= w.sum(0)
        pooled = np.einsum("tb,tbd->bd", w, states)
        logit = pooled @ p["o"] + p["c"][0]
        return (logit, (states, trace, e, w, pooled)) if keep else logit

    def backward(self, gates, at, real, kept, d_logit):
        """Gradients of all but the hashed tables, and of the gates' input parts."""
        p, h = self.p, STATE
        states, trace, e, w, pooled = kept
        g = {"o": pooled.T @ d_logit, "c": np.array([d_logit.sum()], np.float32)}
        d_pool = d_logit[:, None] * p["o"]
        d_w = np.einsum("tbd,bd->tb", states, d_pool)
        d_score = w * (d_w - (w * d_w).sum(0))
        d_e = d_score[..., None] * p["v"] * (1 - e * e)
        g["v"] = np.einsum("tb,tbk->k", d_score, e)
        g["A"] = np.einsum("tbd,tbk->dk", states, d_e)
        g["a"] = d_e.sum((0, 1))
        d_states = w[..., None] * d_pool + d_e @ p["A"].T
        d_gates = {}
        for side, order in (("f", range(WINDOW - 1, -1, -1)), ("b", range(WINDOW))):
            base = 0 if side == "f" else h
            d_s = np.zeros((at.shape[1], h), np.float32)
            g["U" + side] = np.zeros_like(p["U" + side])
            d_gate = np.zeros_like(gates[side])
            for t in order:
                s, z, r, n, un = trace[side, t]
                d = (d_states[t, :, base : base + h] + d_s) * real[t][:, None]
                d_n = d * (1 - z) * (1 - n * n)
                d_z = d * (s - n) * z * (1 - z)
                d_r = d_n * un * r * (1 - r)
                d_in = np.concatenate([d_z, d_r, d_n], 1)
                d_u = np.concatenate([d_z, d_r, d_n * r], 1)
                g["U" + side] += s.T @ d_u
                d_s = d * z + d_u @ p["U" + side].T
                order_by = np.argsort(at[t], kind="stable")
                rows, first = np.unique(at[t][order_by], return_index=True)
                d_gate[rows] += np.add.reduceat(d_in[order_by], first, axis=0)
            d_gates[side] = d_gate[:-1]
        return g, d_gates

    def learn(self, words: Words, at, real, bag, label, sharp: float, rate: float):
        """One step on bags of windows: a bag's logit is the soft maximum of its windows' logits."""
        x = self.inputs(words)
        gates = self.gates(x)
        logit, kept = self.forward(gates, at, real, keep=True)
        starts = np.flatnonzero(np.r_[True, bag[1:] != bag[:-1]])
        which = np.cumsum(np.r_[0, bag[1:] != bag[:-1]])
        top = np.maximum.reduceat(logit, starts)
        share = np.exp(np.float32(sharp) * (logit - top[which]))
        total = np.add.reduceat(share, starts)
        count = np.bincount(which).astype(np.float32)
        soft = top + np.log(total / count) / sharp
        d_bag = (_sigmoid(soft) - label) / len(label)
        g, d_gates = self.backward(gates, at, real, kept, (d_bag[which] * share / total[which]).astype(np.float32))
        d_x = np.zeros_like(x)
        for side in "fb":
            g["W" + side], g["b" + side] = x.T @ d_gates[side], d_gates[side].sum(0)
            d_x += d_gates[side] @ self.p["W" + side].T
        for k, d in g.items():
            self.seen[k] += d * d
            self.p[k] -= rate * d / np.sqrt(self.seen[k])
        self._rows("word", words.word, d_x, rate)
        spread = np.repeat(d_x / np.sqrt(np.maximum(words.sizes, 1), dtype=np.float32)[:, None], words.sizes, axis=0)
        self._rows("gram", words.grams, spread, rate)

    def _rows(self, name: str, rows: np.ndarray, d: np.ndarray, rate: float) -> None:
        free = ~self.fixed[name][rows]
        rows, d = rows[free], d[free]
        if not len(rows):
            return
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        own = rows[first]
        total = np.add.reduceat(d[order], first, axis=0) + DECAY * self.p[name][own]
        self.seen[name][own] += total * total
        self.p[name][own] -= rate * total / np.sqrt(self.seen[name][own])


def _split(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words per text, word numbers end to end, distinct words."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.ascii_trim_whitespace(column)))
    sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    numbers = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if "" in distinct:  # an empty text splits into one empty word
        blank = distinct.index("")
        gone = numbers == blank
        sizes = sizes - np.add.reduceat(np.r_[gone, False].astype(np.int64), np.cumsum(sizes) - sizes) if len(sizes) else sizes
        numbers = numbers[~gone]
    return sizes, numbers, [w.lower() for w in distinct]


def _grid(numbers: np.ndarray, first: np.ndarray, length: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    step = np.arange(WINDOW)[:, None]
    real = step < length
    return np.where(real, numbers[np.minimum(first + step, max(len(numbers) - 1, 0))], pad), real.astype(np.float32)


class ToxicityModel:
    """A fitted network with its cut, or a constant where labels of both classes are missing."""

    def __init__(self, network: Network | None, shift: float = 0.0, constant: float = 0.0):
        self.network, self.shift, self.constant = network, shift, constant

    def __getstate__(self):
        if self.network is not None:
            self.network.seen = {}
        return self.__dict__

    def logits(self, column: pa.Array) -> np.ndarray:
        """Highest window logit of each text, minus infinity for a text without words."""
        sizes, numbers, distinct = _split(column)
        out = np.full(len(sizes), -np.inf, np.float32)
        text, first, length = windows(sizes)
        gates = self.network.gates(self.network.inputs(features(distinct)))
        for lo in range(0, len(text), BLOCK):
            at, real = _grid(numbers, first[lo : lo + BLOCK], length[lo : lo + BLOCK], len(distinct))
            np.maximum.at(out, text[lo : lo + BLOCK], self.network.forward(gates, at, real))
        return out - np.float32(self.shift)

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.network is None:
            return np.full(len(column), self.constant)
        logits = self.logits(column).astype(np.float64)
        return np.where(np.isneginf(logits), 0.0, 1 / (1 + np.exp(-np.clip(logits, -30, 30))))


def train(texts: list[str], labels: np.ndarray, seed: int = SEED) -> ToxicityModel:
    """Fit on texts labelled 0 or 1; with one class only, the model always answers that class."""
    if not len(texts) or labels.min() == labels.max():
        return ToxicityModel(None, constant=float(labels[0]) if len(texts) else 0.0)
    draw = np.random.default_rng(seed)
    sizes, numbers, distinct = _split(pa.array(texts, pa.string()))
    words, known = features(distinct), len(texts)
    del texts, distinct  # what follows needs numbers only
    text, first, length = windows(sizes)
    starts, counts = np.searchsorted(text, np.arange(known)), np.bincount(text, minlength=known)
    usable = np.flatnonzero(counts > 0)
    short = usable[sizes[usable] <= SHORT]
    if len(np.unique(labels[short])) < 2:
        short = usable
    if len(np.unique(labels[short])) < 2:
        return ToxicityModel(None, constant=float(labels.mean() >= 0.5))
    network = Network(seed)
    network.restrict(words, numbers, np.repeat(np.arange(known), sizes))
    pools = [short[labels[short] == k] for k in (0, 1)]
    hard = np.zeros(0, np.int64)  # windows of clean texts that score too high

    def step(bags: list[np.ndarray], marks: np.ndarray, sharp: float, rate: float) -> None:
        chosen = np.concatenate(bags)
        bag = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        at, real = _grid(numbers, first[chosen], length[chosen], -1)
        picked, inverse = _picked(words, at)
        network.learn(picked, inverse, real, bag, marks, sharp, rate)

    rounds = max(EPOCHS, -(-EPOCHS * 600 // max(map(len, pools))))
    for epoch in range(rounds):
        done = epoch / rounds
        if epoch and epoch >= rounds // 2:
            clean = np.flatnonzero(labels[text] == 0)
            logit = _window_logits(network, words, numbers, first[clean], length[clean])
            hard = clean[logit > -1.0][np.argsort(-logit[logit > -1.0], kind="stable")][:4000]
        most = min(EPOCH_TEXTS, max(map(len, pools)))
        order = [np.concatenate([draw.permutation(p) for _ in range(-(-most // len(p)))])[:most] for p in pools]
        for lo in range(0, most, BAGS):
            docs = np.concatenate([o[lo : lo + BAGS] for o in order])
            bags = [np.arange(starts[d], starts[d] + counts[d]) for d in docs]
            marks = labels[docs]
            if len(hard):
                bags += [hard[i : i + 1] for i in draw.integers(0, len(hard), BAGS)]
                marks = np.r_[marks, np.zeros(BAGS, labels.dtype)]
            step(bags, marks.astype(np.float32), 1.0 + 5.0 * done, 0.08 if done < 0.6 else 0.04)
    logits = np.full(known, -np.inf, np.float32)
    np.maximum.at(logits, text, _window_logits(network, words, numbers, first, length))
    network.seen = {}
    return ToxicityModel(network, _cut(logits[usable], labels[usable]))


def _runs(words: Words, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = words.sizes[own]
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes) + np.repeat(words.starts[own], sizes)
    return words.grams[at], ends - sizes, sizes


def _picked(words: Words, at: np.ndarray) -> tuple[Words, np.ndarray]:
    """The words of a grid (-1: padding) and the grid over them, padding last."""
    own, inverse = np.unique(at, return_inverse=True)
    inverse = inverse.reshape(at.shape)
    if own[0] == -1:
        own, inverse = own[1:], inverse - 1
        inverse[inverse < 0] = len(own)
    return Words(words.word[own], *_runs(words, own)), inverse


def _window_logits(network: Network, words: Words, numbers, first, length) -> np.ndarray:
    """Block by block, so that only a block's words have gates at a time."""
    out = [np.zeros(0, np.float32)]
    for lo in range(0, len(first), BLOCK):
        at, real = _grid(numbers, first[lo : lo + BLOCK], length[lo : lo + BLOCK], -1)
        picked, inverse = _picked(words, at)
        out.append(network.forward(network.gates(network.inputs(picked)), inverse, real))
    return np.concatenate(out)


def _cut(logits: np.ndarray, labels: np.ndarray) -> float:
    """The cut with the fewest class-weighted errors on the sample; of equal ones the middle of the widest gap."""
    order = np.argsort(logits, kind="stable")
    z, y = logits[order], labels[order]
    miss = np.r_[0, np.cumsum(y == 1)] / max(1, (y == 1).sum()) + ((y == 0).sum() - np.r_[0, np.cumsum(y == 0)]) / max(1, (y == 0).sum())
    edge = np.r_[z[0] - 1, z, z[-1] + 1]
    gap = np.where(miss <= miss.min() + 1e-12, edge[1:] - edge[:-1], -1)
    k = int(gap.argmax())
    return float((edge[k] + edge[k + 1]) / 2)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: tuple[int, int] = SAMPLE) -> ToxicityModel:
    """Fit on at most ``sample`` labelled rows (toxic, clean), whole texts, in one task.

    Ids with several labels count as toxic if one says so; null ids, labels and
    rows without a text take no part.
    """
    prepare(docs.sparkSession)
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("y"))
    mixed = F.xxhash64("id")
    chosen = own.where("y = 1").orderBy(mixed, "id").limit(sample[0]).unionByName(own.where("y = 0").orderBy(mixed, "id").limit(sample[1]))
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # the sample's bound is the bound of this broadcast and of what the one task of the fit holds
    found = rows.join(F.broadcast(chosen), "id").select("id", "y", "text").groupBy("id").agg(F.max("y").alias("y"), F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = [b for b in batches if b.num_rows]
        if sample:
            table = pa.Table.from_batches(sample).sort_by([("id", "ascending")])
            model = train(table["text"].to_pylist(), table["y"].to_numpy().astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # texts and training stay off the driver, which gets the model: the size of the network
    fitted = found.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(bytes(fitted["model"])) if fitted else train([], np.zeros(0, np.int64))


def with_score(docs: DataFrame, model: ToxicityModel, text_col: str, name: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of every row with its score, where it is read; a null text is an empty one."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the size of the network, whatever the data
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias(f"{name}_text"), *keep)
    schema = T.StructType([T.StructField(name, T.DoubleType()), *(docs.schema[c] for c in keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.scores(batch.column(0)), pa.float64()), *batch.columns[1:]], [name, *batch.schema.names[1:]])

    return rows.mapInArrow(run, schema)


def toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every row. Null and empty texts score 0, repeated rows alike."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return with_score(narrow, model, "text", "score", ["doc_id"]).select("doc_id", "score")


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``cut``, with all their columns."""
    return with_score(docs, model, text_col, "__score", docs.columns).where(F.col("__score") < cut).select(docs.columns)
