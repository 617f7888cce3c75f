"""Secret scanning: long unbroken strings, judged by a random forest trained on labelled findings.

A candidate is a run of at least ``LEAST`` token characters. Its features are
its length and character classes, how usual its character transitions are in
the corpus at hand (pair counts over every text), how much of it dictionary
words cover, the path it was found under and the words next to it. The forest
is grown in numpy on a bounded sample of labelled findings and travels with the
scan, which reads each text once and shuffles none.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterloom.llm.common import prepare, slices

LEAST = 16
#: Most labelled findings of each class that the forest is grown on.
SAMPLE = 4000
TREES, DEPTH, LEAF = 40, 10, 2
SEED = 11
#: Characters kept on each side of a candidate.
AROUND = 48
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_\-]{{{LEAST},}}={{0,2}}")
# Words whose neighbourhood speaks for and against a secret.
FOR = re.compile(r"(?i)passw|passphrase|\bpwd\b|token|secret|api[_-]?key|access[_-]?key|private|credential|auth|bearer|\bkey\b")
AGAINST = re.compile(r"(?i)commit|\bsha\d*\b|\bmd5\b|checksum|\bhash\b|digest|uuid|\bisbn\b|\bcard\b|phone|example|sample|placeholder|\btest\b|dummy")
PATH_FOR = re.compile(r"(?i)\.env|config|secret|credential|\.pem|\.key|settings|deploy")
PATH_AGAINST = re.compile(r"(?i)test|example|sample|doc|readme|\.md|fixture|mock|lock")
ASSIGNED = re.compile(r"""[=:]\s*["']?$""")
BUCKETS = 8

SCHEMA = "start long, length long, value string, before string, after string, path string"
FINDING = T.StructType([T.StructField(n, T.LongType() if t == "long" else T.StringType()) for n, t in (f.split() for f in SCHEMA.split(", "))])
FEATURES = 28


def candidates(text: str) -> Iterator[tuple[int, str, str, str]]:
    """Start (in characters), value and the text on both sides."""
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        if not (a and text[a - 1].isalnum()) and not (b < len(text) and text[b].isalnum()):  # whole words only
            yield a, m[0], text[max(0, a - AROUND) : a], text[b : b + AROUND]


class Context:
    """What features need besides the candidate: log pair frequencies and the dictionary, as one set of words."""

    def __init__(self, pairs: np.ndarray, words: set[str]):
        share = (pairs + 0.5) / (pairs.sum(1, keepdims=True) + 0.5 * pairs.shape[1])
        self.log_pair = np.log2(share)
        self.words = words
        self.longest = max(map(len, words), default=0)

    def coverage(self, value: str) -> float:
        """Share of the value covered by dictionary words, longest first from the left."""
        text, at, covered = value.lower(), 0, 0
        while at < len(text):
            for n in range(min(self.longest, len(text) - at), 3, -1):
                if text[at : at + n] in self.words:
                    covered += n
                    at += n
                    break
            else:
                at += 1
        return covered / max(1, len(text))


def features(value: str, before: str, after: str, path: str | None, context: Context) -> list[float]:
    n = len(value)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in value]
    raw = np.frombuffer(value.lower().encode("latin-1", "replace"), dtype=np.uint8) & 127
    pair = context.log_pair[raw[:-1], raw[1:]] if n > 1 else np.zeros(1)
    counts = np.bincount(raw, minlength=128)
    share = counts[counts > 0] / n
    near = (before.split()[-3:], after.split()[:2])
    words = " ".join(near[0])
    hashed = [0.0] * BUCKETS
    for w in (*near[0], *near[1]):
        hashed[zlib.crc32(w.lower().strip(".,;:=\"'").encode()) % BUCKETS] += 1
    path = path or ""
    return [
        n, np.log(n), kinds.count("d") / n, kinds.count("u") / n, kinds.count("l") / n, kinds.count("s") / n,
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n, pair.mean(), pair.min(), np.percentile(pair, 25),
        -(share * np.log2(share)).sum(), context.coverage(value), float(all(c in "0123456789abcdefABCDEF" for c in value)),
        float(bool(FOR.search(words))), float(bool(AGAINST.search(words) or AGAINST.search(" ".join(near[1])))), float(bool(ASSIGNED.search(before))),
        float(before[-1:] in "\"'" and before != ""), float(bool(PATH_FOR.search(path))), float(bool(PATH_AGAINST.search(path))), float(path.count("/")),
        *hashed,
    ]


class Forest:
    """Random forest of binary decision trees: bootstrap samples, random features, Gini impurity."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF, seed: int = SEED):
        self.trees, self.depth, self.leaf, self.seed = trees, depth, leaf, seed
        self.nodes: list[list[np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Forest":
        draw = np.random.default_rng(self.seed)
        some = max(1, int(np.sqrt(x.shape[1])) + 1)
        self.nodes = [self._tree(x, y, draw.integers(0, len(x), len(x)), draw, some) for _ in range(self.trees)]
        return self

    def _tree(self, x, y, sample, draw, some) -> list[np.ndarray]:
        feature, cut, left, right, value = [], [], [], [], []

        def add(rows) -> int:
            for column, v in ((feature, -1), (cut, 0.0), (left, -1), (right, -1), (value, y[rows].mean())):
                column.append(v)
            return len(feature) - 1

        todo = [(add(sample), sample, 0)]
        while todo:
            node, rows, depth = todo.pop()
            if depth >= self.depth or len(rows) < 2 * self.leaf or value[node] in (0.0, 1.0):
                continue
            best = (np.inf, -1, 0.0)
            for f in draw.permutation(x.shape[1])[:some]:
                order = np.argsort(x[rows, f], kind="stable")
                v, ones = x[rows, f][order], np.cumsum(y[rows][order])
                size = np.arange(1, len(rows) + 1)
                ok = np.flatnonzero((v[1:] > v[:-1]) & (size[:-1] >= self.leaf) & (len(rows) - size[:-1] >= self.leaf))
                if not len(ok):
                    continue
                a, b = ones[ok], ones[-1] - ones[ok]
                m, n = size[ok], len(rows) - size[ok]
                impurity = a * (m - a) / m + b * (n - b) / n
                k = int(impurity.argmin())
                if impurity[k] < best[0]:
                    best = (impurity[k], f, (v[ok[k]] + v[ok[k] + 1]) / 2)
            if best[1] < 0:
                continue
            go = x[rows, best[1]] <= best[2]
            feature[node], cut[node] = best[1], best[2]
            left[node], right[node] = add(rows[go]), add(rows[~go])
            todo += [(left[node], rows[go], depth + 1), (right[node], rows[~go], depth + 1)]
        return [np.array(c) for c in (feature, cut, left, right, value)]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean share of label 1 in the leaves."""
        total = np.zeros(len(x))
        for feature, cut, left, right, value in self.nodes:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                go = x[np.arange(len(x)), f] <= cut[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            total += value[at]
        return total / max(1, len(self.nodes))


class SecretModel:
    """A forest and its context; without both classes to learn from, a constant."""

    def __init__(self, context: Context, forest: Forest | None, constant: float = 0.0):
        self.context, self.forest, self.constant = context, forest, constant

    def scores(self, found: list[tuple[str, str, str, str | None]]) -> np.ndarray:
        if self.forest is None or not found:
            return np.full(len(found), self.constant)
        return self.forest.predict(np.array([features(*f, self.context) for f in found]))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """Every candidate: ``doc_id, start, length, value, before, after, path``."""
    prepare(docs.sparkSession)
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), path.alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "value", "before", "after", "path"]
        for batch in batches:
            rows = [(i, a, len(v), v, b, c, p) for i, t, p in zip(*(c.to_pylist() for c in batch.columns)) for a, v, b, c in candidates(t)]
            kinds = [pa.int64()] * 3 + [pa.string()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names)

    return rows.mapInArrow(run, f"doc_id long, {SCHEMA}")


def pair_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each lower-case ASCII character follows another, over all texts; a 128 x 128 table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(128 * 128, dtype=np.int64)
        for batch in batches:
            for lo, hi in slices(batch.column(0)):
                raw = np.frombuffer("\n".join(batch.column(0).slice(lo, hi - lo).to_pylist()).lower().encode(), dtype=np.uint8)
                plain = raw.astype(np.int32)
                both = plain[:-1] * 128 + plain[1:]
                total += np.bincount(both[(raw[:-1] < 128) & (raw[1:] < 128)], minlength=128 * 128)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["pair", "n"])

    rows = docs.select(F.coalesce(F.col(text_col), F.lit(""))).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(128 * 128)
    for r in rows:
        out[r["pair"]] = r["n"]
    return out.reshape(128, 128)


def dictionary(path: str) -> set[str]:
    """Words of at least four letters from the ranks of a public vocabulary."""
    import base64

    with open(path, "rb") as lines:
        tokens = [base64.b64decode(line.split()[0]).decode("utf-8", "ignore").strip().lower() for line in lines if line.strip()]
    return {t for t in tokens if len(t) >= 4 and t.isalpha()}


def fit(findings: DataFrame, context: Context, label_col: str = "label", sample: int = SAMPLE) -> SecretModel:
    """Grow the forest on at most ``sample`` labelled findings per class (in the order of a hash), columns as ``find`` gives them; null labels take no part."""
    mixed = F.xxhash64("doc_id", "start", "value")
    known = findings.where(F.col(label_col).isNotNull()).withColumn("__y", (F.col(label_col) > 0).cast("int"))
    chosen = known.where("__y = 1").orderBy(mixed).limit(sample).unionByName(known.where("__y = 0").orderBy(mixed).limit(sample))
    rows = sorted(chosen.select("value", "before", "after", "path", "__y").collect(), key=lambda r: (r["value"], r["before"], r["after"]))
    y = np.array([r["__y"] for r in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        return SecretModel(context, None, float(y[0]) if len(y) else 0.0)
    x = np.array([features(r["value"], r["before"], r["after"], r["path"], context) for r in rows])
    return SecretModel(context, Forest().fit(x, y))


def scan(docs: DataFrame, model: SecretModel, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", cut: float = 0.5) -> DataFrame:
    """One row per candidate: ``doc_id, start, length, value_sha256, score, is_secret``.

    Null and empty texts have none; repeated rows give theirs each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample, the dictionary and the pair table
    found = find(docs, id_col, text_col, path_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("value").to_pylist()
            score = shared.value.scores(list(zip(values, *(batch.column(n).to_pylist() for n in ("before", "after", "path")))))
            digests = pa.array([hashlib.sha256(v.encode()).hexdigest() for v in values], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in ("doc_id", "start", "length")), digests, pa.array(score, pa.float64()), pa.array(score >= cut, pa.bool_())],
                ["doc_id", "start", "length", "value_sha256", "score", "is_secret"],
            )

    return found.mapInArrow(run, "doc_id long, start long, length long, value_sha256 string, score double, is_secret boolean")


def redact(docs: DataFrame, model: SecretModel, text_col: str = "text", path_col: str | None = "source", mark: str = "[SECRET]", cut: float = 0.5) -> DataFrame:
    """``docs`` with every secret replaced by ``mark`` in ``text_col``; other columns, and texts without any, stay as they are."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place, path_at = docs.columns.index(text_col), docs.columns.index(path_col) if path_col else None

    def clean(text: str | None, path) -> str | None:
        found = list(candidates(text or ""))
        if not found:
            return text
        bad = shared.value.scores([(v, b, a, None if path is None else str(path)) for _, v, b, a in found]) >= cut
        parts, at = [], 0
        for (start, value, _, _), gone in zip(found, bad):
            if gone:
                parts += [text[at:start], mark]
                at = start + len(value)
        return "".join([*parts, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(path_at).to_pylist() if path_at is not None else [None] * batch.num_rows
            new = pa.array([clean(t, p) for t, p in zip(batch.column(place).to_pylist(), paths)], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == place else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


#: Formats that label a finding beyond doubt (1), and shapes and places that no secret has (0).
KNOWN_SECRET = r"^AKIA[0-9A-Z]{16}$"
ASSIGNED_SECRET = r"(?i)(passw(or)?d|pwd|token|secret|api[_-]?key|access[_-]?key)[\"']?\s*[=:]\s*[\"']?$"
NO_SECRET = r"^(\p{L}+|[0-9]+|[\p{L}/_-]+)$"
BENIGN_PLACE = r"(?i)(commit|sha\d*|md5|checksum|uuid|isbn|card)\s*[=:]?\s*[\"']?$"


def labelled(findings: DataFrame) -> DataFrame:
    """Findings with ``label`` 1 or 0 where format or place leave no doubt, else null: a stand-in for a reviewed list."""
    sure = F.col("value").rlike(KNOWN_SECRET) | (F.col("before").rlike(ASSIGNED_SECRET) & ~F.col("value").rlike(NO_SECRET))
    never = F.col("value").rlike(NO_SECRET) | F.col("before").rlike(BENIGN_PLACE)
    return findings.withColumn("label", F.when(sure, 1).when(never, 0))
