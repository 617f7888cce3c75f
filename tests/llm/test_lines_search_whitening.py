"""Line removal, ranked search and whitening against brute force: nulls, empty and long texts, ties, repeats, clashing columns, empty tables."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterloom.llm import lexical, line_dedup, whitening
from meterloom.session import cut

EXTRA = ["row", "keys", "key", "n", "range", "segment", "lost", "spared", "terms", "counts", "item", "rank", "score", "x", "component", "count"]
BLANK = " \t\n\x0b\x0c\r"


def clashing(df):
    return df.select("*", *(F.lit("x").alias(c) for c in EXTRA))


# --- lines ---------------------------------------------------------------

def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def lines_brute(rows, min_docs, least, keep):
    """Rows alike in id and text share the place of a first occurrence, as they share their result."""
    split = [[(line, ascii_lower(line.strip(BLANK))) for line in (text or "").split("\n")] for _, text in rows]
    holders = collections.defaultdict(list)
    for i, own in enumerate(split):
        for key in {k for _, k in own if len(k) >= max(least, 1)}:
            holders[key].append(i)
    often = {k for k, at in holders.items() if len(at) >= min_docs}
    first = {k: min(holders[k], key=lambda i: (rows[i][0] is None, rows[i][0] or 0)) for k in often}
    out = []
    for i, own in enumerate(split):
        once = {k for k in often if keep == "first" and (rows[first[k]][0], rows[first[k]][1] or "") == (rows[i][0], rows[i][1] or "")}
        kept = []
        for line, key in own:
            if key in once:
                once.discard(key)
            elif key in often:
                continue
            kept.append(line)
        out.append((rows[i][0], "\n".join(kept), len(own), len(own) - len(kept)))
    return sorted(out, key=repr)


def line_rows():
    draw = random.Random(3)
    shared = [f"Shared line {i} ÄÖ" for i in range(30)] + ["", "  ", "x"]
    rows = []
    for i in range(160):
        own = [draw.choice([f"own {i} {j}", draw.choice(shared), "  " + draw.choice(shared).upper().replace("ÄÖ", "ÄÖ") + "\r", "HOT line\t"]) for j in range(draw.randint(1, 9))]
        rows.append((i, "\n".join(own)))
    rows += [(7, "HOT line"), (500, None), (501, ""), (502, "\n\n"), (503, "word " * 60_000 + "\nhot line\n" + "z" * 300_000)]
    rows += [(504, "copy\nhot line")] * 12 + [(None, "hot line\nno id")] * 2
    return rows


@pytest.mark.parametrize("sent", [1 << 17, 0])
@pytest.mark.parametrize("min_docs, least, keep, range_keys", [(10, 1, "none", 1 << 24), (3, 1, "first", 1 << 24), (10, 2, "none", 100), (2, 12, "first", 50)])
def test_lines(spark, min_docs, least, keep, range_keys, sent):
    rows = line_rows()
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    got = line_dedup.line_dedup(df, min_docs, least, keep, range_keys=range_keys, sent_keys=sent).collect()
    assert sorted((tuple(r) for r in got), key=repr) == lines_brute(rows, min_docs, least, keep)


def test_line_filters_pass_every_repeat_and_few_others(spark, monkeypatch):
    """Cells met once in two tasks count as met twice; a task that hands on its filters many times does so too."""
    rows = line_rows()
    keys = cut(line_dedup.line_keys(spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartition(9)))
    total = keys.agg(F.sum(F.octet_length("keys"))).first()[0] // line_dedup.DIGEST
    often = collections.Counter(k[i : i + 16] for (k,) in keys.select("keys").collect() for i in range(0, len(k), 16))
    repeated = {bytes(k) for k, n in often.items() if n > 1}
    found = {bytes(r["key"]) for r in line_dedup.suspected_repeats(keys).collect()}
    assert repeated <= found and len(found - repeated) <= 0.05 * total
    halves = line_dedup._halves(b"".join(often))
    parts = list(line_dedup._segments(halves, line_dedup.SEGMENT))
    marked = {s * line_dedup.SEGMENT + int(c) for s, once, _ in parts for c in np.flatnonzero(line_dedup._bits(once))}
    assert marked == {int(c) for half in line_dedup._cells(halves, line_dedup.SEGMENT) for c in half}


def test_filter_codes():
    some, many = np.array([0, 5, line_dedup.SEGMENT - 1]), np.arange(0, line_dedup.SEGMENT, 3)
    for at in (some, many, some[:0]):
        assert (np.flatnonzero(line_dedup._bits(line_dedup._coded(at))) == at).all()


def test_lines_of_nothing(spark):
    df = clashing(spark.createDataFrame([(1, "a")], "doc_id long, text string").where("false"))
    assert line_dedup.line_dedup(df).collect() == []
    with pytest.raises(ValueError):
        line_dedup.line_dedup(df, keep="last")


# --- ranked search -------------------------------------------------------

def search_brute(docs, items, k=10):
    terms = [(d, lexical.terms_of(t)) for d, t in docs]
    terms = [(d, t) for d, t in terms if t]
    n, length = len(terms), sum(len(t) for _, t in terms)
    df = collections.Counter(w for _, t in terms for w in set(t))
    out = []
    for item, text in items:
        scored = []
        for d, own in terms:
            tf = collections.Counter(own)
            m = 100 - 90 + 90 * len(own) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1000000000 * tf[w] // (1000 * tf[w] + 8 * m)) for w in set(lexical.terms_of(text)) if w in tf)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored, key=lambda r: r[:3])[:k], 1)]
    return sorted(out, key=repr)


def search_rows():
    draw = random.Random(5)
    words = ["the", "of", "Größe", "日本", "x1", "été", "alpha", "beta", "gamma", "delta", "10"] + [f"w{i}" for i in range(60)]
    docs = [(i, draw.choice([" ", ", ", "\n", "  "]).join(draw.choices(words, k=draw.randint(0, 40)))) for i in range(700)]
    docs += [(5, docs[9][1]), (None, "Alpha beta w1"), (None, "alpha beta w1"), (800, None), (801, ""), (802, "... !"), (803, "alpha " * 50_000 + "W1"), (804, docs[10][1]), (804, docs[10][1])]
    items = [(i, " ".join(draw.choices(words, k=draw.randint(1, 25)))) for i in range(40)]
    items += [(3, items[3][1]), (90, None), (91, "?"), (92, "never seen"), (None, "ALPHA w1 alpha")]
    return docs, items


@pytest.mark.parametrize("k, block", [(10, 512), (3, 7)])
def test_search(spark, k, block):
    docs, items = search_rows()
    got = lexical.ranked_search(
        clashing(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)), clashing(spark.createDataFrame(items, "item_id long, text string")), k, block=block
    ).collect()
    assert sorted((tuple(r) for r in got), key=repr) == search_brute(docs, items, k)


def test_shared_sums_add_up():
    """Every item is the sum of its terms, each once, with fewer additions than without sharing; a small budget for mining changes nothing."""
    _, items = search_rows()
    sets = [set(lexical.terms_of(t)) for _, t in items]
    for pairs in (lexical.PAIRS, 30, 0):
        plan = lexical.share(sets, pairs)
        held = [collections.Counter(t for t, f in zip(plan.terms, plan.first) if f == node) for node in range(plan.atoms)] + [None] * (plan.nodes - plan.atoms)
        for level in plan.levels:
            for node, a, b in zip(*level):
                held[node] = held[a] + held[b]
        for own, members in zip(sets, plan.members):
            assert sum((held[m] for m in members), collections.Counter()) == collections.Counter(own)
        if pairs == lexical.PAIRS:
            assert plan.levels and plan.additions() < 0.7 * sum(map(len, sets))


def test_search_of_nothing(spark):
    docs, items = search_rows()
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert lexical.ranked_search(d.where("false"), i).collect() == []
    assert lexical.ranked_search(d, i.where("false")).collect() == []
    assert lexical.ranked_search(d, i.where("item_id = 91")).collect() == []


# --- whitening -----------------------------------------------------------

def whiten_brute(vectors, count=4):
    x = np.array(vectors, dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    away = fit - total / n
    e, v = np.linalg.eigh(away.T @ away / n)
    return n, total, e[::-1][:count], v[:, ::-1][:, :count], e.sum() or 1.0, x


def integer(vector):
    return [math.floor(256 * float(np.float32(c))) for c in vector]


def check_whitened(rows, want_ids, vectors, count=4):
    n, total, e, v, trace, x = whiten_brute(vectors, count)
    k = len(e)
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["component"]) for r in rows) == sorted((i is None, i or 0, c + 1) for i in want_ids for c in range(k))
    exact = collections.defaultdict(list)
    for i, row in zip(want_ids, x.tolist()):
        exact[i].append((sum((n * a - int(t)) ** 2 for a, t in zip(row, total)), np.array(row) - total / n))
    sign = {}
    for r in rows:
        c = r["component"] - 1
        assert r["n"] == n and abs(r["explained"] - e[c] / trace) <= 1e-9 * max(e[c] / trace, 1e-3)
        assert r["deviation"] in [d for d, _ in exact[r["vec_id"]]]
        if r["whitened"] is None:
            assert e[c] <= 1e-9 * trace
            continue
        assert r["identity_error"] < 1e-10
        options = [a @ v[:, c] / math.sqrt(e[c]) for d, a in exact[r["vec_id"]] if d == r["deviation"]]
        if abs(options[0]) > 1e-6 and c not in sign:
            sign[c] = math.copysign(1, options[0] * r["whitened"])
        assert any(abs(r["whitened"] - sign.get(c, 1) * o) < 1e-8 for o in options)


def frame(spark, rows):
    return clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6))


def test_whitening(spark):
    rng = np.random.default_rng(2)
    made = (rng.normal(0, 0.2, (300, 12)) * np.linspace(2, 0.5, 12)).tolist()
    rows = [(i, v) for i, v in enumerate(made)] + [(7, made[7])] * 150 + [(1000 + i, made[3]) for i in range(150)] + [(None, made[5]), (None, made[6])]
    bad = [(2000, None), (2001, []), (2002, [None] + made[0][1:]), (2003, [math.nan] + made[0][1:]), (2004, [math.inf] + made[0][1:]), (2005, made[0][:5])]
    got = whitening.whiten(frame(spark, rows + bad)).collect()
    check_whitened(got, [i for i, _ in rows], [integer(v) for _, v in rows])


@pytest.mark.parametrize("vectors", [
    [[0.5, 0.25, 0.125]],
    [[0.5, 0.25, 0.125]] * 4,
    [[1.0], [2.0], [4.0]],
    [[0.1 * i, 0.2 * i, 3.0] for i in range(30)],
    [[0.0, 0.0], [-0.0, -0.001]],
])
def test_whitening_of_few_dimensions(spark, vectors):
    rows = list(enumerate(vectors))
    check_whitened(whitening.whiten(frame(spark, rows)).collect(), [i for i, _ in rows], [integer(v) for _, v in rows])


def test_whitening_in_a_narrow_basis(spark, monkeypatch):
    """More dimensions than the basis of a pass: passes repeat until the residuals rest."""
    monkeypatch.setattr(whitening, "BASIS", 16)
    rng = np.random.default_rng(4)
    made = (rng.normal(0, 0.2, (400, 24)) * np.concatenate([[6, 5, 4, 3], np.linspace(1, 0.4, 20)])).tolist()
    check_whitened(whitening.whiten(frame(spark, list(enumerate(made)))).collect(), list(range(400)), [integer(v) for v in made])


def test_whitening_of_nothing_and_beyond_64_bits(spark):
    assert whitening.whiten(frame(spark, [(1, [1.0])]).where("false")).collect() == []
    assert whitening.whiten(frame(spark, [(1, None)])).collect() == []
    got = whitening.whiten(frame(spark, [(1, [3e9, 1.0]), (2, [1.0, 2.0]), (3, [2.0, 0.0])])).collect()
    assert {r["vec_id"]: r["deviation"] for r in got}[1] is None and len(got) == 6


@pytest.mark.parametrize("kind", ["plain", "repeated", "few directions", "constant half"])
@pytest.mark.parametrize("dims", [1, 2, 7, 40])
def test_rank_one_spectra(kind, dims):
    """Row by row and merged, against the scatter matrix itself; vectors stay orthogonal."""
    rng = np.random.default_rng(dims)
    rows = np.floor(256 * rng.normal(0, 0.12, (200, dims))).astype(np.int64)
    if kind == "repeated":
        rows = np.repeat(rows[:10], 20, axis=0)
    if kind == "few directions" and dims > 2:
        rows = rows[:, :2] @ rng.integers(-3, 4, (2, dims))
    if kind == "constant half":
        rows[:, dims // 2 :] = 7
    one, two = whitening.Spectrum.empty(dims), whitening.Spectrum.empty(dims)
    for row in rows[:120]:
        one.add(row)
    for row in rows[120:]:
        two.add(row)
    one.merge(two)
    away = rows - rows.mean(axis=0)
    want = away.T @ away
    assert one.n == 200 and (one.total == rows.sum(axis=0)).all()
    assert np.abs(one.basis * one.values @ one.basis.T - want).max() <= 1e-11 * max(1, np.abs(want).max())
    assert np.abs(one.basis.T @ one.basis - np.eye(dims)).max() < 1e-11
