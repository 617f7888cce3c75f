"""Text operators against brute force on small hand-made tables: nulls, empty and long texts, ties, repeats, clashing columns, empty tables."""

import base64
import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from meterloom.llm import byte_bpe, cover_tree, exact_dedup, html_text, lattice_lm, packing, secrets, simhash, substring_dedup, toxicity

SPACE = "\x20\x09-\x0d"
LONG = "word " * 30_000 + "end"
SECRET = "token = \"0b96a8c8d79c4a5085c919698889f59b72ab7bb6\""
ROWS = [
    (1, "The quick  brown fox\njumps over the lazy dog", "a"),
    (2, "The quick brown fox jumps over the lazy dog", None),
    (3, None, "b"),
    (4, "", "b"),
    (5, " \t\n", "c"),
    (6, LONG, "c"),
    (7, LONG, "c"),
    (8, "Ünïcode çafé 日本語 🎉 don't we'll 123 ½", None),
    (8, "Ünïcode çafé 日本語 🎉 don't we'll 123 ½", None),
    (None, "no id at all", "d"),
    (9, "THE quick brown fox jumps over the lazy dog", "d"),
    (10, SECRET + " and more", "d"),
    (11, "ok", "d"),
]
#: Columns whose names the operators use themselves.
EXTRA = ["kept", "keep_id", "mark", "score", "start", "n", "word", "block", "id"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return df.select("*", *(F.lit("x").alias(c) for c in EXTRA))


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def words(text):
    return re.findall(f"[^{SPACE}]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# --- exact dedup ---------------------------------------------------------

def exact_brute(rows):
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub(f"[{SPACE}]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for text, own in groups.items():
        own.sort(key=lambda r: r[:3])
        for place, r in enumerate(own):
            out.append((r[3], own[0][3], len(own), place == 0, hashlib.sha256(text.encode()).hexdigest()))
    return collections.Counter(out)


def test_exact_groups(docs, nothing):
    assert collections.Counter(map(tuple, exact_dedup.exact_groups(docs).collect())) == exact_brute(ROWS)
    assert exact_dedup.exact_groups(nothing).count() == 0


def test_exact_groups_hot_text_and_full_filter(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MOST_CELLS", 64)
    monkeypatch.setattr(exact_dedup, "LEAST_CELLS", 64)
    rows = [(i, "same text" if i % 3 == 0 else f"text {i // 2}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert collections.Counter(map(tuple, exact_dedup.exact_groups(df).collect())) == exact_brute(rows)


def test_exact_groups_filter_is_a_table(spark, monkeypatch):
    """The filter is broadcast as a table: a plan that carries it as a literal computes it wherever it is tested."""
    rows = [(i, f"text {i // 2 if i % 5 else i}") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = exact_dedup.exact_groups(df)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") < 30
    monkeypatch.setattr(exact_dedup, "BLOCK_CELLS", 128)  # many blocks
    assert collections.Counter(map(tuple, exact_dedup.exact_groups(df).collect())) == collections.Counter(map(tuple, found.collect())) == exact_brute(rows)


def test_exact_dedup_rows(docs, nothing):
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == sorted((r[0] or 0) for r in exact_brute(ROWS) if r[3])
    assert exact_dedup.exact_dedup(nothing).count() == 0


# --- simhash -------------------------------------------------------------

def fingerprint(text):
    own = words(text)
    parts = [" ".join(own[i : i + 3]) for i in range(len(own) - 2)] or ([" ".join(own)] if own else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def connected(marks, radius):
    marks = sorted(set(marks))
    parent = {m: m for m in marks}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(marks):
        for b in marks[:i]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {m: find(m) for m in marks}


def test_simhash_components(docs, nothing):
    marks = [(i, fingerprint(t)) for i, t, _ in ROWS]
    roots = connected([m for _, m in marks], 2)
    low = collections.defaultdict(list)
    for i, m in marks:
        low[roots[m]].append(i)
    first = {r: min((i for i in own if i is not None), default=None) for r, own in low.items()}
    want = collections.Counter((i, format(m, "016x"), first[roots[m]]) for i, m in marks)
    assert collections.Counter(map(tuple, simhash.simhash_components(docs).collect())) == want
    kept = simhash.simhash_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(first)
    assert simhash.simhash_components(nothing).count() == 0 and simhash.simhash_dedup(nothing).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 3])
@pytest.mark.parametrize("bucket", [256, 3])
def test_near_links_connect_like_all_pairs(spark, monkeypatch, radius, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    draw, marks = random.Random(radius), set()
    for _ in range(30):
        own = draw.getrandbits(64)
        for _ in range(draw.randint(1, 12)):
            x = own
            for _ in range(draw.randint(0, 3)):
                x ^= 1 << draw.randrange(64)
            marks.add(x - (1 << 64) if x >> 63 else x)
            own = x if draw.random() < 0.3 else own
    found = {r["node"]: r["root"] for r in simhash.components(simhash.near_links(spark.createDataFrame([(m,) for m in marks], "mark long"), radius)).collect()}
    assert {m: found.get(m, m) for m in marks} == connected(marks, radius)


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    found = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    assert found == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}


# --- byte-level BPE ------------------------------------------------------

def test_byte_bpe_matches_library(docs, nothing):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    made = byte_bpe.codec(path, public_tokenizers.PATTERN)
    draw = random.Random(1)
    texts = ["".join(draw.choice("ab '\x1c\x85\xa0\t\n\rstdmlrev²½éªż日1_-") for _ in range(50)) for _ in range(500)]
    for t in [*texts, *(t or "" for _, t, _ in ROWS)]:
        assert made.encode(t) == library.encode_ordinary(t)
        assert made.decode(made.encode(t)) == t.encode()
    want = collections.Counter()
    for i, t, _ in ROWS:
        ids = library.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, byte_bpe.encode_digest(docs, path, public_tokenizers.PATTERN).collect())) == want
    rows = byte_bpe.encode_decode(docs, path, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r["decoded"]) for r in rows) == sorted((t or "").encode() for _, t, _ in ROWS)
    assert byte_bpe.encode_digest(nothing, path, public_tokenizers.PATTERN).count() == 0


def test_perfect_hash_is_minimal():
    keys = [f"k{i}".encode() for i in range(5000)]
    made = byte_bpe.PerfectHash(keys)
    hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
    assert (made.find(hashes) == np.arange(5000)).all() and sorted(made.slots) == list(range(5000))
    assert made.find(np.array([xxhash.xxh3_64_intdigest(b"other")], dtype=np.uint64))[0] == -1


# --- language model ------------------------------------------------------

def test_lattice_sums_all_segmentations():
    pieces = ["a", "b", "ab", "ba", "▁", "▁a", "aba"]
    model = lattice_lm.Lattice(pieces, [0, -1, -2, -3, -4, -5, -6])
    weight = dict(zip(pieces, model.log))

    def brute(text, i=0):
        if i == len(text):
            return 1.0
        total = math.exp(model.bytes_log(np.array([ord(text[i])], np.uint64))[0]) * brute(text, i + 1)
        return total + sum(math.exp(weight[text[i : i + n]]) * brute(text, i + n) for n in (1, 2, 3) if len(text[i : i + n]) == n and text[i : i + n] in weight)

    found = ["a", "abab", "xéa", "babab", "𝄞a"]
    for rows, codes in lattice_lm.same_length(found):
        arcs = model.arcs(codes)
        for at, value in zip(rows, model.forward(codes, arcs)[-1]):
            assert value == pytest.approx(math.log(brute("▁" + found[at])))
        uses = model.expected(codes, arcs, np.ones(len(rows)))
        step = 1e-6  # expected uses are the derivative of the log probability by a piece's log weight
        for k in range(len(pieces)):
            before = model.forward(codes, arcs)[-1].sum()
            model.log[k] += step
            assert (model.forward(codes, arcs)[-1].sum() - before) / step == pytest.approx(uses[k], abs=1e-4)
            model.log[k] -= step


def test_lm_scores(docs, nothing):
    path = public_tokenizers.path("piece_bpe_32k.model")
    tagged = docs.withColumn("out", F.col("doc_id") % 2 == 0)
    rows = lattice_lm.lm_scores(tagged, path, held_col="out").collect()
    assert len(rows) == len(ROWS)
    learned = collections.Counter(w for i, t, _ in ROWS if i is None or i % 2 for w in [*words(t), None])
    total, distinct = sum(learned.values()), len(learned)
    base = lambda w: math.log10((learned[w] + 0.1) / (total + 0.1 * (distinct + 1)))
    want = collections.Counter((i, i is not None and i % 2 == 0, len(words(t)) + 1, sum(learned[w] > 0 for w in [*words(t), None]), total, round(sum(map(base, [*words(t), None])), 6)) for i, t, _ in ROWS)
    assert collections.Counter((*r[:5], round(r["base_score"], 6)) for r in rows) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert lattice_lm.lm_scores(nothing, path).count() == 0
    assert all(math.isfinite(r["score"]) for r in lattice_lm.lm_scores(docs.withColumn("out", F.lit(True)), path, held_col="out").collect())


# --- packing -------------------------------------------------------------

def test_packing(docs, nothing):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = packing.pack(docs, path).collect()
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [2] for i, t, _ in ROWS}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"] and len(part) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces[r["doc_id"]] += range(r["start"], r["start"] + r["length"])
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    copies = collections.Counter(i for i, *_ in ROWS)
    assert {i: sorted(p) for i, p in pieces.items()} == {i: sorted([*range(len(v))] * copies[i]) for i, v in ids.items()}
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE
    assert packing.pack(nothing, path).count() == 0


def test_word_tokens_match_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, made = Tokenizer.from_file(path), packing.WordTokens(open(path, encoding="utf-8").read())
    draw = random.Random(2)
    texts = ["".join(draw.choice("abC 'sLl\tÉß½²1_-!\x85\xa0żİΣ日é<|>") for _ in range(40)) for _ in range(400)] + ["<|endoftext|> x<|startoftext|>", ""]
    for t, got in zip(texts, made.texts(pa.array(texts))):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_shortest_pack_first_keeps_the_histogram():
    draw = random.Random(3)
    for _ in range(100):
        size = draw.choice([8, 16, 64, 4096])
        histogram = {draw.randint(1, size): draw.randint(1, 200) for _ in range(draw.randint(1, 30))}
        got = collections.Counter()
        for count, lengths in packing.shortest_pack_first(histogram, size):
            assert sum(lengths) <= size
            for n in lengths:
                got[n] += count
        assert got == histogram


# --- top-k ---------------------------------------------------------------

def test_dual_search_matches_brute_force():
    draw = np.random.default_rng(0)
    for n, dim in ((1, 3), (40, 2), (700, 3), (2000, 8)):
        data = draw.integers(-130, 130, (n, dim))
        if n > 100:
            data[n // 3 : 2 * n // 3] = data[0]
        ids, rows = draw.permutation(n), draw.choice(n, max(1, n // 20), replace=False)
        best = cover_tree.dual_search(data[rows], ids[rows], data, ids, 5)
        for j, i in enumerate(rows):
            want = sorted((-int(s), int(v)) for s, v in zip(data @ data[i], ids) if v != ids[i])[:5]
            assert [(-s, v) for s, v in zip(best.score[j].tolist(), best.id[j].tolist()) if s != cover_tree.NONE] == want


def test_top_k_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.5]), (50, [0.5, 0.5]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 1.0, 1.0]), (None, [9.0, 9.0]), (100, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("block", F.lit("x")).withColumn("id", F.lit(1))
    for block_rows in (8192, 2):
        got = cover_tree.top_k(df, F.col("vec_id") % 50 == 0, block_rows=block_rows).collect()
        own = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got}
        assert own[0, 1] == (1, 65536) and own[0, 2] == (2, 65536) and own[0, 3] == (50, 49152)
        assert own[50, 1] == (0, 49152) and own[50, 2] == (1, 32768) and len(own) == 6
    assert cover_tree.top_k(df.where("false"), F.lit(True)).count() == 0


# --- repeated passages ---------------------------------------------------

def test_repeated_passages(spark, docs, nothing):
    draw = random.Random(4)
    fresh = lambda n: [f"w{draw.getrandbits(40)}" for _ in range(n)]
    shared = fresh(51)
    rows, holders = [], set()
    for i in range(120):
        body = fresh(draw.randint(60, 200))
        if i % 3 == 0:
            at = draw.randint(0, len(body))
            body[at:at] = shared if i % 2 else [*shared, *fresh(1)]
            holders.add(i)
        rows.append((i, draw.choice([" ", "\n", "  "]).join(body)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.repeated_passages(df).collect()
    assert {r["doc_id"] for r in got} == holders - {0} and {r["keep_doc_id"] for r in got} <= holders
    texts = dict(rows)
    for r in got:
        own = texts[r["doc_id"]][r["start"] : r["stop"]].split()
        assert len(own) == r["n_words"] >= substring_dedup.REPORTED
        assert own == texts[r["keep_doc_id"]].split()[r["keep_word"] : r["keep_word"] + r["n_words"]]
    got = {(r["doc_id"], r["keep_doc_id"]) for r in substring_dedup.repeated_passages(docs).collect()}
    assert got == {(7, 6)}
    assert substring_dedup.repeated_passages(nothing).count() == 0


# --- toxicity ------------------------------------------------------------

def toxic_rows():
    draw = random.Random(6)
    calm = ["the", "river", "of", "and", "stone", "light", "green", "walk", "house", "tree", "soft", "rain", "moss", "lake"]
    rows, labels = [], []
    for i in range(600):
        own = [draw.choice(calm) for _ in range(draw.randint(5, 60))]
        bad = i % 4 == 0
        if bad:
            own[draw.randrange(len(own))] = draw.choice(["vexgrub", "snorpig"]) + draw.choice(["", "s", "ling", "!!"])
        rows.append((i, " ".join(own)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_learns_and_generalises(spark, docs, nothing):
    rows, labels = toxic_rows()
    table = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(table.where("doc_id % 5 > 0"), marks)
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(table, model).collect()}
    wrong = sum((got[i] >= 0.5) != bool(y) for i, y in labels if i % 5 == 0)
    assert wrong <= 2
    scored = toxicity.toxicity(docs, model).collect()
    assert len(scored) == len(ROWS) and all(0 <= r["score"] <= 1 for r in scored)
    assert all(r["score"] == 0 for r in scored if r["doc_id"] in (3, 4, 5))
    assert toxicity.drop_toxic(docs, model).columns == docs.columns
    assert toxicity.toxicity(nothing, model).count() == 0
    again = toxicity.fit(table.where("doc_id % 5 > 0"), marks)
    assert {r["doc_id"]: r["score"] for r in toxicity.toxicity(table, again).collect()} == got


def test_toxicity_without_both_classes(spark, docs, nothing):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.toxicity(docs, toxicity.fit(docs, none)).collect()} == {0.0}
    ones = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.toxicity(docs, toxicity.fit(docs, ones)).collect()} == {1.0}


def test_toxicity_is_fitted_in_a_task(spark, docs, monkeypatch):
    here = os.getpid()
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: toxicity.ToxicityModel(None, constant=float(os.getpid() == here)))
    marks = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.fit(docs, marks).constant == 0.0  # the driver keeps neither the texts nor the memory of the fit


def test_windows_cover_all_words():
    sizes = np.array([0, 1, 12, 13, 100, 0, 20])
    text, first, length = toxicity.windows(sizes)
    seen = collections.Counter()
    for t, f, n in zip(text, first - (np.cumsum(sizes) - sizes)[text], length):
        assert 0 < n <= toxicity.WINDOW
        seen.update((t, p) for p in range(f, f + n))
    assert set(seen) == {(t, p) for t, n in enumerate(sizes) for p in range(n)}


def test_network_gradient():
    net = toxicity.Network(1)
    found = toxicity.features(["alpha", "beta", "gamma"])
    at = np.array([[0, 1], [2, 0], *[[3, 3]] * (toxicity.WINDOW - 2)])
    real = np.array([[1, 1], [1, 1], *[[0, 0]] * (toxicity.WINDOW - 2)], np.float32)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["v"] *= 3
    gates = net.gates(net.inputs(found).astype(np.float64))
    logit, kept = net.forward(gates, at, real, keep=True)
    g, _ = net.backward(gates, at, real, kept, np.ones(2))
    for name in ("Uf", "Ub", "A", "a", "v", "o"):
        k = tuple(0 for _ in net.p[name].shape)
        base = net.p[name][k]
        ends = []
        for step in (1e-3, -1e-3):
            net.p[name][k] = base + step
            ends.append(float(net.forward(gates, at, real).sum()))
        net.p[name][k] = base
        assert (ends[0] - ends[1]) / 2e-3 == pytest.approx(float(g[name][k]), abs=2e-3)


# --- secrets -------------------------------------------------------------

def secret_rows():
    draw = random.Random(8)
    rand = lambda alphabet, n: "".join(draw.choice(alphabet) for _ in range(n))
    rows = []
    for i in range(300):
        kind = i % 5
        value = [rand("0123456789abcdef", 40), "AKIA" + rand("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), "understandingly" + rand("aeiou", 4), rand("0123456789", 16), rand("0123456789abcdef", 40)][kind]
        text = [f'the token = "{value}" here', f"see {value} there", f"an {value} word", f"card {value} paid", f"commit {value} fixed"][kind]
        rows.append((i, text, "conf/app.env" if kind < 2 else "docs/readme.md", int(kind < 2)))
    return rows


def test_secret_forest(spark, docs, nothing):
    rows = secret_rows()
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, y int")
    context = secrets.Context(secrets.pair_counts(table), secrets.dictionary(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    findings = secrets.labelled(secrets.find(table.where("doc_id % 7 > 0")))
    model = secrets.fit(findings, context)
    got = {r["doc_id"]: r["is_secret"] for r in secrets.scan(table, model).collect()}
    assert all(got[i] == bool(y) for i, _, _, y in rows)
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(table, model).collect()}
    assert all(("[SECRET]" in clean[i]) == bool(y) and (y or clean[i] == t) for i, t, _, y in rows)
    assert {r["doc_id"] for r in secrets.scan(docs, model).collect() if r["is_secret"]} == {10}
    redacted = secrets.redact(docs, model)
    assert redacted.columns == docs.columns and redacted.count() == len(ROWS)
    assert secrets.scan(nothing, model).count() == 0
    constant = secrets.fit(findings.where("label = 0"), context)
    assert not any(r["is_secret"] for r in secrets.scan(table, constant).collect())


# --- main text -----------------------------------------------------------

PAGE = """<html><head><title>x</title></head><body><header><h1>Site</h1></header><div id="nav"><a href=1>a, b, c</a></div>
<div class="cookie-notice"><p>We use cookies, and so on, and on, to track you, and more, much more, indeed more.</p></div>
<div class="wrap"><div class="content"><h2>Title &eacute;</h2><p>First para, with   commas,<br>and more &lt;tags&gt;.</p>
<div class="advert"><p>Buy, buy, buy now, it is cheap, cheap.</p></div><ul><li>one</li><li>two</li></ul><p>Second para</p></div>
<div class="sidebar"><p>Side, side, side</p></div></div><section id="comments"><p>I think, therefore, comment, yes, ok, blah.</p></section>
<form><p>name</p><input name=x></form><footer>c</footer><script>if (a<b) {"</p>"}</script></body></html>"""


def test_main_text(spark):
    want = "Title é\n\nFirst para, with commas, and more <tags>.\n\none\n\ntwo\n\nSecond para"
    assert html_text.main_text(PAGE) == want
    assert html_text.main_text("plain &amp; text") == "plain & text"
    assert html_text.main_text("<p>a<p>b < c") == "a\n\nb < c"
    assert html_text.main_text("<div>" * 20_000 + "deep") == "deep"
    assert html_text.main_text("<" * 50_000) in ("", "<" * 50_000)
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "v", ""), (None, "w", "<p>x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = collections.Counter(map(tuple, html_text.extract(pages).collect()))
    assert got == collections.Counter([(1, "u", want, len(want))] * 2 + [(2, None, "", 0), (3, "v", "", 0), (None, "w", "x", 1)])
    assert html_text.extract(pages.where("false")).count() == 0


BODY = "<p>First paragraph, with commas, and more words, for a while.</p><p>Second paragraph, also with commas, and some words.</p>"
SAID = "First paragraph, with commas, and more words, for a while.\n\nSecond paragraph, also with commas, and some words."
ASIDE = "<div class='sidebar'><p>Side, side, side.</p></div>"


def test_main_text_keeps_figures_and_formulas():
    page = f"<body><article>{BODY}<figure><table><tr><td>a</td><td>b</td></tr></table><blockquote>said</blockquote><figcaption>Caption</figcaption></figure><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math>.</p></article></body>"
    assert html_text.main_text(page) == SAID + "\n\na b\n\nsaid\n\nCaption\n\nSo x=2."


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "page has-sidebar", "no-comments", "with-header", "post sidebar-left", "hasSidebar"])
def test_main_text_inside_containers_named_for_their_surroundings(name):
    for body in (BODY, f"<article>{BODY}</article>", f"<main>{BODY}</main>"):
        page = f"<body><div class='{name}'>{body}</div>{ASIDE}<div><p>Elsewhere</p></div></body>"
        assert html_text.main_text(page) == SAID


def test_main_text_weighs_doubtful_containers():
    assert html_text.main_text(f"<body><div class='sidebar-layout'><main>{BODY}</main></div>{ASIDE}</body>") == SAID
    assert html_text.main_text(f"<body><div class='widget'>{BODY}</div></body>") == SAID  # nothing else is left
    comments = "<section class='comments'><article class='comment'><p>I, too, think so.</p></article><article><p>And I, I do not.</p></article></section>"
    for more in (comments, "<div class='post-comments'><p>Well, yes, and no, and so on.</p></div>", "<div class='related-posts'><article><p>Other, other.</p></article></div>"):
        assert html_text.main_text(f"<body><article>{BODY}{more}</article></body>") == SAID
        assert html_text.main_text(f"<body><div class='content'>{BODY}{more}</div></body>") == SAID or "<article>" in more
