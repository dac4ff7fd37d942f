"""Classifiers, top-k search, secrets, decontamination and URL rules against plain versions."""

import random
import re
import string
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserae.llm import decontaminate, quality, secrets, topk, toxicity, url_filter
from tesserae.llm.catalog import QUERIES

from .test_text import ODD, docs

MID = "/root/testdata/sf0.01"


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def auc(pairs):
    ones, zeros = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros])


# -- classifiers


@pytest.mark.parametrize("name,label,n,held,threshold", [("op5_toxicity", "toxic", 3, 1, 0.7), ("op9_quality", "quality", 5, 0, 0.3)])
def test_held_out_accuracy(spark, name, label, n, held, threshold):
    got = {r.doc_id: r for r in QUERIES[name](spark, MID).collect()}
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{MID}/labels.parquet").collect()}
    assert len(got) == 1000 and all(r.held_out == (fold(i, n) == held) and 0 <= r.score <= 1 and r.predicted == (r.score >= threshold) for i, r in got.items())
    pairs = [(got[i].score, y) for i, y in labels.items() if got[i].held_out]
    # 34 of the 266 labelled texts that toxicity learns from here are toxic, in four languages
    assert auc(pairs) > (0.9 if label == "toxic" else 0.97) and np.mean([(s >= threshold) == bool(y) for s, y in pairs]) > 0.93


def test_toxicity_of_odd_rows(spark):
    df = docs(spark, ODD)
    train = docs(spark, [(i, f"plain words number {i} " + ("foulword" if i % 3 == 0 else "")) for i in range(60)], False)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(5, None), (None, 1), (999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(train, labels, F.lit(True))
    rows = toxicity.score(df, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.toxicity <= 1 for r in rows)
    one = model.scores(pa.array(["a foulword here", "FOULWORD", "nothing", "foul wo rd", None]))
    assert one[0] > 0.7 and one[1] > 0.7 and one[2] < 0.3 and one[4] == one[4]
    kept = toxicity.drop_toxic(train.withColumn("lang", F.lit("x")), labels)
    assert kept.columns == ["doc_id", "text", "lang"] and sorted(r.doc_id for r in kept.collect()) == [i for i in range(60) if i % 3]
    assert toxicity.score(df.limit(0), model).collect() == []


@pytest.mark.parametrize("labels,want", [([], 0.0), ([(1, 0)], 0.25), ([(1, 1)], 0.75)])
def test_toxicity_without_two_labels(spark, labels, want):
    df = docs(spark, [(1, "a"), (2, "b")], False)
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
    assert model.scores(pa.array(["zzz"]))[0] == pytest.approx(want, abs=1e-6)


def test_scores_do_not_depend_on_neighbours(spark):
    """A row's score is that of its text alone: n-grams do not reach into the next row."""
    texts = ["abc", "def", "abcdef", "", "abc def"]
    rows = docs(spark, list(enumerate(["abcdef"] * 5 + ["xyz"] * 5)), False)
    model = toxicity.fit(rows, spark.createDataFrame([(i, int(i < 5)) for i in range(10)], "doc_id long, toxic int"), F.lit(True))
    assert np.allclose(model.scores(pa.array(texts)), [model.scores(pa.array([t], pa.string()))[0] for t in texts])


def plain_toxicity(rows):
    """The scorer that the classifier must be: n-grams as strings, one weight each, learned by the same steps."""
    grams = lambda t: {t[i : i + n] for n in toxicity.ORDERS for i in range(len(t) - n + 1)}
    low = lambda t: re.sub("[\t-\r]", " ", (t or "").lower())
    y = np.array([label for _, label in rows], float)
    ones, zeros = int(y.sum()), int(len(y) - y.sum())
    sets = [grams(low(t)) for t, _ in rows]
    p = Counter(g for s, k in zip(sets, y) if k for g in s)
    q = Counter(g for s, k in zip(sets, y) if not k for g in s)

    def llr(g):
        part = lambda k, n: k * np.log(f := min(max(k / n, 1e-9), 1 - 1e-9)) + (n - k) * np.log(1 - f)
        return part(p[g], ones) + part(q[g], zeros) - part(p[g] + q[g], ones + zeros)

    kept = sorted((g for g in p | q if p[g] + q[g] >= toxicity.MIN_ROWS), key=llr, reverse=True)
    assert len(kept) <= toxicity.FEATURES  # so that no tie decides
    r = np.array([np.log((p[g] + 0.5) / (ones + 1)) - np.log((q[g] + 0.5) / (zeros + 1)) for g in kept])
    x = np.array([[g in s for g in kept] for s in sets], float) * r
    w, bias, m, v = np.full(len(kept), 0.01), np.log((ones + 0.5) / (zeros + 0.5)), 0.0, 0.0
    for t in range(1, 301):
        err = 1 / (1 + np.exp(-(x @ w + bias))) - y
        grad = np.append(x.T @ err / len(y) + toxicity.RIDGE * w / len(y), err.mean())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return lambda t: 1 / (1 + np.exp(-(np.array([g in grams(low(t)) for g in kept], float) * r @ w + bias)))


@pytest.mark.parametrize("held", [2_000_000, 50])
def test_toxicity_is_the_plain_classifier(spark, monkeypatch, held):
    monkeypatch.setattr(toxicity, "_HELD", held)
    rnd = random.Random(6)
    words = ["calm", "Words", "über", "plain", "vile", "rotten", "thing", "\n"]
    rows = []
    for i in range(80):
        bad = rnd.random() < 0.4
        rows.append((i, " ".join(rnd.choice(words[:4] + words[6:] + (words[4:6] * 2 if bad else [])) for _ in range(rnd.randrange(1, 6))), int(bad)))
    want = plain_toxicity([(t, k) for _, t, k in rows])
    model = toxicity.fit(docs(spark, [(i, t) for i, t, _ in rows], False), spark.createDataFrame([(i, k) for i, _, k in rows], "doc_id long, toxic int"), F.lit(True))
    texts = ["vile thing", "calm words", "", "ROTTEN\tthing über", "nothing known"] + [t for _, t, _ in rows[:20]]
    assert np.allclose(model.scores(pa.array(texts)), [want(t) for t in texts], atol=1e-6)


def test_samples_are_bounded_in_rows(spark):
    """An id that has thousands of rows is one row of a sample, the least one."""
    df = docs(spark, [(1, f"text {i:05d}") for i in range(20_000)] + [(2, "b"), (3, None), (None, "c")])
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (3, 0), (None, 1), (9, 1)], "doc_id long, toxic int")
    got = toxicity.labelled_sample(df.select("doc_id", "text"), labels, "toxic", F.lit(True), 100).collect()
    assert sorted((r.doc_id, r.text, r._label) for r in got) == [(1, "text 00000", 0), (2, "b", 1), (3, None, 1)]
    assert toxicity.labelled_sample(df.select("doc_id", "text"), labels, "toxic", F.lit(True), 2).count() <= 2


def plain_boosting(m, y, rounds, pair_rounds):
    """Cyclic boosting of lookup tables and of pairs' tables, entry by entry."""
    n, k = m.shape
    best_cut = lambda g, h: max(((sum(g[:c]) ** 2 / (sum(h[:c]) + 1) + sum(g[c:]) ** 2 / (sum(h[c:]) + 1) - sum(g) ** 2 / (sum(h) + 1), -c) for c in range(1, len(g))), default=(0.0, 0))

    def tree(g, h):
        leaves = [list(range(len(g)))]
        for _ in range(2):
            gain, cut, leaf = max(((*best_cut([g[i] for i in leaf], [h[i] for i in leaf]), leaf) for leaf in leaves), key=lambda o: (o[0], -o[1], o[2][0]))
            if gain <= 1e-9:
                break
            leaves.remove(leaf)
            leaves += [leaf[:-cut], leaf[-cut:]]
        return {i: -sum(g[j] for j in leaf) / (sum(h[j] for j in leaf) + 1) for leaf in leaves for i in leaf}

    def sums(cell, size):
        g, h = [0.0] * size, [0.0] * size
        for i in range(n):
            p = 1 / (1 + np.exp(-z[i]))
            g[cell[i]] += p - y[i]
            h[cell[i]] += p * (1 - p)
        return g, h

    z = np.full(n, np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    bins, cells = ([np.searchsorted(np.unique(np.quantile(m[:, f], np.arange(1, b) / b)), m[:, f], "right").tolist() for f in range(k)] for b in (quality.BINS, quality.GRID))
    for _ in range(rounds):
        for f in range(k):
            t = tree(*sums(bins[f], max(bins[f]) + 1))
            z = z + quality.RATE * np.array([t[b] for b in bins[f]])
    size = quality.GRID
    gain = {}
    for f in range(k):
        for e in range(f + 1, k):
            g, h = sums([a * size + b for a, b in zip(cells[f], cells[e])], size * size)
            gain[f, e] = sum(a * a / (b + 1) for a, b in zip(g, h))
    pairs = sorted(gain, key=lambda p: (gain[p], p), reverse=True)[: quality.PAIRS]
    for _ in range(pair_rounds):
        for f, e in pairs:
            g, h = (np.array(x).reshape(size, size) for x in sums([a * size + b for a, b in zip(cells[f], cells[e])], size * size))
            halves = lambda at: ((0, at), (at, size))
            value = lambda at: sum(max(best_cut(g[a:b].sum(0).tolist(), h[a:b].sum(0).tolist())[0], -1e18) + g[a:b].sum() ** 2 / (h[a:b].sum() + 1) for a, b in halves(at))
            at = max(range(1, size), key=value)
            step = np.zeros((size, size))
            for a, b in halves(at):
                t = tree(g[a:b].sum(0).tolist(), h[a:b].sum(0).tolist())
                step[a:b] = [t[j] for j in range(size)]
            z = z + quality.RATE * step[cells[f], cells[e]]
    return z


def test_quality_is_the_plain_boosting(monkeypatch):
    monkeypatch.setattr(quality, "ROUNDS", 6)
    monkeypatch.setattr(quality, "PAIR_ROUNDS", 4)
    rng = np.random.default_rng(2)
    m = rng.random((150, 4))
    y = ((m[:, 0] + 0.5 * (m[:, 1] > 0.5) * (m[:, 2] > 0.4) + 0.3 * rng.random(150)) > 0.8).astype(float)
    assert np.allclose(quality.train(m, y).logits(m), plain_boosting(m, y, 6, 4), atol=1e-9)


def test_quality_features():
    texts = ["The THE the the.", None, "", "a\nb\na\n\nb c", "1! | é", "x" * 100_000]
    m = np.concatenate(list(quality.features(pa.array(texts))))
    at = quality.FEATURES.index
    assert m.shape == (6, len(quality.FEATURES)) and not m[1].any() and not m[2].any()
    assert m[0, at("distinct_words")] == 1 and m[0, at("log_words")] == pytest.approx(np.log(5)) and m[0, at("upper")] == pytest.approx(4 / 12)
    assert m[3, at("repeated_lines")] == 0.25 and m[3, at("line_words")] == 1.25
    together, alone = m, np.concatenate([next(iter(quality.features(pa.array([t], pa.string())))) for t in texts])
    assert np.allclose(together, alone)


def test_quality_learns_a_pair():
    rng = np.random.default_rng(1)
    m = rng.random((4000, len(quality.FEATURES)))
    y = (m[:, 0] > 0.5) ^ (m[:, 1] > 0.5)
    model = quality.train(m, y)
    assert np.mean((model.logits(m) > 0) == y) > 0.9 and (0, 1) in [p for p, *_ in model.pairs]


def test_quality_of_odd_rows(spark):
    featured = quality.with_features(docs(spark, ODD))
    model = quality.fit(featured, spark.createDataFrame([(4, 1), (9, 0), (4, 0), (None, 1)], "doc_id long, quality int"), F.lit(True))
    rows = quality.score(featured, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    nothing = quality.fit(featured, spark.createDataFrame([], "doc_id long, quality int"), F.lit(True))
    assert all(r.score == 0.5 for r in quality.score(featured, nothing).collect()) and quality.score(featured.limit(0), model).collect() == []


# -- top-k search


@pytest.mark.parametrize("blocks", [(512, 4096, 32_000_000), (2, 3, 100)])
@pytest.mark.parametrize("scale", [64.0, 1e6, 1e9])
def test_top_k(spark, monkeypatch, blocks, scale):
    for name, value in zip(("QUERY_BLOCK", "ROW_BLOCK", "QUERY_BYTES"), blocks):
        monkeypatch.setattr(topk, name, value)
    rnd = random.Random(4)
    vs = [[rnd.choice([-1.0, 0.0, 0.25, 0.5, 1.0]) for _ in range(6)] for _ in range(40)] + [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(40)]
    vs[3], vs[4], vs[5], vs[6], vs[7] = None, [1.0, None], [float("nan")] * 6, [float("inf")] + [0.0] * 5, [2.0, 1.0]
    df = spark.createDataFrame(list(enumerate(vs)), "id long, x array<double>").withColumn("v", topk.quantised(F.col("x"), scale))
    ints = {i: [int(np.floor(scale * y)) for y in v] for i, v in enumerate(vs) if i not in (3, 4, 5, 6)}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    want = []
    for q in sorted(i for i in ints if i % 20 == 0):
        ranked = sorted((-dot(ints[q], ints[c]), c) for c in ints if c != q)[:7]
        want += [(q, k, c, -s) for k, (s, c) in enumerate(ranked, 1)]
    got = topk.search(df.filter("id % 20 = 0"), df, 7).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == want


def test_top_k_of_few(spark):
    df = spark.createDataFrame([(0, [1]), (1, [2]), (2, None), (20, [-3])], "id long, v array<long>")
    got = sorted(map(tuple, topk.search(df.filter("id % 20 = 0"), df, 20).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == [(0, 1, 1, 2), (0, 2, 20, -3), (20, 1, 0, -3), (20, 2, 1, -6)]
    assert topk.search(df.limit(0), df, 3).collect() == [] and topk.search(df, df.limit(0), 3).collect() == []


def test_top_k_of_large_components(spark):
    """No finite component is refused; scores beyond 64 bits rank exactly and are shown as the nearest long."""
    vs = [[2e6, 1.0], [-2e6, 3.0], [2e6, 2.0], [1e300, 1.0], [1e300, 2.0], [-1e300, 0.5], [5e9, 5e9], [-1.0, 1e-30]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vs)], "id long, x array<double>").withColumn("v", topk.quantised(F.col("x")))
    ints = [[int(y * 64) if y * 64 == int(y * 64) else int(np.floor(y * 64)) for y in v] for v in vs]
    want = []
    for q in range(len(vs)):
        ranked = sorted((-sum(x * y for x, y in zip(ints[q], ints[c])), c) for c in range(len(vs)) if c != q)[:5]
        want += [(q, k, c, max(-(1 << 63), min((1 << 63) - 1, -s))) for k, (s, c) in enumerate(ranked, 1)]
    assert sorted(map(tuple, topk.search(df, df, 5).collect())) == want


def test_the_threshold_ends_lists_early(monkeypatch):
    """Phase two scores far fewer entries than there are, and phase one a share of them."""
    rng = np.random.default_rng(3)
    c = np.floor(rng.normal(size=(4000, 32)) * np.exp(rng.normal(size=(4000, 1))) * 64)
    batch = pa.record_batch({"id": pa.array(np.arange(4000)), "v": pa.array(c.tolist())})
    shared = type("Shared", (), {"value": (np.arange(0, 4000, 200), c[::200])})
    resolved, plain = [], topk._Block.resolve
    monkeypatch.setattr(topk._Block, "resolve", lambda self, q, a, b: resolved.append(len(a)) or plain(self, q, a, b))
    low = next(topk._bounds(shared, 20)([batch]))
    cuts = type("Shared", (), {"value": (np.array([s[-1] for s in low.column("scores").to_pylist()]), np.ones(20, bool))})
    got = next(topk._entries(shared, cuts, 20)([batch]))
    assert got.num_rows == 400 and sum(resolved) < 0.1 * 20 * 4000
    for q in range(0, 4000, 200):
        best = sorted(((-int(c[q] @ c[j]), j) for j in range(4000) if j != q))[:20]
        assert sorted(v for i, v in zip(got.column("query_id").to_pylist(), got.column("vec_id").to_pylist()) if i == q) == sorted(j for _, j in best)


# -- secrets


def plain_spans(text):
    out = []
    for m in re.finditer(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[1]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    rest = list(text)
    for a, _, b in out:
        rest[a:b] = " " * (b - a)
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", "".join(rest)):
        s = m[0]
        if re.search(secrets.ALLOWED, s):
            continue
        bits = secrets.HEX_BITS if re.fullmatch("[0-9a-fA-F]+", s) else secrets.ALNUM_BITS if s.isalnum() else secrets.MIXED_BITS
        hits = []
        for i in range(len(s) - 19):
            share = [s[i : i + 20].count(c) / 20 for c in set(s[i : i + 20])]
            if -sum(p * np.log2(p) for p in share) >= bits:
                hits.append(i)
        if hits:
            out.append((m.start() + hits[0], 3, m.start() + hits[-1] + 20))
    return sorted(out)


def secret_texts():
    rnd = random.Random(8)
    pieces = ["password=", "Token : ", 'api_key":"', "APIKEY =", "secret: ab", "AKIA", "é", "\n", " ", "deadbeef" * 4, "passwd", "=", "'", "x", "EXAMPLE", "SECRET=secret=abcdefgh", "\U0001f600"]
    out = []
    for _ in range(150):
        parts = []
        for _ in range(rnd.randrange(12)):
            kind = rnd.randrange(5)
            size = rnd.randrange(4, 50)
            alphabet = ["0123456789abcdef", string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "+/=_-", string.ascii_lowercase, "01"][kind]
            parts.append(rnd.choice(pieces) if rnd.random() < 0.6 else "".join(rnd.choice(alphabet) for _ in range(size)))
        out.append("".join(parts))
    return out


def test_secrets(spark):
    rows = ODD + [(100 + k, t) for k, t in enumerate(secret_texts())]
    got = sorted(((r.doc_id, r.text, [tuple(s) for s in r.secret_spans]) for r in secrets.scan_secrets(docs(spark, rows)).collect()), key=str)
    assert got == sorted(((i, t, plain_spans(t or "")) for i, t in rows), key=str)
    clean = {(r.doc_id, r.text) for r in secrets.redact(docs(spark, rows)).collect()}
    for i, t in rows:
        spans, merged = plain_spans(t or ""), []
        for a, _, b in spans:
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        want, at = "", 0
        for a, b in merged:
            want, at = want + t[at:a] + "[SECRET]", b
        assert (i, want + t[at:] if spans else t) in clean
    assert secrets.digest(docs(spark, [])).collect() == []


def test_many_and_long_secrets(spark):
    """One candidate of 200,000 characters, and texts of 20,000 matches, in time linear in them."""
    rnd = random.Random(3)
    draw = lambda alphabet, n: "".join(rnd.choice(alphabet) for _ in range(n))
    mixed = draw(string.ascii_letters + string.digits + "+/=_-", 200_000)
    many = " ".join("é AKIA" + draw(string.ascii_uppercase + string.digits, 16) + rnd.choice(["", "/" + draw(string.ascii_letters, 9) + "7q3" * 4]) for _ in range(20_000))
    tokens = " ".join("token=" + draw("0123456789abcdef", rnd.choice([5, 12, 40])) for _ in range(5000))
    texts = {1: mixed, 2: many, 3: tokens}
    began = time.monotonic()
    got = {r.doc_id: r for r in secrets.scan_secrets(docs(spark, list(texts.items()), False)).collect()}
    assert time.monotonic() - began < 60
    clean = {r.doc_id: r.text for r in secrets.redact(docs(spark, list(texts.items()), False)).collect()}
    for i, t in texts.items():
        if i != 1:  # the plain version counts each window anew
            assert [tuple(s) for s in got[i].secret_spans] == plain_spans(t)
    (a, kind, b) = got[1].secret_spans[0]
    assert len(got[1].secret_spans) == 1 and kind == 3 and a < 50 and b > 199_950
    assert clean[1] == mixed[:a] + "[SECRET]" + mixed[b:] and clean[2].count("[SECRET]") >= 20_000 and clean[3].count("[SECRET]") == len({(s[0], s[2]) for s in got[3].secret_spans if s[1] == 0})


def test_long_candidates_of_short_parts(spark):
    """Candidates that the allow-list takes as a path, a hundred thousand parts long."""
    texts = {1: "a1/" * 100_000, 2: "ab1-" * 50_000, 3: "x " + "a1/" * 9, 4: "a1/" * 50_000 + "q7Zk2Wm9Xc4Vb8Nl3Tr6"}
    got = {r.doc_id: [tuple(s) for s in r.secret_spans] for r in secrets.scan_secrets(docs(spark, list(texts.items()), False)).collect()}
    assert got[1] == got[2] == got[3] == [] == plain_spans(texts[3])
    assert len(got[4]) == 1 and got[4][0][2] == len(texts[4])


def test_no_python_in_native_plans(spark, sf):
    for name in ("op7_secrets", "op10_urls"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# -- decontamination


def plain_distance(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(item, 1):
            new.append(min(row[i - 1] + (p != c), row[i] + 1, new[i - 1] + 1))
        row = new
        best = min(best, row[-1])
    return best


def edited(rnd, text, n):
    t = list(text)
    for _ in range(n):
        i = rnd.randrange(len(t))
        t[i : i + 1] = rnd.choice([[], [rnd.choice("abc ")], [t[i], rnd.choice("abc")]])
    return "".join(t)


@pytest.mark.parametrize("seed", range(6))
def test_myers_distance(seed):
    rnd = random.Random(seed)
    for _ in range(30):
        item, text = "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 90))), "".join(rnd.choice("abc") for _ in range(rnd.randrange(150)))
        assert decontaminate.distance(item, text, len(item)) == plain_distance(item, text)


@pytest.mark.parametrize("block", [4_000_000, 200])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
    rnd = random.Random(2)
    sentence = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 9))) for _ in range(n))
    items = [(k, sentence(25).capitalize() + ".") for k in range(6)] + [(50, None), (None, "some item text"), (51, " .,! "), (52, "tiny")]
    rows = list(ODD)
    for k in range(40):
        n = rnd.choice([0, 0, 3, 6, 9, 12, 15, 40])
        rows.append((200 + k, sentence(30) + ", " + edited(rnd, items[k % 6][1], n).upper() + "\n" + sentence(10)))
    got = {(r.doc_id, r.text): dict(zip(r.item_ids, r.distances)) for r in decontaminate.find_leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(got) == len({*rows})
    normal = {i: decontaminate.normalise(t) for i, t in items if i is not None and t and decontaminate.normalise(t)}
    for i, t in rows:
        if t is None or len(t) < 5000:
            text = decontaminate.normalise(t)
            want = {j: d for j, s in normal.items() if (d := plain_distance(s, text)) <= decontaminate.budget(s)}
            assert got[i, t] == want
    kept = decontaminate.drop_leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == docs(spark, rows).columns and kept.count() == sum(not v for v in got.values()) + len(rows) - len({*rows})


def test_planted_items(spark):
    got = {r.doc_id: set(r.item_ids) for r in QUERIES["op8_decontaminate"](spark, MID).collect()}
    items = {r.item_id: decontaminate.normalise(r.text) for r in spark.read.parquet(f"{MID}/benchmark.parquet").collect()}
    for r in spark.read.parquet(f"{MID}/documents.parquet").collect():
        text = decontaminate.normalise(r.text)
        assert {i for i, s in items.items() if s in text} == got[r.doc_id]


# -- urls


def plain_rule(host, path):
    best = None
    for h, p, verdict in (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")):
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return best


URLS = [
    None, "", "no scheme", "http://", "HTTP://Example.NET/en/x", "https://a.example.net/EN/", "x://example.net", "x://net/", "x://net?/", "x://b.com/de/", "x://example.com/de/1?q#f", "x://notexample.com/de/", "a://b://c/d",
    "x://m.org/fr/", "x://m.org/fr", "x://casino-win.example.org/fr/1", "x://www.casino-win.example.com/en/1", "x://mycasinos.com/", "x://ads.example.com/", "x://heads.example.com/", "x://cheap-pills.com", "x://pills-cheap.com/",
    "x://É.example.net/", "x://a.com/casino", "x://free-bets.io/a#b?c", "x://example.netx/en/", "x://user@example.net/en/",
]


URLS += [
    "x://adult-education.org.uk/x", "x://adult.example.com/", "x://a.com/affiliate/x", "x://a.com/xaffiliate/x", "x://a.com/x?q=1&AFFID=2", "x://a.com/x?paffid=2", "x://best-pills24.com/", "http://10.0.0.1:8080/x", "x://casino.com/about/responsible-gambling",
]


def plain_verdict(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)(\?[^#]*)?", url or "")
    lower = lambda t: re.sub("[A-Z]", lambda x: x[0].lower(), t)
    host, path, key = (lower(m[1]), m[2], lower(m[1]) + m[2] + lower(m[3] or "")) if m else ("", "", "")
    hits = [r for r in rules if re.search(r.pattern, key)]
    verdict = "allow" if any(r.layer == 1 for r in hits) else "block" if any(r.layer == 2 for r in hits) else "allow"
    return host, path, *(plain_rule(host, path) or (None, verdict))


@pytest.mark.parametrize("size", [1_000_000, 0])
def test_urls(spark, monkeypatch, size):
    """As a map in the plan and as a table, the rules give what trying each of them gives."""
    monkeypatch.setattr(url_filter, "INDEX_BYTES", size)
    df = spark.createDataFrame(list(enumerate(URLS)) + [(3, URLS[3])], "page_id long, url string").selectExpr("*", "'h' as host", "1 as verdict", "2 as _first", "3 as name", "4 as token")
    got = url_filter.filter_urls(df)
    assert len(got.collect()) == len(URLS) + 1 and not re.search("Python|Arrow", got._jdf.queryExecution().executedPlan().toString())
    for r in got.collect():
        assert (r.host, r.path, r.rule, r.verdict) == plain_verdict(r.url, url_filter.METHOD_RULES), r.url
    assert {r.url: r.verdict for r in got.collect()}["x://www.casino-win.example.com/en/1"] == "block" and url_filter.filter_urls(df.limit(0)).collect() == []


@pytest.mark.parametrize("size", [10_000_000, 0])
def test_many_rules_and_rules_without_tokens(spark, monkeypatch, size):
    monkeypatch.setattr(url_filter, "INDEX_BYTES", size)
    rules = [(f"r{k}", f"^host{k}[.]", [f"host{k}"], "block", 2) for k in range(300 if size else 30_000)]
    rules += [("any", "q{3}", None, "block", 2), ("none", "z{3}", [], "block", None), ("bad", None, ["x"], "block", 2), ("odd", "w{3}", [None, ""], "allow", 1)]
    frame = spark.createDataFrame(rules, url_filter.RULES_SCHEMA)
    urls = ["x://host7.com/", "x://host77777.com/", "x://a.com/qqq", "x://a.com/zzz", "x://host1.com/www", "x://x.com/"]
    got = {r.url: r.verdict for r in url_filter.filter_urls(spark.createDataFrame([(u,) for u in urls], "url string"), rules=frame).collect()}
    assert [got[u] for u in urls] == ["block", "allow", "block", "block", "allow", "allow"]
    assert {r.verdict for r in url_filter.filter_urls(spark.createDataFrame([("x://a.b/",)], "url string"), rules=frame.limit(0)).collect()} == {"allow"}


def test_rules_are_filed_under_their_rarest_token(spark):
    df = spark.createDataFrame([("x://common.rare.com/",), ("x://common.com/",)], "url string")
    key = F.concat(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url")))
    rules = [url_filter.Rule("r", "common.*rare", ("common", "rare"), "block"), url_filter.Rule("n", "x", ("common", "none"), "block"), url_filter.Rule("e", "y", (), "block")]
    assert {r.name: r.token for r in url_filter.filed(df, key, url_filter.rules_frame(df, rules)).collect()} == {"r": "rare", "n": "none", "e": url_filter.ANY}
    assert {name: token for token, name, *_ in url_filter.filed_few(df, key, rules)} == {"r": "rare", "n": "none", "e": url_filter.ANY}
