"""HTML extraction, near duplicates, language model and packing against plain versions."""

import html
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tesserae.llm import components, frames, html_text, kernels, lm, near_dup, packing, sketch
from tesserae.llm.catalog import ORACLES, QUERIES, tokenizer_path

from ..oracle import connection, same

ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "ONE"), (6, "a b c d"), (7, "a b c d"), (8, "x" * 200_000), (9, "w " * 50_000), (10, "é \u00a0 ü\u3000z\x0b\x1f a"), (11, "a b c d"), (11, "a b c d"), (None, "a b c d")]


def docs(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("*", "'x' as n", "1 as component_id", "2 as key", "3 as family", "4 as length", "5 as train", "6 as rep") if extra else df


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]


def shingles(text, n=5):
    w = words_of(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


@pytest.mark.parametrize("name", ["op2_neardup", "op6_topk", "op7_secrets", "op10_urls"])
def test_with_sql(spark, sf, name):
    same(QUERIES[name](spark, sf), connection(sf), ORACLES[name])


# -- kernels


def test_word_spans():
    column = pa.array([t for _, t in ODD])
    got = []
    for _, _, buf, off in kernels.slices(column, 1000):
        starts, ends, at = kernels.words(buf, off)
        h = kernels.span_hashes(buf, starts, ends)
        got += [h[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    table = {}
    for (_, t), hashes in zip(ODD, got):
        assert len(hashes) == len(words_of(t))
        for w, h in zip(words_of(t), hashes):
            assert table.setdefault(w, h) == h
    assert len(set(table.values())) == len(table)


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    for size, share in ((3, 0.5), (40, 0.8), (3000, 0.3)):
        base = rng.integers(1, 1 << 60, size, dtype=np.uint64)
        other = np.concatenate([base[: int(size * share)], rng.integers(1, 1 << 60, size - int(size * share), dtype=np.uint64)])
        a, b = sketch.sketches([np.unique(base), np.unique(other)], 1024)
        true = len(np.intersect1d(base, other)) / len(np.union1d(base, other))
        assert abs((a == b).mean() - true) < 0.12 and (a != sketch.EMPTY).all()


# -- near duplicates


def brute_components(rows, threshold=75):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    while True:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            return sets, label


def family_rows(seed, n=120):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for base in range(6):
        text = [rnd.choice(vocabulary) for _ in range(rnd.choice([4, 9, 60, 200]))]
        for k in range(n // 6):
            copy = list(text)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 6, 12])):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            out.append((len(out) * 3 + 1, " ".join(copy).upper() if k % 5 == 0 else " ".join(copy)))
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("blocks", [(300_000, 1000), (400, 4)])
def test_near_duplicates(spark, monkeypatch, blocks):
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", blocks[0])
    monkeypatch.setattr(near_dup, "BLOCK_DOCS", blocks[1])
    rows = family_rows(7)
    sets, label = brute_components(rows)
    got = {r.doc_id: r for r in near_dup.near_duplicates(docs(spark, rows)).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), label[i], label[i] == i) for i in sets}
    kept = near_dup.drop_near_duplicates(docs(spark, rows, extra=False))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in sets if label[i] == i) and kept.columns == ["doc_id", "text"]


def test_bands_find_links_at_the_threshold():
    """Sets of similarity 0.75 share a band but for about one pair in a million; far ones seldom do."""
    rng = np.random.default_rng(7)
    pairs = 4000
    for size, common, most_missed, most_met in ((70, 60, 0, pairs), (7, 6, 0, pairs), (70, 10, pairs, pairs // 10)):
        every = rng.integers(1, 1 << 63, (pairs, 2 * size - common), dtype=np.uint64)
        a, b = (sketch.band_keys(sketch.sketches([np.sort(r) for r in x], near_dup.COORDINATES), near_dup.ROWS) for x in (every[:, :size], every[:, size - common :]))
        met = (a == b).any(1).sum()
        assert pairs - met <= most_missed and met <= most_met


def test_chains_across_blocks(spark, monkeypatch):
    """A family of many blocks and parts: windows over one sequence of words, linked to their neighbours only where they overlap enough."""
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", 300)
    monkeypatch.setattr(near_dup, "BLOCK_DOCS", 3)
    sent = []
    plain = near_dup._routes
    monkeypatch.setattr(near_dup, "_routes", lambda *a: sent.append(plain(*a)) or sent[-1])
    words, rows, at = [f"w{i}" for i in range(2000)], [], 0
    for k in range(60):
        rows.append((k * 7 % 61 + 1, " ".join(words[at : at + 84])))
        at += (5, 10, 14)[k % 3]
    rows = [(i, t) for i, t in rows] + [(100 + k, " ".join(words[k * 80 : k * 80 + 84])) for k in range(20)]
    sets, label = brute_components(rows)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs(spark, rows)).collect()}
    assert got == label and len(set(label.values())) > 5
    blocks = len({r.other for s in sent for r in s.collect()})
    assert sent and sum(s.count() for s in sent) < len(rows) * (blocks - 1)


def test_near_duplicates_of_odd_rows(spark):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs(spark, ODD)).collect()), key=str)
    want = [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 6, False), (8, 1, 8, True), (9, 1, 9, True), (10, 1, 10, True)]
    want += [(11, 1, 6, False), (11, 1, 6, False), (None, 1, None, False)]
    assert got == sorted(want, key=str)
    assert near_dup.near_duplicates(docs(spark, [])).collect() == []


@pytest.mark.parametrize("tasks", [1_000_000, 40])
def test_components(spark, monkeypatch, tasks):
    monkeypatch.setattr(components, "EDGES_PER_TASK", tasks)
    rnd = random.Random(tasks)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000 + i) for i in range(40)] + [(None, 3)]
    label = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(100):
        for a, b in edges:
            if a in label and b in label and a is not None and b is not None:
                label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    assert {r.node: r.label for r in components.components(df).collect()} == label
    assert components.components(df.limit(0)).collect() == []


def test_links_in_column_blocks(monkeypatch):
    monkeypatch.setattr(near_dup, "_CELLS", 1000)
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(25)]
    want = [[100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b)) for b in sets] for a in sets]
    assert near_dup.linked(sets).tolist() == want
    assert near_dup.linked(sets[:10], sets[10:]).tolist() == [row[10:] for row in want[:10]]


# -- language model


@pytest.mark.parametrize("size", [12_000_000, 2000])
def test_language_model(spark, sf, monkeypatch, size):
    monkeypatch.setattr(lm, "CHUNK_BYTES", size)
    monkeypatch.setattr(lm, "ROW_TOKENS", 500)
    df = spark.read.parquet(f"{sf}/documents.parquet").unionByName(docs(spark, [(i and i + 10_000, t) for i, t in ODD if i != 8], False), allowMissingColumns=True)
    rows = [(r.doc_id, words_of(r.text) + [None]) for r in df.collect()]
    train = [w for i, w in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(t for w in train for t in w)
    n, v = sum(c.values()), len(c)
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in lm.score(df).collect()), key=str)
    want = sorted(((i, len(w), sum(c[t] > 0 for t in w), n, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in w), 4)) for i, w in rows), key=str)
    assert got == want
    held = [r for r in lm.score(df).collect() if r.held_out]
    assert held and all(r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in held)
    assert sum(r.score for r in held) > sum(r.base_score for r in held) and all(math.isfinite(r.score) for r in held)


def test_language_model_is_a_distribution(spark, monkeypatch):
    """Scores are those of the plain formula, whose probabilities of all words, the end and one unknown word sum to 1 after any word."""
    weights = np.full((lm.BUCKETS, 3), [0.5, 0.3, 0.2])
    weights[0] = [0.0, 0.6, 0.4]
    monkeypatch.setattr(lm, "learn_weights", lambda *_: weights)
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice(["a", "B", "c", "d", f"rare{i}"]) for _ in range(rnd.randrange(12)))) for i in range(60)]
    tokens = {i: [None] + words_of(t) + ["</s>"] for i, t in rows}
    train = [t for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    one = Counter(w for t in train for w in t[1:])
    two = Counter(p for t in train for p in zip(t, t[1:]))
    before = Counter(v for t in train for v in t[:-1])
    n, v = sum(one.values()), len(one)

    def p(w, after):
        l2, l1, l0 = weights[int(lm.bucket(np.array([before[after]]))[0])]
        return l2 * (two[after, w] / before[after] if before[after] else 0) + l1 * one[w] / n + l0 / (v + 1)

    for after in (None, "a", "rare1", "never"):
        assert sum(p(w, after) for w in [*one, "unknown"]) == pytest.approx(1)
    for r in lm.score(docs(spark, rows)).collect():
        t = tokens[r.doc_id]
        assert r.score == pytest.approx(sum(math.log10(p(w, after)) for after, w in zip(t, t[1:])))


def test_weights_by_expectation_maximisation():
    k = np.array([3, 3, 5])
    cells = (k * lm.BINS + np.array([1, 0, 0])) * lm.BINS + np.array([20, 20, 20])
    w = lm.learn_weights(cells, np.array([900, 100, 1000]), 1000)
    assert np.allclose(w.sum(1), 1) and w[3][0] > 0.8 and w[5][0] < 1e-6 and (w[:, 1:] > 0).all() and w[0][0] == 0


def test_packed_numbers():
    for a in (np.empty(0, np.uint64), np.array([0, 0], np.uint64), np.array([1, 300, 1 << 63, 7], np.uint64)):
        assert lm.unpacked(lm.packed(a)).tolist() == a.tolist()
        assert lm._sorted_unpacked(lm._sorted_packed(np.sort(a))).tolist() == np.sort(a).tolist()


def test_language_model_reads_its_input_once(spark, sf, monkeypatch, tmp_path):
    """The scan may be split otherwise, and give its rows in another order, whenever it is read: the chunks are those of the first pass."""
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    df.repartition(7).write.parquet(str(tmp_path / "docs"))
    want = {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, pytest.approx(r.base_score)) for r in lm.score(df).collect()}
    splits = iter(["200000", "90000", "9000000"])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    plain = lm.table

    def table(part, name):
        out = plain(part, name)
        spark.conf.set("spark.sql.files.maxPartitionBytes", next(splits, "300000"))
        return out

    monkeypatch.setattr(lm, "table", table)
    monkeypatch.setattr(lm, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(lm, "OWNER_ENTRIES", 20_000)
    try:
        again = spark.read.parquet(str(tmp_path / "docs")).orderBy(F.rand())
        assert {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in lm.score(again).collect()} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_owners_grow_with_the_input(spark, monkeypatch):
    """However large the input, an owner sums a bounded number of entries."""
    monkeypatch.setattr(lm, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(lm, "OWNER_ENTRIES", 4000)
    most, plain = [], lm._requests

    def requests(owners):
        most.append(owners)
        return plain(owners)

    monkeypatch.setattr(lm, "_requests", requests)
    text = lambda i: " ".join(f"w{(i * 131 + j * j) % 997}" for j in range(100))
    for n in (100, 400):
        assert lm.score(docs(spark, [(i, text(i)) for i in range(n)], False)).count() == n
    assert most[1] >= 3 * most[0] > 3


def plain_weights(train, vocabulary, steps=200):
    """Deleted interpolation token by token, without bins of probabilities."""
    one = Counter(w for t in train for w in t[1:])
    two = Counter(p for t in train for p in zip(t, t[1:]))
    before = Counter(v for t in train for v in t[:-1])
    n = sum(one.values())
    seen = []
    for t in train:
        for v, w in zip(t, t[1:]):
            c = before[v] - 1
            seen.append((int(lm.bucket(np.array([c]))[0]), (two[v, w] - 1) / c if c else 0.0, (one[w] - 1) / (n - 1), 1 / (vocabulary + 1)))
    weights = np.full((lm.BUCKETS, 3), 1 / 3)
    for _ in range(steps):
        got = np.zeros((lm.BUCKETS, 3))
        for k, *p in seen:
            share = weights[k] * p
            got[k] += share / share.sum()
        weights = got + np.array([0, 0.5, 0.5])
        weights = weights / weights.sum(1, keepdims=True)
    return weights, seen


def test_learned_weights_are_those_of_plain_em(spark, monkeypatch):
    held = []
    plain = lm.learn_weights
    monkeypatch.setattr(lm, "learn_weights", lambda *a: held.append(plain(*a)) or held[-1])
    monkeypatch.setattr(lm, "EM_STEPS", 200)
    rnd = random.Random(9)
    words, rows = [f"w{j}" for j in range(40)], []
    for i in range(150):
        text = [rnd.choice(words)]
        for _ in range(rnd.randrange(25)):
            text.append(words[(words.index(text[-1]) * 3 + 1) % 40] if rnd.random() < 0.6 else rnd.choice(words))
        rows.append((i, " ".join(text)))
    lm.score(docs(spark, rows, False)).count()
    train = [[None] + words_of(t) + ["</s>"] for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    want, seen = plain_weights(train, len({w for t in train for w in t[1:]}))
    gain = lambda w: np.mean([np.log(max(w[k] @ p, 1e-12)) for k, *p in seen])
    # expectation-maximisation maximises the likelihood of the deleted counts; bins of a quarter octave cost next to nothing of it
    assert abs(gain(held[0]) - gain(want)) < 0.01 < gain(want) - gain(np.full((lm.BUCKETS, 3), 1 / 3))


@pytest.mark.parametrize("n", [1, 2, 13, 200])
def test_partition_keys(spark, n):
    keys = frames.partition_keys(n)
    df = spark.createDataFrame([(int(k),) for k in keys], "k int").repartition(n, "k").select("k", F.spark_partition_id().alias("p"))
    assert sorted(map(tuple, df.collect()), key=lambda r: r[1]) == [(int(k), p) for p, k in enumerate(keys)]


def test_language_model_of_nothing(spark):
    assert lm.score(docs(spark, [])).collect() == []


# -- packing


def naive_bins(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        best = min((r for r in room if r >= n), default=None)
        if best is None:
            room.append(capacity - n)
        else:
            room[room.index(best)] -= n
    return len(room)


def check_packing(rows, texts, capacity=2048):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: t.encode(x or "", add_special_tokens=False).ids + [0] for i, x in texts.items()}
    by = {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    pieces = Counter(r.doc_id for r in rows)
    for i, x in ids.items():
        own = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == i)
        assert [p for p, _, _ in own] == list(range(pieces[i])) and sum(n for _, _, n in own) == len(x) and all(n == capacity for _, _, n in own[1:])
    assert len(by) == naive_bins([r.length for r in rows], capacity)


def test_packing(spark, sf, monkeypatch):
    monkeypatch.setattr(packing, "RANK_GROUP", 20)
    monkeypatch.setattr(packing, "SALT_BLOCK", 2)
    rows = QUERIES["op4_packing"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check_packing(rows, texts)


def test_packing_of_odd_rows(spark):
    texts = dict(ODD[:10]) | {20: "<|endoftext|> a", 21: "  x  \n\n y  ", 22: "\r\n\r\n  q", 23: "it's  don't\t\tok\n", 24: "tail \n", 25: "\n\nhead", 26: "a <|endoftext|> b", 27: "x<|endoftext|><|endoftext|>\n<|endoftext", 28: "end|> of it"}
    check_packing(packing.pack(docs(spark, list(texts.items())), tokenizer_path()).collect(), texts)
    assert next(iter(packing.encode_column(pa.array(["a <|endoftext|> b"]), tokenizer_path()))).tolist() == [64, 220, 50256, 275]
    twice = packing.pack(docs(spark, [(1, "a b"), (1, "a b"), (None, None)]), tokenizer_path(), keep_ids=True).collect()
    assert len(twice) == 3 and {r.doc_id for r in twice} == {1, None} and all(len(r.ids) == r.length for r in twice) and len({(r.sequence_id, r.offset) for r in twice}) == 3
    assert packing.pack(docs(spark, []), tokenizer_path()).collect() == []


def test_memo_can_be_emptied(monkeypatch, sf):
    import pyarrow.parquet as pq

    column = pq.read_table(f"{sf}/documents.parquet")["text"].combine_chunks()
    want = [x.tolist() for x in packing.encode_column(column, tokenizer_path())]
    monkeypatch.setattr(packing, "MEMO_IDS", 10)
    assert [x.tolist() for x in packing.encode_column(column, tokenizer_path())] == want


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit_decreasing(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([10, 37, 2048])
    items = [rnd.randint(1, capacity) for _ in range(rnd.randint(0, 300))]
    runs, bins = packing.plan(Counter(items), capacity)
    assert bins == naive_bins(items, capacity) and sum(r.count for r in runs) == len(items)


# -- HTML


def article(page):
    body = page.split("<article>")[1].split("</article>")[0].replace("<br>", " ")
    blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", body))
    return "\n\n".join(b for b in blocks if b)


def test_articles(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = QUERIES["op1_html"](spark, sf).collect()
    assert {r.page_id: r.text for r in got} == {i: article(p) for i, p in pages.items()} and all(r.n_chars == len(r.text) for r in got)


def plain_page(k):
    links = "".join(f"<li><a href='/{j}'>link {k} {j}</a>" for j in range(k % 4 + 1))
    parts = "".join(f"<p>Paragraph {j} of page {k} says something of its own &amp; more.\n  It goes on.</p>" for j in range(k % 3 + 2))
    note = "<div class='notice'>We use cookies.</div>" if k % 2 else ""
    return (
        f"<!doctype html><html><head><title>T {k}</title><style>p{{}}</style></head><body><!-- x --><div id=top><ul class='menu'>{links}</ul></div>{note}"
        f"<div id='main-col'><h2>Head {k}</h2><div class='by'>Follow us everywhere</div>{parts}<form><input name=q><button>Go</button></form></div>"
        f"<div class='comments'><p>Reader {k} writes a comment of many words that would be taken for text.</p></div><footer>foot {k}</footer><script>var a='<p>no</p>';</script></body></html>"
    )


def test_pages_without_an_article(spark):
    rows = [(k, "http://a.example/x", plain_page(k)) for k in range(12)] + [(100, None, None), (101, "no url", ""), (102, "http://b.example", "just text &lt;b&gt; <b>bold</b>"), (3, "http://a.example/x", plain_page(3))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as w", "'t' as text")
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    for k in range(12):
        want = [f"Head {k}"] + [f"Paragraph {j} of page {k} says something of its own & more. It goes on." for j in range(k % 3 + 2)]
        assert got[k].text == "\n\n".join(want), got[k].text
    assert got[100].text == "" and got[101].text == "" and got[102].text == "just text <b> bold" and got[102].n_chars == 18
    assert html_text.extract(df.limit(0)).collect() == []


def test_copies_make_no_literals(spark):
    page = "<body><main><p>The same article.</p><p>On every row.</p></main></body>"
    df = spark.createDataFrame([(k, "http://c.example/", page) for k in range(9)], "page_id long, url string, html string")
    assert {r.text for r in html_text.extract(df).collect()} == {"The same article.\n\nOn every row."}


@pytest.mark.parametrize("page", ["<", "<p", "<a href='x", "</p></p>", "<script>never ends", "<!--", "<div " * 50, "<div>" * 3000 + "deep" + "</div>" * 3000, "<p>a<p>b</div></p>", '<p title="a>b">c</p>', "<table><tr><td>1<td>2<tr><td>3</table>", "&#0;&#xD800;&bogus;"])
def test_malformed_pages(page):
    tree = html_text.group(html_text.parse(page))
    w = html_text.mark(html_text.first_wrapper(tree, 1))
    assert isinstance(html_text.text_of(page, w, {}, "h"), str)


@pytest.mark.parametrize("unit", ["<a ", "<a", "<!", '<a "x\' ', "</a ", "<p class=a ", '<a "x>y" ', "<!--", "<div class=sidebar><main>", "&#x", "<script>"])
def test_pages_without_ends(unit):
    """A hundred thousand tags, declarations or references without an end, in time linear in them."""
    began = time.monotonic()
    tree = html_text.parse("<p>Before.</p>" + unit * 100_000)
    assert time.monotonic() - began < 10 and tree[2][0][2][0][3] == [("Before.", True)]


def test_marks_in_scripts_and_tags_without_ends():
    text = lambda p: [t for s in html_text._slots(html_text.group(html_text.parse(p))) for t, _ in s[3]]
    assert text('<script>var s = "<!--";</script><p>Kept.</p>') == ["Kept."]
    assert text("<p>One</p><!--><p>Two</p>") == ["One", "Two"]
    assert text("a <b <!-- c --> d") == ["a d"]  # the tag holds the comment
    assert text("a < b <! x <!-- gone") == ["a < b <! x"]
    assert text("<p>a</p>b <i c") == ["a", "b <i c"]


def test_malformed_texts():
    text = lambda p: html_text.text_of(p, html_text.mark(html_text.first_wrapper(html_text.group(html_text.parse(p)), 1)), {}, "h")
    assert text("<p>a<p>b</div></p>") == "a\n\nb" and text('<p title="a>b">c</p>') == "c" and text("<table><tr><td>1<td>2<tr><td>3</table>") == "1\n\n2\n\n3"
    assert text("<div>menu text that is long, longer than all</div><div role='main'>body</div>") == "body"
    assert text("<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>after</p>") == "deep\n\nafter"


def one_page(page):
    return html_text.text_of(page, html_text.mark(html_text.first_wrapper(html_text.group(html_text.parse(page)), 1)), {}, "h")


@pytest.mark.parametrize(
    "page",
    [
        '<div class="layout has-sidebar"><article><p>a</p><p>b</p></article></div>',
        '<div class="sidebar"><div id="menu"><main><p>a</p><p>b</p></main></div></div>',
        '<main><div class="layout sidebar"><article><p>a</p><p>b</p></article></div></main>',
        '<article class="post no-comments"><p>a</p><p>b</p></article>',
        '<article class="notice"><p>a</p><p>b</p></article>',
        '<div class="widget"><article class="notice"><p>a</p><p>b</p></article></div>',
        '<main class="content with-sidebar"><p>a</p><p>b</p></main>',
        '<article><section id="related-work"><p>a</p></section><h2 id="social-policy">b</h2></article>',
        '<article><section id="comments"><p>a</p></section><p class="ad-hoc">b</p></article>',
        '<article><p>a</p><p>b</p><div class="comments"><article class="comment-body">c</article></div></article>',
        '<article><p>a</p><p>b</p></article><div id="comments"><div class="text">c</div></div>',
        '<main><article><p>a</p><p>b</p></article><ol class="comment-list"><li class="comment">c</li></ol></main>',
        '<article><p>a</p><div class="ad">c</div><div class="cookie-banner">c</div><ul class="social-links"><li>c</li></ul><p>b</p><div class="site-footer">c</div></article>',
    ],
)
def test_words_that_name_an_element(page):
    assert one_page(page) == "a\n\nb"


def test_elements_at_any_depth():
    down, up = "<div>" * 70, "</div>" * 70
    assert one_page(f"<div><p>Head</p>{down}<nav>menu</nav><p>text</p><aside><div><p>note</p></div></aside><form>form</form><div class='comments'><p>c</p></div>{up}<p>tail</p></div>") == "Head\n\ntext\n\ntail"
    assert one_page(f"<p>beside</p>{down}<div class='sidebar'><article><h1>Head</h1><nav>menu</nav><p>text</p></article></div><p>other</p>{up}") == "Head\n\ntext"
    assert one_page(f"<article><p>a</p>{down}<header>h</header><div class='comments'><article class='comment'>c</article></div>{up}<p>b</p></article>") == "a\n\nh\n\nb"
    deep = one_page("<div>" * 50_000 + "deep" + "</div>" * 50_000 + "<p>after</p>")
    assert deep == "deep\n\nafter"


def test_thousands_of_siblings(spark):
    """Alignment does not grow with the square of an element's children."""
    rnd = random.Random(4)
    kinds = ["p", "h2", "h3", "pre", "blockquote", "section"]
    pages = ["<div>" + "".join(f"<{(t := rnd.choice(kinds))}>{k} {j}</{t}>" for j in range(20_000)) + "</div>" for k in range(2)]
    began = time.monotonic()
    got = texts(spark, pages)
    assert time.monotonic() - began < 60 and [len(t.split("\n\n")) for t in got] == [20_000, 20_000]


@pytest.mark.parametrize("seed", range(20))
def test_alignment(seed):
    rnd = random.Random(seed)
    a, b = ([rnd.choice("abcd") for _ in range(rnd.randrange(30))] for _ in range(2))
    pairs = html_text._aligned(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))
    assert html_text._aligned(a, a) == [(i, i) for i in range(len(a))]
    cut = sorted(rnd.sample(range(len(a)), len(a) // 2))
    assert len(html_text._aligned(list(range(len(a))), cut)) == len(cut)


@pytest.mark.parametrize("fan_in", [2, 64])
def test_a_host_of_many_shapes(spark, monkeypatch, fan_in):
    """Wrappers of one host meet in rounds; the probed blocks of an article stay."""
    monkeypatch.setattr(html_text, "FAN_IN", fan_in)
    article = "<h2>Summary</h2><p>{0}</p><p class='share-price'>Price</p><section class='related-work'>Work</section><div class='search-engines'>Engines</div><p>Licence.</p>"
    pages = [f"<ul class=menu>{'<li>x' * (k % 9)}</ul>" + "<div><b></b></div><p></p>" * (k % 13) + f"<article>{article.format(k)}</article>" for k in range(60)]
    assert texts(spark, pages) == [f"Summary\n\n{k}\n\nPrice\n\nWork\n\nEngines\n\nLicence." for k in range(60)]


def texts(spark, pages, url="http://d.example/"):
    df = spark.createDataFrame([(k, url, p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in html_text.extract(df).orderBy("page_id").collect()]


@pytest.mark.parametrize("url", ["http://d.example/", None])
def test_two_templates_of_a_host(spark, url):
    first = [f"<div class='top'>Top {k}</div><article><h1>Head {k}</h1><p>Text {k} of the article.</p></article>" for k in range(5)]
    second = [f"<div class='story'><p>Story {k}</p><p>Other text {k} of the story.</p></div><main></main>" for k in range(5)]
    assert texts(spark, first + second, url) == [f"Head {k}\n\nText {k} of the article." for k in range(5)] + [f"Story {k}\n\nOther text {k} of the story." for k in range(5)]


@pytest.mark.parametrize("tag", ["article", "main", "div role=main"])
def test_literals_inside_an_article(spark, tag):
    end = tag.split()[0]
    recipes = [f"<ul><li>Link {k}</ul><{tag}><h1>Dish {k}</h1><h2>Ingredients</h2><ul><li>Salt {k}</ul><h2>Method</h2><ol><li>Stir {k}</ol></{end}>" for k in range(5)]
    assert texts(spark, recipes) == [f"Dish {k}\n\nIngredients\n\nSalt {k}\n\nMethod\n\nStir {k}" for k in range(5)]
    same_article = [f"<div class=top>Top {k}</div><{tag}><h1>Head</h1><p>The same text.</p></{end}><script>{k}</script>" for k in range(5)]
    assert texts(spark, same_article) == ["Head\n\nThe same text."] * 5


def test_blocks_beside_the_longest(spark):
    menu = "<div><ul><li><a href='/{0}'>Link {0}</a> | <li><a href='/x{0}'>Other link {0}</a></ul></div>"
    nested = "<div id=page><h1>Title {0}</h1><p class=lead>Lead {0}</p><div class=body><div><h2><a href='/{0}'>Head {0}</a></h2></div><div><p>{1}</p><p>{1}</p></div></div><ul><li>Note {0}</ul></div>"
    for page, want in (
        (nested, "Title {0}\n\nLead {0}\n\nHead {0}\n\n{1}\n\n{1}\n\nNote {0}"),
        ("<div><h1><a href='/{0}'>Title {0}</a></h1><p>{1}</p></div>", "Title {0}\n\n{1}"),
        ("<div><div>Title {0}</div><div>{1}</div></div>", "Title {0}\n\n{1}"),
    ):
        for top in ("", menu):
            pages = [(top + page).format(k, f"Long text {k}. " * 30) for k in range(4)]
            assert texts(spark, pages) == [want.format(k, (f"Long text {k}. " * 30).strip()) for k in range(4)]
