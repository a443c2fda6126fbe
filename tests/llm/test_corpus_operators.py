"""Pairs, passages, language model, packing and the pipeline against brute force."""

from __future__ import annotations

import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_prose import prose
from pyspark.sql import functions as F

import corpus_pipeline
from shalebed.llm import entries, ngram_join
from shalebed.llm import lm_scoring as lm
from shalebed.llm.arrow_words import Words, strings
from shalebed.llm.components import connected_components
from shalebed.llm.decontamination import drop_leaks, find_leaks
from shalebed.llm.lm_scoring import score_documents
from shalebed.llm.ngram_join import choose_bands, join_similar, keep_one_of_each, overlaps
from shalebed.llm.packing import Encoder, Shard, Terms, pack
from shalebed.llm.substring_dedup import _first_owners, drop_repeats, repeated_ranges, sliding_min

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n=5):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def classes(rows, threshold=0.8):
    """Counter of (doc_id, class_id, n_links) by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    key = lambda k: -(2**63) if rows[k][0] is None else rows[k][0]
    links = defaultdict(set)
    for a, b in itertools.combinations(range(len(rows)), 2):
        union = len(sets[a] | sets[b])
        if union and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * union:
            links[a].add(b)
            links[b].add(a)
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in links[a]:
                if label[b] < label[a]:
                    label[a], changed = label[b], True
    least = {x: min(key(k) for k in range(len(rows)) if label[k] == x) for x in set(label)}
    told = lambda x: None if x == -(2**63) else x
    return Counter((rows[k][0], told(least[label[k]]), len(links[k])) for k in range(len(rows)))


def near_copies(seed, n, words=120, edits=3):
    rng = random.Random(seed)
    base = prose(seed, words).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_joins(spark, documents, nothing, odd_rows):
    rows = list(odd_rows) + [(100 + i, t) for i, t in enumerate(near_copies(1, 40))] + [(200 + i, t) for i, t in enumerate(near_copies(2, 25, 60))]
    rows += [(300 + i, prose(50 + i, 80)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = classes(rows)
    for block in (768, 7):  # whole clusters, and clusters split into blocks
        out = join_similar(df, block=block).collect()
        assert Counter((r.doc_id, r.class_id, r.n_links) for r in out) == expected
    kept = keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sum(r.doc_id is not None and 100 <= r.doc_id < 140 for r in kept.collect()) == sum(e[1] == e[0] for e in expected if e[0] and 100 <= e[0] < 140)
    assert join_similar(documents).count() == documents.count()
    assert join_similar(nothing).count() == 0


def test_one_of_each_with_repeated_and_null_ids(spark):
    copy, other, near = prose(21, 60), prose(22, 60), near_copies(23, 6, 200, 2)
    rows = [(1, copy), (2, copy), (2, other), (3, other + " tail"), (3, other + " tail"), (None, near[0]), (None, near[1]), (7, near[2]), (None, None), (None, None), (8, "")]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, kept long")
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in join_similar(df).collect()) == classes(rows)
    out = Counter((r.doc_id, r.text) for r in keep_one_of_each(df).collect())
    first = min((near[0], near[1]), key=lambda t: next(r.h for r in df.where(F.col("text") == t).select(F.xxhash64("text").alias("h")).collect()))
    assert out == Counter([(1, copy), (2, other), (None, first), (None, None), (8, "")])


def test_many_rows_without_ids(spark):
    """A thousand rows of a few hundred texts, none with an id, are no product."""
    texts = near_copies(31, 20, 100, 3) + [prose(1000 + k, 50) for k in range(180)]
    rows = [(None, texts[k % 200]) for k in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = join_similar(df).collect()
    assert len(out) == 1000 and {r.class_id for r in out} == {None}
    assert Counter(r.n_links for r in out) == Counter(n for _, _, n in classes(rows).elements())
    kept = keep_one_of_each(df).collect()
    assert len(kept) == len({r.text for r in kept}) == 180 + len({c for _, c, _ in classes(list(enumerate(texts[:20])))})


def test_a_long_chain_is_no_group(spark):
    """5,000 texts, each like the few before and after it, are one class; each is sent a few times."""
    words = prose(41, 5000 * 6 + 300, 10**6).split()
    rows = [(k, " ".join(words[6 * k : 6 * k + 300])) for k in range(5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    sent, meetings = [], ngram_join._meetings

    def counted(*args):
        out = meetings(*args)
        sent.append(out.count())
        return out

    ngram_join._meetings = counted
    try:
        out = join_similar(df).collect()
    finally:
        ngram_join._meetings = meetings
    assert {r.class_id for r in out} == {0} and len(out) == 5000
    alike = max(k for k in range(50) if 296 - 6 * k >= 0.8 * (296 + 6 * k))
    assert Counter(r.n_links for r in out)[2 * alike] == 5000 - 2 * alike
    assert sent[0] < 40 * 5000


def test_bands():
    for threshold, recall in ((0.8, 0.9999), (0.5, 0.99)):
        bands, rows = choose_bands(threshold, recall)
        assert bands * rows <= 128 and 1 - (1 - threshold**rows) ** bands >= recall
    with pytest.raises(ValueError):
        choose_bands(0.1, 0.9999, 16)


def test_overlaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 400, n).astype(np.uint64)) for n in rng.integers(1, 200, 30)]
    sets += [np.arange(1000, 1300, dtype=np.uint64)] * 20
    expected = [[0 if a is b and i == j else len(np.intersect1d(a, b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    found = overlaps(sets)
    np.fill_diagonal(found, 0)
    np.fill_diagonal(expected := np.array(expected), 0)
    assert (found == expected).all()


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(500, k) for k in range(501, 560)]
    label = {n: n for e in edges for n in e}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    found = dict(connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert found == {n: x for n, x in label.items() if any(n in e and e[0] != e[1] for e in edges)}


# Passages ------------------------------------------------------------------


def without_repeats(rows, k):
    key = lambda i: -(2**63) if i is None else i
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for a in range(len(w) - k + 1):
            x = tuple(w[a : a + k])
            first[x] = min(first.get(x, key(i)), key(i))
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = {a + b for a in range(len(w) - k + 1) if first[tuple(w[a : a + k])] < key(i) for b in range(k)}
        out.append((i, len(w), len(gone), " ".join(x for a, x in enumerate(w) if a not in gone)))
    return Counter(out)


def test_repeats(spark, nothing, odd_rows):
    rng = random.Random(9)
    passage = [prose(1000 + k, 40, 30) for k in range(4)]
    rows = [r for r in odd_rows if r[0] != 7]
    rows += [(50 + i, " \t".join([prose(i, rng.randrange(25), 50), rng.choice(passage), prose(70 + i, rng.randrange(40), 6), rng.choice(passage)])) for i in range(60)]
    rows += [(200, "ha " * 3000), (201, "ha " * 500)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_words string").repartition(4)
    for crowd in (4096, 3):  # buckets, and minimisers so frequent that windows are spread
        out = drop_repeats(df, k=12, m=4, crowd=crowd)
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in out.collect()) == without_repeats(rows, 12)
    assert drop_repeats(nothing).count() == 0


def test_windows_are_compared_by_words(spark, monkeypatch):
    """With hashes of 3 bits nearly all windows have equal ones; the result is the same."""
    rng = random.Random(10)
    rows = [(i, prose(i, 60, 30) + " " + prose(rng.randrange(8), 40, 30)) for i in range(40)]
    words = Words(strings(pa.array([t for _, t in rows])))
    n = np.maximum(words.counts - 9, 0)
    of = np.repeat(np.arange(len(n)), n)
    doc = np.array([i for i, _ in rows])[of]
    first = {}
    split = [t.split() for _, t in rows]
    windows = [tuple(split[r][a : a + 10]) for r, m in enumerate(n) for a in range(m)]
    for w, d in zip(windows, doc.tolist()):
        first[w] = min(first.get(w, d), d)
    exact = _first_owners(words, 10, np.zeros(len(of), np.int64), doc)
    monkeypatch.setattr(Words, "hashes", lambda self, family=0, own=Words.hashes: own(self, family) % np.uint64(2))
    assert exact.tolist() == _first_owners(words, 10, np.zeros(len(of), np.int64), doc).tolist() == [first[w] for w in windows]


def test_crowds_by_bytes(spark):
    """Minimisers of few but very long windows are spread as those of many are."""
    rows = [(i, " ".join(f"{'x' * 500}{k}" for k in range(60)) + " " + prose(i, 30)) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = df.select(F.col("doc_id").alias("__doc"), F.xxhash64("text").alias("__text"), "text")
    few, many = (Counter(tuple(r) for r in repeated_ranges(keyed, 50, 8, 4096, size).collect()) for size in (16_000_000, 1000))
    covered = lambda found: {(r[0], w) for r in found for w in range(r[2], r[3])}
    assert covered(few) == covered(many) == {(i, w) for i in range(1, 6) for w in range(60)}


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 99, 50)
    for width in (1, 2, 3, 7, 8, 43):
        assert sliding_min(x, width).tolist() == [x[i : i + width].min() for i in range(len(x) - width + 1)]


def test_leaks(spark, data, documents, nothing):
    rng = random.Random(2)
    items = [(k, prose(7000 + k, rng.randrange(12, 60), 900)) for k in range(30)] + [(90, None), (91, "too short"), (92, prose(7100, 300, 900)), (None, prose(7200, 30, 900))]
    items += [items[0]]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs, planted = [], set()
    for i in range(120):
        text = prose(i, rng.randrange(20, 400), 900)
        if i % 3 == 0:
            k = rng.choice([*range(30), 92])
            words = text.split()
            at = rng.randrange(len(words))
            own = dict(items)[k].upper() if i % 2 else dict(items)[k] + ".%%%"
            text = " ".join([*words[:at], own, *words[at:]])
            planted.add((i, k))
        docs.append((i, text, "clash"))
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    for max_bytes in (4_000_000, 3000):  # one index, several
        out = find_leaks(df, benchmark, max_bytes=max_bytes).collect()
        assert {(r.doc_id, r.item_id) for r in out} == planted and len(out) == len(planted)
        assert {r.doc_id for r in drop_leaks(df, benchmark, max_bytes=max_bytes).collect()} == {i for i, *_ in docs} - {i for i, _ in planted}
    assert find_leaks(documents, benchmark).count() == 0
    assert drop_leaks(documents, benchmark).count() == documents.count()
    assert find_leaks(nothing, benchmark).count() == 0
    assert find_leaks(df, benchmark.where("false")).count() == 0


def test_leaks_of_short_items(spark):
    """Items of 1 to 9 words are found exactly where their words follow each other."""
    rng = random.Random(5)
    benchmark = [(10 * n + k, " ".join(f"q{10 * n + k}x{j}" for j in range(n))) for n in range(1, 10) for k in range(3)]
    benchmark += [(200, "Q31x0 q31x1, q31x2!"), (201, "..."), (202, "q80x0 q80x1 q80x2")]
    words = {i: re.findall(r"[a-z0-9]+", t.lower()) for i, t in benchmark}
    docs = []
    for i in range(150):
        own = prose(i, rng.randrange(0, 60), 900).split()
        item = list(words[benchmark[i % 27][0]])
        if i % 5 == 0 and len(item) < 8:
            item.insert(rng.randrange(len(item) + 1), "other") if i % 2 else item.pop()
        at = rng.randrange(len(own) + 1)
        docs.append((i, " ".join(own[:at] + item + own[at:]).upper()))
    docs.append((900, benchmark[9][1] + "y"))
    expected = set()
    for i, text in docs:
        own = re.findall(r"[a-z0-9]+", text.lower())
        expected |= {(i, k) for k, w in words.items() if w and any(own[a : a + len(w)] == w for a in range(len(own)))}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(benchmark, "item_id long, text string")
    assert {n for n in range(1, 10)} <= {len(words[k]) for _, k in expected}
    for max_bytes in (4_000_000, 300):
        out = find_leaks(df, items, max_bytes=max_bytes).collect()
        assert {(r.doc_id, r.item_id) for r in out} == expected and len(out) == len(expected)
        assert {r.doc_id for r in drop_leaks(df, items, max_bytes=max_bytes).collect()} == {i for i, _ in docs} - {i for i, _ in expected}


def test_leaks_do_not_depend_on_the_deal(spark):
    """Items dealt into several indexes have the scores of one index."""
    rng = random.Random(6)
    items = [(k, prose(8000 + k, rng.randrange(9, 200), 60)) for k in range(40)]
    docs = [(i, prose(i, 40, 60) + " " + " ".join(items[i % 40][1].split()[rng.randrange(3) :]) + " " + prose(500 + i, 40, 60)) for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(map(tuple, find_leaks(df, benchmark, max_bytes=b).collect())) for b in (4_000_000, 1500))
    assert len(one) > 70 and many == one


def unpruned(docs, items, threshold=0.6, question=0.6, answer=0.6, n=3, least=8):
    """find_leaks in plain Python: every passage against every item, nothing pruned."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    runs = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    words = {k: split(t) for k, t in dict(items).items()}
    scored = {k: w for k, w in words.items() if len(w) >= least}
    mean = sum(map(len, scored.values())) / max(1, len(scored))
    df = Counter(t for w in scored.values() for t in set(w))
    out = {}
    for i, text in docs:
        own = split(text)
        for k, w in words.items():
            if len(w) < least:
                if w and tuple(w) in runs(own, len(w)):
                    out[i, k] = (1.0, 1.0, 1.0)
                continue
            weight = {}
            for t, tf in Counter(w).items():
                norm = 1.2 * (0.25 + 0.75 * len(w) / mean)
                weight[t] = math.log1p((len(scored) - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + norm)
            stride = 1 << math.ceil(math.log2(len(w)))
            cut = -(-2 * len(w) // 3)
            for p in range(max(-(-len(own) // stride) - 1, min(1, len(own)))):
                passage = own[p * stride : (p + 2) * stride]
                score = sum(weight[t] for t in set(passage) & set(weight)) / sum(weight.values())
                shares = [len(runs(x, m) & runs(passage, m)) / len(runs(x, m)) for x in (w[:cut], w[cut:]) if (m := min(n, len(x)))]
                if score >= threshold - 1e-9 and shares[0] >= question and shares[1] >= answer:
                    out[i, k] = max(out.get((i, k), (0.0, 0.0, 0.0)), (score, *shares))
    return out


def test_leaks_are_those_of_unpruned_bm25(spark):
    rng = random.Random(9)
    items = [(k, prose(8000 + k, rng.choice([3, 7, 8, 9, 15, 16, 17, 40, 130, 1000]), rng.choice([12, 60, 900]))) for k in range(60)]
    docs = []
    for i in range(160):
        item = items[i % 60][1].split()
        for _ in range(rng.randrange(1 + len(item) // 4)):  # words changed, dropped and moved
            item[rng.randrange(len(item))] = rng.choice(["w1", "w2", "zz"])
        a = rng.randrange(1 + len(item) // 4)
        docs.append((i, " ".join([prose(i, rng.randrange(80), 60), *item[a:], prose(900 + i, rng.randrange(80), 60)])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    expected = unpruned(docs, items)
    near = sum(0.6 <= min(v) < 0.8 for v in expected.values())
    assert len(expected) > 80 and near > 5
    for max_bytes in (4_000_000, 2500):
        found = {(r.doc_id, r.item_id): tuple(r)[2:] for r in find_leaks(df, benchmark, max_bytes=max_bytes).collect()}
        assert found.keys() == expected.keys()
        assert all(abs(x - y) < 1e-9 for k in found for x, y in zip(found[k], expected[k]))


def test_long_items_are_wholes(spark):
    """A part of a long item isn't the item; all of it is, and so is nearly all."""
    words = prose(77, 1000, 5000).split()
    docs = [(1, " ".join(words)), (2, " ".join(words[:125])), (3, " ".join(words[:640])), (4, prose(1, 700) + " " + " ".join(words[20:980]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame([(5, " ".join(words)), (6, prose(78, 20))], "item_id long, text string")
    found = {r.doc_id: r for r in find_leaks(df, benchmark).collect()}
    assert set(found) == {1, 4} and all(r.item_id == 5 for r in found.values())
    assert found[1].score == pytest.approx(1) and found[1].question_overlap == found[1].answer_overlap == 1


def test_leaks_of_tables(spark, data):
    """The query against a search for runs of 8 words of each item."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    runs, size = defaultdict(set), {}
    for r in spark.read.parquet(f"{data}/benchmark.parquet").collect():
        w = word.findall(r.text.lower())
        size[r.item_id] = len(w) - 7
        for i in range(len(w) - 7):
            runs[tuple(w[i : i + 8])].add(r.item_id)
    expected = set()
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        w = word.findall(r.text.lower())
        hits = Counter(k for x in {tuple(w[i : i + 8]) for i in range(len(w) - 7)} for k in runs.get(x, ()))
        expected |= {(r.doc_id, k) for k, n in hits.items() if n >= 0.6 * size[k]}
    found = {(r.doc_id, r.item_id) for r in entries.QUERIES["op5_benchmark_decontamination"](spark, data).collect()}
    assert expected and found == expected


# Language model ------------------------------------------------------------


def test_scores(spark, data, documents, nothing, odd_rows):
    for df, rows in ((documents, odd_rows), (None, [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()])):
        df = df if df is not None else spark.createDataFrame(rows, "doc_id long, text string")
        tokens = lambda t: [*WORD.findall((t or "").translate(ASCII)), None]
        held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
        c = Counter(x for i, t in rows if not held(i) for x in tokens(t))
        total, distinct = sum(c.values()), len(c)
        expected = Counter()
        for i, t in rows:
            own = tokens(t)
            base = sum(math.log10((c[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in own)
            expected[i, held(i), len(own), sum(c[x] > 0 for x in own), total, round(base, 4)] += 1
        for max_head in (131_072, 50):  # the table of frequent words doesn't change results
            out = score_documents(df, max_head=max_head).collect()
            assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out) == expected
            assert all(math.isfinite(r.score) and r.score < 0 for r in out)
    assert score_documents(nothing).count() == 0


def test_model_beats_counts(spark):
    """Held-out text of two kinds: the context tells which, single counts don't."""
    rng = random.Random(1)
    kinds = [[f"a{k}" for k in range(50)], [f"b{k}" for k in range(50)]]
    rows = [(i, " ".join(rng.choice(kinds[i % 2]) for _ in range(200))) for i in range(400)]
    out = score_documents(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out")
    base, score = out.agg(F.sum("base_score"), F.sum("score")).first()
    assert score > 0.95 * base


def scores_by_hand(rows, max_head, bits, steps, epochs, rate, damp, every, mass):
    """The model's log10 probability of each row, token by token in plain Python."""
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows]
    part = [zlib.crc32(("" if i is None else str(i)).encode()) % 1_000_000 // 10 % steps for i, _ in rows]
    ids = [lm._tokens(pa.array([t or ""], pa.large_string()))[0].tolist() for _, t in rows]
    c = Counter(x for own, h in zip(ids, held) if not h for x in own)
    sizes = Counter(n if n < 64 else n >> (n.bit_length() - 6) << (n.bit_length() - 6) for n in c.values())
    fits = [b for b in sizes if sum(n for other, n in sizes.items() if other >= b) <= max_head]
    head = sorted((x for x in c if fits and c[x] >= min(fits)), key=lambda x: (-c[x], x))
    top = {x: k for k, x in enumerate(head[:128])}
    class_of = lambda x: top.get(x, 128 + x % 128)
    total, size = Counter(), Counter()
    for x, n in c.items():
        total[class_of(x)] += n
        size[class_of(x)] += 1
    share = {k: total[k] + 0.1 * (size[k] + 1) for k in range(128, 256)}
    prior = np.array([share.get(k, total[k] + 1e-3) for k in range(256)]).reshape(16, 16)
    prior = np.log(prior.sum(1) / prior.sum()), np.log(prior / prior.sum(1, keepdims=True))
    weights = [np.zeros((1 << bits, 16)), np.zeros((1 << bits, 16))]

    def levels(own):
        """For each token and level: its feature rows, its target and its prior."""
        classes = np.array([class_of(x) for x in own])
        borders = np.array([0, len(own)])
        f = lm._features(np.array(own), classes, borders, bits)
        inner = lm._second(f, classes // 16, bits)
        return [[(f[k], classes[k] // 16, prior[0]), (inner[k], classes[k] % 16, prior[1][classes[k] // 16])] for k in range(len(own))]

    def chances(level, rows, before):
        z = np.exp(weights[level][rows].sum(0) + before)
        return z / z.sum()

    for t in range(steps * epochs):
        n, seen, due = ([Counter(), Counter()] for _ in range(3))
        for own, h, k in zip(ids, held, part):
            for token in levels(own) if not h and k == t % steps else ():
                for level, (rows_, target, before) in enumerate(token):
                    p = chances(level, rows_, before)
                    for f in rows_.tolist():
                        n[level][f] += 1
                        seen[level][f] = seen[level][f] + np.eye(16)[target]
                        due[level][f] = due[level][f] + p
        for level in (0, 1):
            for f, m in n[level].items():
                more = damp * np.maximum(due[level][f] / m, 1e-6)
                step = rate / (1 + 0.3 * t) * np.log((seen[level][f] + more) / (due[level][f] + more))
                weights[level][f] += np.clip(step, -3, 3)

    def context(own, k):
        """The two words before and the class, where they are chosen."""
        at, _ = lm._contexts(np.array(own), np.array([class_of(x) for x in own]), np.array([0, len(own)]), every)
        return (*[own[k - j] if k >= j else None for j in (1, 2)], class_of(own[k])) if k in at else None

    grams = Counter()
    for own, h in zip(ids, held):
        for k, x in enumerate(own):
            if not h and (about := context(own, k)) and x in head:
                grams[about] += 1
                grams[about, x] += 1
    out = []
    for own in ids:
        score = 0.0
        for k, (x, token) in enumerate(zip(own, levels(own))):
            for level, (rows_, target, before) in enumerate(token):
                score += math.log10(chances(level, rows_, before)[target])
            if x not in top:
                p = (c[x] + 0.1) / share[class_of(x)]
                if about := context(own, k):
                    p = (grams[about, x] + mass * p) / (grams[about] + mass)
                score += math.log10(p)
        out.append(score)
    return out


def test_scores_by_hand(spark):
    rng = random.Random(12)
    texts = [" ".join(f"w{int(rng.paretovariate(0.4)) % 900}" for _ in range(rng.randrange(80))) for _ in range(60)]
    texts += [texts[3], texts[4], texts[4], "", None]
    rows = list(enumerate(texts)) + [(None, texts[7])]
    settings = dict(max_head=220, bits=9, steps=2, epochs=2, rate=0.5, damp=4.0, every=2, mass=2.0)
    out = {r.doc_id: r.score for r in score_documents(spark.createDataFrame(rows, "doc_id long, text string"), **settings).collect()}
    for (i, _), score in zip(rows, scores_by_hand(rows, **settings)):
        assert out[i] == pytest.approx(score, rel=1e-4), i


def test_sums_of_training():
    """The same as counting token by token, and not dearer than a few times the chances that are summed."""
    rng = np.random.default_rng(15)
    features, target = (rng.pareto(0.5, (3000, 4)) % 512).astype(np.uint16), rng.integers(0, 16, 3000)
    weights, prior = rng.normal(0, 0.5, (512, 16)).astype(np.float32), rng.normal(0, 0.5, (3000, 16)).astype(np.float32)
    p, sums, expected = lm._chances(weights, features, prior), lm.Sums(512, 16), np.zeros((512, 33), np.int64)
    for part in (slice(0, 1), slice(1, 1900), slice(1900, 3000)):
        sums.add(features[part], p[:, part], target[part])
    for k, (rows, class_) in enumerate(zip(features, target)):
        z = np.exp(weights[rows].sum(0) + prior[k])
        assert np.allclose(p[:, k], z / z.sum(), rtol=1e-5)
        assert lm._chance(weights, features[k : k + 1], prior[k : k + 1], target[k : k + 1])[0] == p[class_, k]
        for row in rows:
            expected[row, [0, 1 + class_]] += 1
            expected[row, 17:] += np.rint(p[:, k].astype(float) * 2**20).astype(np.int64)
    assert np.array_equal(sums.table(), expected)

    def seconds(work):
        took = []
        for _ in range(3):
            start = time.process_time()
            work()
            took.append(time.process_time() - start)
        return min(took)

    features, target = (rng.pareto(0.3, (100_000, 4)) % 32_768).astype(np.uint16), rng.integers(0, 16, 100_000)
    weights, sums = rng.normal(0, 0.5, (32_768, 16)).astype(np.float32), lm.Sums(32_768, 16)
    p = lm._chances(weights, features, prior[0])
    assert seconds(lambda: sums.add(features, p, target)) < 3 * seconds(lambda: lm._chances(weights, features, prior[0]))


def test_every_context_counts(spark):
    """Unless told otherwise, no place is left out, however few a task holds at once."""
    rng = random.Random(14)
    texts = [" ".join(f"w{int(rng.paretovariate(0.4)) % 700}" for _ in range(rng.randrange(60))) for _ in range(50)]
    rows = [*enumerate([*texts, texts[5], texts[6], "", None]), (None, texts[7])]
    settings = dict(max_head=240, bits=9, steps=2, epochs=1, rate=0.5, damp=4.0, mass=2.0)
    expected = scores_by_hand(rows, every=1, **settings)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for more in ({}, {"places": 150}):
        out = {r.doc_id: r.score for r in score_documents(df, **settings, **more).collect()}
        for (i, _), score in zip(rows, expected):
            assert out[i] == pytest.approx(score, rel=1e-4), i


def test_scores_do_not_depend_on_partitions(spark, data):
    """Scores of 2 and 16 partitions, and the gain on text held out, above single counts."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    one, other = (score_documents(docs.repartition(n)).toPandas().sort_values("doc_id") for n in (2, 16))
    assert np.allclose(one["score"], other["score"], rtol=1e-6)
    out = one[one["held_out"]]
    assert (out["score"] - out["base_score"]).sum() / out["n_tokens"].sum() >= 0.3


def test_documents_that_occur_twice_are_likelier(spark):
    """The n-gram features grow with the corpus: they know what they have seen."""
    rows = [(i, prose(i, 200, 3000)) for i in range(300)] + [(1000 + i, prose(i, 200, 3000)) for i in range(40)]
    out = score_documents(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id")
    gain = (out["score"] - out["base_score"]) / out["n_tokens"]
    twice = gain[[i for i in range(40) if not out["held_out"][i] and not out["held_out"][1000 + i]]]
    once = gain[[i for i in range(40, 300) if not out["held_out"][i]]]
    assert (twice.to_numpy()[:, None] > once.to_numpy()[None, :]).mean() > 0.9


# Packing -------------------------------------------------------------------


def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_encoder():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(paths()[0]), Encoder(*paths())
    rng = random.Random(5)
    parts = [" ", "  ", "\n", "\t", "é", "a", "the", "ing", "It's", "'ll", "12", "½", "²", "漢", "🙂", "<|endoftext|>", "...", "_", "\x1c", "\xa0", "ª", "×", "A", "\r\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_encoder_parts_blocks_of_texts():
    """Any white space between and about words gives the tokenizer's ids; a block's words are looked up together."""
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(paths()[0]), Encoder(*paths())
    texts = ["".join(x) for n in range(7) for x in itertools.product([" ", "\n", "\t", "é", "'s,"], repeat=n)]
    texts += ["", "漢 字", "<|endoftext|> a", "a\r\nb", None, "It's (so), he says\nend.", "\x1c a"]
    texts = pa.chunked_array([["left out", *texts]]).chunk(0)[1:]
    for text, ids in zip(texts.to_pylist(), own.encode_all(texts)):
        assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids, repr(text)
    assert {b"It's", b" (so),", b" he", b"end."} <= own.parts.keys() and own.encode_all(pa.array([], pa.string())) == []


def check_packing(rows, pieces, window=2048):
    """Every id in one piece, gapless sequences, nothing padded."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(paths()[0])
    expected, found = Counter(), Counter()
    ids = {}
    for i, t in rows:
        own = library.encode(t or "", add_special_tokens=False).ids + [1]
        ids.setdefault((i, len(own)), []).append(own)
        for k, x in enumerate(own):
            expected[i, len(own), k, x] += 1
    sequences = defaultdict(list)
    for p in pieces:
        own = next(x for x in ids[p.doc_id, p.doc_tokens] if zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32)
        for k in range(p.start, p.start + p.length):
            found[p.doc_id, p.doc_tokens, k, own[k]] += 1
        sequences[p.sequence_id].append((p.offset, p.length))
    assert found == expected
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window and (at == window or at & (at - 1) == 0)


def test_packing(spark, documents, nothing, odd_rows, data):
    check_packing(odd_rows, pack(documents, *paths(), docs_per_shard=5).collect())
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    check_packing(rows, entries.QUERIES["op10_packing"](spark, data).collect())
    assert pack(nothing, *paths()).count() == 0
    some = pack(spark.createDataFrame(odd_rows[:3], "doc_id long, text string"), *paths(), window=64, with_ids=True)
    for r in some.collect():
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32


def test_neighbours_share_windows(spark):
    """Documents of one subject are packed with each other."""
    rng = random.Random(8)
    words = [[f"{chr(97 + k)}{rng.randrange(10**6)}" for _ in range(40)] for k in range(4)]
    rows = [(i, " ".join(rng.choice(words[i % 4]) for _ in range(60))) for i in range(200)]
    out = pack(spark.createDataFrame(rows, "doc_id long, text string"), *paths(), window=1024).collect()
    subjects = defaultdict(Counter)
    for r in out:
        subjects[r.sequence_id][r.doc_id % 4] += r.length
    assert sum(max(s.values()) for s in subjects.values()) > 0.8 * sum(sum(s.values()) for s in subjects.values())


def test_neighbours_are_those_of_unpruned_bm25():
    """A shard's scores against every id of every remainder, with the statistics of the corpus."""
    rng = np.random.default_rng(3)
    corpus = [np.minimum(rng.zipf(1.3, rng.integers(1, 300)), 60_000).astype("<u2") for _ in range(300)]
    df = np.bincount(np.concatenate([np.unique(x) for x in corpus]), minlength=65536)
    mean = np.mean([len(x) for x in corpus])
    own = corpus[:80]
    shard = Shard(own, 256, Terms(len(corpus), sum(map(len, corpus)), df))
    counts = [Counter(x.tolist()) for x in own]
    for seed in range(0, 80, 7):
        expected = []
        for d, c in enumerate(counts):
            norm = 1.2 * (0.25 + 0.75 * len(own[d]) / mean)
            expected.append(sum(math.log1p((300 - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + norm) for t in set(counts[seed]) & set(c)))
        others = [d for d in range(80) if d != seed]
        found = shard.scores(seed)
        assert np.allclose(found[others], np.array(expected)[others], rtol=1e-5)
        ranked = [d for d in shard.neighbours(seed).tolist() if d != seed]
        assert all(expected[a] >= expected[b] * (1 - 1e-5) for a, b in zip(ranked, ranked[1:])) and len(ranked) == sum(expected[d] > 0 for d in others)


def test_many_equal_rows_are_many_shards(spark):
    """Rows that are all alike, without ids, fill shards of a bounded size in turn."""
    rows = [(None, None)] * 3000 + [(None, "the same few words")] * 3000 + [(k, prose(k, 30)) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    out = pack(df, *paths(), docs_per_shard=100).collect()
    check_packing(rows, out)
    assert len({r.sequence_id for r in out}) >= 62  # some for each shard
    first = next(r for r in out if r.doc_id == 5)
    assert sum(r.doc_id is None for r in out if r.sequence_id == first.sequence_id) < 100


def test_like_documents_meet_in_a_shard():
    """Near copies have the same first MinHash nearly as often as they overlap."""
    rng = np.random.default_rng(5)
    base = [rng.integers(2, 40_000, 200).astype("<u2") for _ in range(400)]
    near = [np.concatenate([x[:190], rng.integers(2, 40_000, 10).astype("<u2")]) for x in base]
    terms = Terms(800, 160_000, np.bincount(np.concatenate([np.unique(x) for x in base + near]), minlength=65536))
    a, b = terms.content(base), terms.content(near)
    assert (a[:, 0] == b[:, 0]).mean() > 0.8 and (a == b).any(1).mean() > 0.95
    assert len(np.unique(a[:, 0])) > 200 and (terms.content(base[:3]) == a[:3]).all()


# Pipeline ------------------------------------------------------------------


def test_pipeline_runs(spark, data):
    """run() is the stages, each reread from a table; its pieces are those of the documents that stay."""
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    out = corpus_pipeline.run(spark, data).collect()
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, data).collect(), docs.schema)
    check_packing([(r.doc_id, r.text) for r in docs.collect()], out)


def test_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, counts = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, data).collect(), docs.schema)
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "near_duplicates":
            expected = classes(sorted(before.items()))
            assert set(after) == {i for i, c, _ in expected if i == c}
        if name == "lines":
            assert len(after) == len(before) and docs.where("n_chars <> length(text)").count() == 0
        counts.append(len(after))
    check_packing([(r.doc_id, r.text) for r in docs.collect()], corpus_pipeline.STAGES[-1][1](spark, docs, data).collect())
    assert counts[0] > 100


def test_pipeline_edges(spark, documents, nothing, data):
    for df in (documents, nothing):
        docs = df
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, data)
        corpus_pipeline.STAGES[-1][1](spark, docs, data).count()
