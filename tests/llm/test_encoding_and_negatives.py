"""BPE round trips, fill-in-the-middle and hard negatives against libraries and brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shalebed.llm import entries, hard_negatives
from shalebed.llm.fill_in_middle import fill_in_middle, place_of, rearranged, restored, token_ends
from shalebed.llm.hard_negatives import Approximation, bounds, mine_negatives
from shalebed.llm.word_bpe import WordEncoder, decode_ids, encode_texts

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def word_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def machine(word_path):
    return WordEncoder(word_path)


@pytest.fixture(scope="module")
def library(word_path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_path)


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


# BPE -----------------------------------------------------------------------


def test_round_trip(spark, documents, nothing, odd_rows, word_path, library):
    both = decode_ids(encode_texts(documents, word_path), word_path)
    assert both.columns == [*documents.columns, "ids", "decoded"]
    found = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in both.collect())
    expected = Counter()
    for i, text in odd_rows:
        ids = ids_of(library, text or "")
        expected[i, tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    assert found == expected
    assert decode_ids(encode_texts(nothing, word_path), word_path).count() == 0


def test_round_trip_query(spark, data, library):
    found = {r.doc_id: r for r in entries.QUERIES["op11_bpe_round_trip"](spark, data).collect()}
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(rows)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for doc_id, text in rows:
        ids = ids_of(library, text or "")
        r = found[doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("abcdeirstn' ", max_size=60), st.text("aAéÉΣσς'<|>endoftx́̈ \x1c\x85\xa0", max_size=40)))
def test_any_text(machine, library, text):
    assert machine.encode(text).tolist() == ids_of(library, text)


def test_every_character(machine, library):
    """Also those that are newer than one of the Unicode tables involved."""
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and (i < 0x3000 or unicodedata.category(chr(i)) != "Co")]
    texts = ["a" + "b~a".join(points[i : i + 2000]) for i in range(0, len(points), 2000)]
    for text, theirs in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert machine.encode(text).tolist() == theirs.ids, hex(ord(text[1]))


def test_pieces_side_by_side(machine, library):
    """Words made of random pieces, for which a greedy match is often wrong."""
    rng = random.Random(5)
    names = [s.removesuffix("</w>") for s in library.get_vocab() if s.isascii() and s.islower() and s.removesuffix("</w>").isalpha()]
    words = ["".join(rng.choice(names) for _ in range(rng.randrange(2, 5))) for _ in range(5000)]
    ids, ends = machine.encode_words(words)
    merged = failing = 0
    for word, theirs, a, b in zip(words, library.encode_batch(words, add_special_tokens=False), [0, *ends], ends, strict=False):
        assert ids[a:b].tolist() == theirs.ids
        symbols = [*word.encode()]
        symbols[-1] += 256
        assert machine.merged(symbols) == theirs.ids
        data = np.array(symbols)
        failing += machine.propose(data, np.array([len(data)]))[0].tolist() != theirs.ids
        merged += 1
    assert merged == 5000 and 100 < failing < 4000


@pytest.mark.parametrize("text", ["x" * 150_000, "ab" * 60_000, "word " * 40_000, "漢字" * 30_000, "<|endoftext|>" * 3000])
def test_long_texts(machine, library, text):
    assert machine.encode(text, 10_000).tolist() == ids_of(library, text)


def test_decoding_of_any_ids(spark, word_path, library):
    rows = [(1, [49407, 320, 5]), (2, []), (3, None), (4, [-1, 70_000, 320, None]), (5, [320] * 5)]
    found = decode_ids(spark.createDataFrame(rows, "doc_id long, ids array<int>"), word_path)
    ids = {i: [x for x in ids or [] if x is not None and 0 <= x < 49408] for i, ids in rows}
    assert {r.doc_id: r.decoded for r in found.collect()} == {i: library.decode(x, skip_special_tokens=False) for i, x in ids.items()}


def test_words_are_forgotten(machine, library):
    texts = [" ".join(f"w{i}x{k}" for k in range(50)) for i in range(20)]
    machine._words_known.size = 10**9
    import pyarrow as pa

    ids, ends = machine.encode_rows(pa.array(texts, pa.large_string()))
    assert machine._words_known.size < 10**6
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [ids_of(library, t) for t in texts]


def test_other_vocabularies_are_errors(tmp_path):
    import public_tokenizers

    with pytest.raises((ValueError, KeyError, TypeError)):
        WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))


# Fill in the middle ---------------------------------------------------------


def by_hand(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    hashed = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hashed[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark, documents, nothing, odd_rows):
    texts = [" a  b c", "a b\n", "é 漢字 🙂 ", "x <P> y", "<S", ">M> a <", "\t", "a <M>", "P> <S P>"]
    rows = odd_rows + [(100 * k + j, t) for j, t in enumerate(texts) for k in range(1, 30)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, form string").repartition(3)
    found = fill_in_middle(df)
    assert found.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    back = found.withColumn("back", restored(found.output, found.form)).collect()
    assert Counter((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in back) == Counter((i, t, *by_hand(i, t)) for i, t in rows)
    assert all(r.back == (r.text or "") for r in back)
    assert {r.form for r in back} == {"plain", "psm", "spm"}
    assert fill_in_middle(documents).count() == len(odd_rows) and fill_in_middle(nothing).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab \t\n\x0b\x0c\ré漢🙂\x1c\xa0"), max_size=80))
def test_token_ends(text):
    data, tokens = text.encode(), TOKEN.findall(text)
    mask = token_ends(data)
    assert mask.bit_count() == len(tokens)
    for k in range(1, len(tokens) + 1):
        assert data[: place_of(mask, k, len(data)) + 1].decode() == "".join(tokens[:k])


def test_rates():
    forms = Counter(rearranged(i, b"a b c d", 42, 90, 30)[1] for i in range(3000))
    assert abs(forms["plain"] - 300) < 80 and abs(forms["spm"] - 810) < 120


# Hard negatives -------------------------------------------------------------


def mined(rows, anchor_of, positives=5, negatives=3):
    """Plain Python over (vec_id, label, vector) rows, each a row of its own."""
    sound = [(i, lab, v) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in sound]
    found = Counter()
    for k, (i, lab, v) in enumerate(whole):
        if not anchor_of(i):
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=False)), j, m) for n, (j, m, w) in enumerate(whole) if n != k]
        for p, j, _ in sorted(s for s in scored if s[2] == lab)[:positives]:
            inside = sorted(s for s in scored if s[2] != lab and 50 * -p <= 100 * -s[0] <= 95 * -p)[:negatives]
            for rank, (s, m, _) in enumerate(inside, 1):
                found[i, j, rank, m, -p, -s] += 1
    return found


def vectors_of(seed, n, dims=6, spread=1.0):
    rng = random.Random(seed)
    return [(i, rng.randrange(3), [rng.choice([rng.gauss(0, spread), 0.25, -0.5]) for _ in range(dims)]) for i in range(n)]


ODD = [
    (1001, 1, None), (1002, None, [0.5] * 6), (1003, 1, [0.5, None, 1.0, 1.0]), (1004, 1, [float("nan")] * 6), (1005, 2, [float("inf"), 0.0]),
    (None, 1, [0.5] * 6), (1010, 1, [0.5, 0.25]), (1015, 2, []), (1020, 0, [0.5] * 7), (1021, 1, [0.5] * 6), (1022, 1, [0.5] * 6), (1030, 0, [-3.0, 100.0, 0.0, 0.0, 0.0, 2.0]),
]


@pytest.mark.parametrize("size", [(4096, 512), (37, 5)])
def test_negatives(spark, monkeypatch, size):
    monkeypatch.setattr(hard_negatives, "ROWS", size[0])
    monkeypatch.setattr(hard_negatives, "ANCHORS", size[1])
    rows = vectors_of(1, 220) + ODD + vectors_of(1, 220)[10:14] * 2 + [(1010, 1, [0.5, 0.25])] * 3
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, label int, embedding array<double>, rank int").repartition(3)
    found = Counter(tuple(r) for r in mine_negatives(df, df.vec_id % 5 == 0).collect())
    assert found == mined(rows, lambda i: i % 5 == 0)
    assert len(found) > 300


def test_negatives_of_one_common_vector(spark):
    rows = [(i, i % 2, [1.0, 0.5] if i % 3 else [0.75, 0.5]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    assert Counter(tuple(r) for r in mine_negatives(df, df.vec_id % 50 == 0).collect()) == mined(rows, lambda i: i % 50 == 0)


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert mine_negatives(df, df.vec_id % 50 == 0).collect() == []
    df = spark.createDataFrame([(1, 1, [0.5]), (2, 1, [0.25])], df.schema)
    assert mine_negatives(df, df.vec_id % 50 == 0).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 9), st.sampled_from([3, 300, 2**20]))
def test_bounds_hold(seed, dims, top):
    rng = np.random.default_rng(seed)
    v = rng.integers(-top, top + 1, (200, dims))
    edges = np.quantile(v, np.linspace(0, 1, 17), axis=0, method="lower").T.astype(np.int64)
    edges[:, 0], edges[:, -1] = np.minimum(edges[:, 0], 0), np.maximum(edges[:, -1], 0)
    shape = Approximation(edges)
    codes = shape.codes(v)
    low, high = shape.tables(v[0])
    score = v @ v[0]
    assert (bounds(low, codes) <= score).all() and (score <= bounds(high, codes)).all()
