"""Quality rules, licenses, line dedup, token counts and HTML against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import pytest
from llm_prose import prose
from pyspark.sql import functions as F

from shalebed.llm import entries, html_extraction
from shalebed.llm.html_extraction import extract_text, main_text
from shalebed.llm.license_scan import PHRASES, TEMPLATES, Automaton, scan_licenses
from shalebed.llm.line_dedup import dedup_lines
from shalebed.llm.quality_rules import bucket_of, judge_quality, keep_good, measure_texts
from shalebed.llm.token_counts import Transducer, Vocabulary, count_tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", sorted(entries.SQL))
def test_sql(same_as_sql, name):
    assert same_as_sql(entries.QUERIES[name], entries.SQL[name])


# Quality -------------------------------------------------------------------


def measured(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_measures(spark, documents, odd_rows):
    extra = [(20, "a b c a b c"), (21, "x x x x x x"), (22, "p q\np q\n \np q # $"), (23, "a b c d a b c")]
    rows = odd_rows + extra
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = Counter((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in measure_texts(df).collect())
    assert found == Counter((i, measured(t)) for i, t in rows)


def test_quality_edges(documents, nothing, odd_rows):
    out = judge_quality(documents, shrink=1)
    rows = out.collect()
    assert len(rows) == len(odd_rows)
    assert all(r.kept is not None for r in rows)
    assert all(not r.kept for r in rows if r.base_failed)
    assert {r.doc_id for r in rows if r.kept} >= {1, 5, 6}
    assert judge_quality(nothing).count() == 0
    kept = keep_good(documents, shrink=1)
    assert kept.columns == documents.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in rows if r.kept)


def test_quality_fences(spark):
    """Symbols that are usual in one source are not in another; clean rows stay."""
    rng = random.Random(0)
    text = lambda share: " ".join(("#" if rng.random() < share else "") + f"w{rng.randrange(9999)}" for _ in range(80))
    rows = [(i, text(0.0), "en", "clean") for i in range(300)] + [(1000 + i, text(0.9), "en", "tags") for i in range(300)]
    rows += [(5000, text(0.9), "en", "clean"), (5001, text(0.9), "en", "tiny")]
    kept = {r.doc_id: r.kept for r in judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(kept[i] for i in range(300)) >= 297
    assert sum(kept[1000 + i] for i in range(300)) >= 297
    assert not kept[5000]


def test_quality_adapts(spark):
    """No constant decides where quartiles are 0: what is far for one source isn't for another, at any scale."""
    rng = random.Random(4)

    def text(signs, length):
        return " ".join("#" * (rng.random() < signs) + "w" * length + str(rng.randrange(10**4)) for _ in range(120))

    rows = [(i, text(0.0, 3), "en", "plain") for i in range(1000)] + [(2000 + i, text(0.0, 30), "en", "long") for i in range(1000)]
    rows += [(4000, text(0.2, 9), "en", "plain"), (4001, text(0.2, 90), "en", "long")]
    kept = {r.doc_id: r.kept for r in judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), shrink=20).collect()}
    assert sum(kept[i] for i in (*range(1000), *range(2000, 3000))) >= 1994
    # Signs and word lengths that neither source has; those of one source in the other.
    assert not kept[4000] and not kept[4001]
    assert not any(r.kept for r in judge_quality(spark.createDataFrame([*rows[:2000], (4004, text(0.0, 30), "en", "plain"), (4005, text(0.0, 3), "en", "long")], "doc_id long, text string, lang string, source string"), shrink=20).where("doc_id >= 4000").collect())


def test_quality_tells_null_from_empty(spark):
    rows = [(1, prose(1, 90), lang, source) for lang in (None, "") for source in (None, "")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert keep_good(df).count() == 8
    assert keep_good(df.drop("lang", "source")).count() == 8


def test_buckets(spark):
    values = [*range(200), 1000, 12345, 10**9, 2**40 + 12345]
    for v, b in spark.createDataFrame([(v,) for v in values], "v long").select("v", bucket_of(F.col("v"))).collect():
        assert b <= v and v - b <= v / 32


# Lines ---------------------------------------------------------------------


def deduped(rows, min_chars, min_docs):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(ASCII)
    holders = defaultdict(set)
    lowest = lambda i: -(2**63) if i is None else i
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(lowest(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        bad = [len(key(x)) >= min_chars and len(holders[key(x)]) >= min_docs and max(holders[key(x)]) != lowest(i) for x in lines]
        out.append((i, len(lines), sum(bad), "\n".join(x for x, b in zip(lines, bad) if not b)))
    return Counter(out)


def test_line_dedup(spark, documents, nothing, odd_rows):
    rng = random.Random(4)
    pool = [f"Shared LINE number {k} of the pool É" for k in range(6)] + ["short", "", "  padded shared line of the pool  "]
    rows = odd_rows + [(100 + i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9)))) for i in range(40)]
    rows += [(200, "\n".join([pool[0]] * 5000))]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n_lines string, other int").repartition(5)
    out = dedup_lines(df, min_chars=20, min_docs=3)
    assert out.columns == ["doc_id", "text", "other", "n_lines", "n_dropped"]
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()) == deduped(rows, 20, 3)
    assert dedup_lines(nothing).count() == 0


# Licenses ------------------------------------------------------------------


def test_license_base(spark, documents, nothing):
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    texts = [
        "Released UNDER the MIT-License. under the mit license", "Apache License, Version 2.0; apache license version 20", "cc by nc nc cc-by-nc", None, "",
        "The MIT License", "xunder the mit license", "under the mit\nlicense é",
    ]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    for r in scan_licenses(df).collect():
        own = words.findall((texts[r.doc_id] or "").translate(ASCII))
        places = [(i, label) for p, label in PHRASES.items() for i in range(len(own)) if own[i : i + len(p.split())] == p.split()]
        starts = [p[0] for p in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(own), len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({p[1] for p in places}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1
    assert scan_licenses(documents).count() == documents.count()
    assert scan_licenses(nothing).count() == 0


def test_license_templates(spark):
    mit, grant = TEMPLATES["mit"][0], "the warranties of"
    filled = re.sub(r"<</?optional>>", "", re.sub(r"<<any \d+-\d+>>", "noninfringement", mit))
    bare = re.sub(r"<<optional>>.*?<</optional>>", "", re.sub(r"<<any \d+-\d+>>", "the authors", mit), flags=re.S)
    bsd3 = re.sub(r"<</?optional>>", "", re.sub(r"<<any \d+-\d+>>", "acme", TEMPLATES["bsd-3"][0]))
    cases = {
        filled: "mit",
        f"{'x ' * 3000}{bare} and more": "mit",
        filled.replace("free of charge", "at no charge"): "",
        filled[: filled.lower().index(grant)] + " provided that no commercial use is made": "",
        bsd3: "bsd-3",
        bsd3.replace("endorse", "praise"): "",
        "This work is licensed under the GNU General Public License, version 3.": "gpl-3",
        "licensed under the terms of the GNU General Public License version 2": "gpl-2",
        "All rights reserved.": "reserved",
        "rights reserved": "",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    assert {r.doc_id: r.labels for r in scan_licenses(df).collect()} == dict(enumerate(cases.values()))


def test_long_wordings(spark):
    """A wording of any length is accepted, and only as a whole."""
    wording = prose(11, 1500)
    df = spark.createDataFrame([(1, f"before {wording} after"), (2, wording.rsplit(" ", 1)[0])], "doc_id long, text string")
    found = {r.doc_id: (r.labels, [tuple(m) for m in r.matches]) for r in scan_licenses(df, {}, {"own": [wording]}).collect()}
    assert found == {1: ("own", [(1, 1500, "own")]), 2: ("", [])}


#: Markup over few words, so that random texts meet it.
MARKUP = [
    "a <<optional>> b <</optional>> c <<any 1-2>> d",
    "<<any 1-3>> a b",
    "<<any 0-3>> b <<optional>> c d <</optional>>",
    "<<optional>> a <<any 0-1>> <</optional>> b c",
    "<<optional>> c <<optional>> d <</optional>> <</optional>> a <<any 0-2>>",
    "b",
]


def test_templates_are_regular_expressions(spark):
    """Each place against all (start, end) that a regular expression of the markup accepts."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(14))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for markup in MARKUP:
        marks = {"<<optional>>": "(?:", "<</optional>>": ")?"}
        parts = [marks.get(m) or re.sub(r"<<any (\d)-(\d)>>", r"(?:. ){\1,\2}", m if m.startswith("<<") else f"{m} ") for m in re.findall(r"<<[^>]*>>|\w+", markup)]
        pattern = re.compile("".join(parts))
        for r in scan_licenses(df, {}, {"t": [markup]}).collect():
            own = texts[r.doc_id].split()
            spans = {(i, j) for i in range(len(own)) for j in range(i + 1, len(own) + 1) if pattern.fullmatch("".join(f"{w} " for w in own[i:j]))}
            places = {(m.start, m.start + m.length) for m in r.matches}
            assert places <= spans, (markup, own)
            # The places are the accepted wordings that lie in no other one.
            assert places == {(i, j) for i, j in spans if not any(a <= i and j <= b and (a, b) != (i, j) for a, b in spans)}, (markup, own)
            assert (r.labels == "t") == bool(spans)
            assert r.score == (len({k for a, b in places for k in range(a, b)}) / len(own) if own else 0)


def test_automaton():
    from shalebed.llm.arrow_words import hash_words

    machine = Automaton("a <<optional>> b <</optional>> c <<any 1-2>> d")
    accepts = lambda text: machine.longest(hash_words(text.split()), 0) == len(text.split())
    assert all(map(accepts, ["a b c x d", "a c x d", "a c x y d"]))
    assert not any(map(accepts, ["a c d", "a c x y z d", "a b b c x d", "b c x d"]))
    for wrong in ("<<optional>> a <</optional>>", "a <<optional>> b", "a <</optional>>", "a <<maybe>> b"):
        with pytest.raises(ValueError):
            Automaton(wrong)


# Tokens --------------------------------------------------------------------


def model():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    return path, sentencepiece.SentencePieceProcessor(model_file=path)


def test_tokens(spark, documents, nothing, odd_rows):
    path, library = model()
    rows = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(documents, path).collect())
    sized = [(i, t or "", len(library.encode(t or ""))) for i, t in odd_rows]
    assert rows == Counter((i, len(t.encode()), n, n > 4096) for i, t, n in sized)
    assert count_tokens(nothing, path).count() == 0


def test_transducer_on_random_texts():
    path, library = model()
    rng = random.Random(7)
    parts = [" ", "  ", "\n", "\t", "é", "a", "the", "ing", "▁", "漢", "字", "🙂", "<s>", "</s>", "<0x0A>", "\x00", "ﬁ", "'", "1", "23", "ß", "́", "A", "Th"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += [" " * k for k in range(300)] + ["a" + " " * k + "b" for k in range(150)] + ["the" * k for k in range(150)]
    expected = [len(library.encode(t)) for t in texts]
    machine = Transducer(Vocabulary.load(path))
    assert machine.count(texts).tolist() == expected
    assert machine.count(texts, chunk=5).tolist() == expected  # states meet across chunks
    small = Transducer(Vocabulary.load(path), max_entries=1)  # starts anew each time
    assert [small.count([t])[0] for t in texts[:200]] == expected[:200]
    for segment in (1, 7, 1000):  # a text is read in segments, and the machine starts anew between them
        assert machine.count(texts[:300], chunk=5, segment=segment).tolist() == expected[:300]
        assert small.count(texts[:60] + texts[-40:], segment=segment).tolist() == expected[:60] + expected[-40:]


def test_texts_without_word_borders():
    """Their chunks' maps are composed: no step for each character."""
    path, library = model()
    rng = random.Random(8)
    machine = Transducer(Vocabulary.load(path))
    texts = ["=" * 160_000, "a" * 160_001, "0" * 9000, "ab" * 30_000, "the" * 20_000 + "=" * 5000, "".join(rng.choice("=-a") for _ in range(40_000))]
    texts += ["x " + "=" * 3000 + " y", "=" * 700 + "ß" + "=" * 900, f"{'=' * 2000} {'a' * 2000}\n{'-' * 2000}"]
    expected = [len(library.encode(t)) for t in texts]
    assert machine.count(texts).tolist() == [machine.count([t])[0] for t in texts] == expected
    assert machine.count(texts[3:], chunk=50, segment=1234).tolist() == expected[3:]
    for text in ("=" * 160_000, "a" * 160_000):
        began = time.perf_counter()
        machine.count([text])
        assert time.perf_counter() - began < 0.6  # 0.3 s, twice that for a slow machine
    mega = "".join(rng.choice("abcdefghij") for _ in range(1_000_000))
    part = len(library.encode(mega[:20_000]))
    assert machine.count([mega[:20_000]])[0] == part and 45 * part < machine.count([mega])[0] < 55 * part


# HTML ----------------------------------------------------------------------

BODY = "".join(f"<p>Paragraph {i}, with some text, and commas, of a decent length to count here.</p>" for i in range(4))
TEXT = " ".join(f"Paragraph {i}, with some text, and commas, of a decent length to count here." for i in range(4))


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        (f"<body><div id=header><a href=/>Logo</a><p>Tag, line</p></div><div id=main><h1>T</h1>{BODY}</div><div id=footer>foot</div></body>", f"T {TEXT}"),
        (f"<main><article><h1>T</h1>{BODY}<section class=comments><p>{'bla, ' * 300}</p></section></article></main>", f"T {TEXT}"),
        (f"<div class=post>{BODY}<div class='ad-slot'>Buy, buy</div><form><p>Sign, up</p></form></div><div id=comments>{'<p>c, c</p>' * 30}</div>", TEXT),
        (f"<noscript>Enable</noscript>{BODY}<div style='display:none'>hid</div><script>if(a<b){{x('</p>')}}</script>", TEXT),
        ("<article><h1>A &amp;amp; B</h1><p>x<br>y  z<b>b</b>old</article>", "A &amp; B x y zbold"),
        (f"<div class='topnav'><p>a, b, c, d and more text</p></div><div class=story>{BODY}</div><ol class=commentlist><li>me, too, of a decent length</ol>", TEXT),
        (f"<div class='page-notice'><p>We updated, our terms, and so on</p></div><section>{BODY}<blockquote>Quote, it</blockquote></section>", f"{TEXT} Quote, it"),
        (f"<article class='card'><h2>Teaser</h2><p>One, two.</p></article><article class='main'>{BODY * 3}</article>", " ".join([TEXT] * 3)),
        ("<article><header><h1>T</h1><p>By someone</p></header><p>Body.</p><footer>Tags</footer></article>", "T By someone Body."),
        ("", ""),
        ("plain", "plain"),
    ],
)
def test_main_text(page, expected):
    assert main_text(page) == expected


ONE = "One paragraph of a part of its own, with a comma, another, and a third one, and after that it goes on without any for as long as it takes to be of some three hundred characters, which is a usual length of a paragraph in a short part of an article that has several of them beside the longest of all."


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        # A form around the page.
        (
            f"<body><form id=aspnetForm action=p.aspx><input type=hidden value=v><div id=nav><a href=/>Home</a></div><div id=content><h1>T</h1>{BODY}</div>"
            "<label>Find <input></label><select><option>One, two</select><textarea>Write, here</textarea><button>Go</button></form><div id=footer>Foot</div></body>",
            f"T {TEXT}",
        ),
        (f"<form><fieldset><legend>T</legend><div>{BODY}</div></fieldset></form>", f"T {TEXT}"),
        (f"<div id=comments>{'<p>c, c, c</p>' * 99}</div><form class=page><select><option>x</select><article><p>Short, text.</p></article><button>Go</button></form>", "Short, text."),
        (f"<div>{BODY}<form><p>Your name, please</p><button>Go</button></form></div>", TEXT),
        # Parts beside the best one.
        *[(f"<div><div>{BODY * 3}</div><{x}><p>{ONE}</p></{x}></div>", " ".join([TEXT] * 3 + [ONE])) for x in ("div", "section")],
        (f"<div><div>{BODY * 3}</div><ul><li>First point<li>Second point</ul><table><tr><td>1<td>2</table></div>", " ".join([TEXT] * 3 + ["First point Second point 1 2"])),
        (f"<div>Before <b>it</b>, text.<div>{BODY * 3}</div><div><div><p>{ONE}</p></div></div>after <a href=/>a link</a></div>", " ".join(["Before it, text."] + [TEXT] * 3 + [ONE])),
        (f"<body><div><div><div>{BODY * 3}</div></div></div><div><div><p>{ONE}</p></div></div></body>", " ".join([TEXT] * 3 + [ONE])),
        (f"<div><div>{BODY}</div><div><a href=/a>A link to another page, and more</a> <a href=/b>One more, of them</a></div></div>", TEXT),
    ],
)
def test_article_is_whole(page, expected):
    assert main_text(page) == expected


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        # Links beside the article and their headings, in main and out of it.
        (f"<main><article><h1>T</h1>{BODY}</article><div>Read next <a href=/1>Other story one</a> <a href=/2>Other story two</a></div></main>", f"T {TEXT}"),
        (f"<main><h1>T</h1>{BODY}<h2>Read next</h2><ul><li><a href=/1>Other story one</a><li><a href=/2>Other story two</a></ul></main>", f"T {TEXT}"),
        (f"<main><h1>T</h1><div>{BODY}</div><h2>More</h2><p>{ONE}</p><h3>Read on</h3><div><a href=/1>Other story one</a></div></main>", f"T {TEXT} More {ONE}"),
        (f"<main><h1>T</h1><article>{BODY * 3}</article><article class=card><h2>Teaser</h2><p>One, two.</p></article></main>", " ".join(["T"] + [TEXT] * 3)),
        (f"<body><h1>T</h1>{BODY}<div><a href=/1>Other story one</a></div></body>", f"T {TEXT}"),
        # A name ends in what it says.
        (f"<article>{BODY}<p class='weather-alert-story'>{ONE}</p></article>", f"{TEXT} {ONE}"),
        (f"<article>{BODY}<p class='story-alert'>{ONE}</p><div class='story-comments'><p>{ONE}</p></div></article>", TEXT),
        (f"<div><div class=post>{BODY}</div><div class='sidebar-content'><p>Look, here</p></div></div>", TEXT),
        # No article, no main.
        (f"<table><tr><td><a href=/>Home</a></td><td>{BODY}</td></tr></table>", TEXT),
        (f"<div class=wrap>{BODY}</div>", TEXT),
        # Broken markup.
        (f"<div><p title=it's>One, two.</p><p>It's three, four.</p>{BODY}</div>", f"One, two. It's three, four. {TEXT}"),
        (f"<div>{BODY}a < b, <b c</div>", f"{TEXT} a < b, <b c"),
        (f"<p title='a > b'>{ONE}</p></section></b>{BODY}", f"{ONE} {TEXT}"),
    ],
)
def test_main_text_of_parts(page, expected):
    assert main_text(page) == expected


IDS = (
    "related-work sharing-memory cookies comments-in-c navigation menu-design social-effects notices-of-error copyright-law trending-up login-flow "
    "hidden-markov-models search-trees"
)


@pytest.mark.parametrize("name", IDS.split())
def test_sections_named_by_their_headings_stay(name):
    """As Markdown is rendered: ids are the heading's words, on it, on the section or on both."""
    title = name.replace("-", " ").capitalize()
    for head, part in ((f" id={name}", ""), ("", f" id={name}"), (f" id={name}", f" id={name}")):
        for around in ("article", "main", "div"):
            page = f"<body><{around}><h1>T</h1>{BODY}<section{part}><h2{head}>{title} <a href='#{name}'>#</a></h2><p>{ONE}</p></section></{around}></body>"
            assert main_text(page) == f"T {TEXT} {title} # {ONE}", (name, head, part, around)
    if "-" in name and name != "search-trees":
        assert main_text(f"<article><h1>T</h1>{BODY}<section id={name}><h2>Another</h2><p>{ONE}</p></section></article>") == f"T {TEXT} Another {ONE}"


@pytest.mark.parametrize(
    "part",
    [
        f"<div id=comments><h2>Comments</h2><p>{ONE}</p></div>",
        f"<section id=comment-list-2><h3>2 replies</h3><p>{ONE}</p></section>",
        "<div id=ad-slot><p>Buy, buy, and buy again</p></div>",
        "<div id=left-sidebar><h3>About</h3><p>Me, and others</p></div>",
        "<section id=newsletter><h3>Newsletter</h3><p>Our stories, by mail</p><input name=mail></section>",
        "<section id=related-stories><h3>Related stories</h3><div><h4><a href=/1>One</a></h4><p>A teaser, of one</p></div><div><h4><a href=/2>Two</a></h4><p>Another</p></div></section>",
        "<div id=trending><h3>Trending</h3><ul><li><a href=/1>Story one</a><li><a href=/2>Story two</a></ul></div>",
        f"<aside id=related-work><h3>Related work</h3><p>{ONE}</p></aside>",
        f"<section class=comments id=comments-in-c><h3>Comments in C</h3><p>{ONE}</p></section>",
    ],
)
def test_ids_with_a_second_sign_go(part):
    assert main_text(f"<article><h1>T</h1>{BODY}{part}</article>") == f"T {TEXT}"


def test_points_of_random_trees():
    """Points, characters and characters in links, by going up from every paragraph of a tree."""
    rng = random.Random(11)

    def grown(depth):
        kind = rng.choice(["p", "p", "a", "div", "div", "section", "text"] if depth < 7 else ["p", "text"])
        text = "".join(rng.choice(["word ", "longer words ", "a, b, "]) for _ in range(rng.randint(1, 30))).strip()
        if kind == "text":
            return "", text, []
        if kind in ("p", "a"):
            return kind, text, []
        below = [grown(depth + 1) for _ in range(rng.randint(1, 4))]
        return kind, "", [x for before, x in zip([None, *below], below) if x[0] or before is None or before[0]]  # texts beside each other are one

    def markup(node):
        kind, text, below = node
        return text + " " if not kind else f"<{kind}{' href=/' if kind == 'a' else ''}>{text}{''.join(map(markup, below))}</{kind}>"

    for _ in range(50):
        tree = ("div", "", [("section", "", [("p", "Text, of a paragraph", [])]), grown(1), ("div", "", [])])
        root = html_extraction.parse(markup(tree))
        order = html_extraction._walk(root)
        html_extraction._score(root, order)
        points, shares = {}, {}

        def measure(node):
            kind, text, below = node
            inner = [measure(x) for x in below]
            chars = len(text) + sum(c for c, _ in inner)
            linked = chars if kind == "a" else sum(k for _, k in inner)
            shares[id(node)] = (chars, linked)
            return chars, linked

        def spread(node, above):
            kind, text, below = node
            chars, linked = shares[id(node)]
            own = text if kind == "p" else " ".join(x[1] + " " for x in below if not x[0]).strip() if kind in ("div", "section") else ""
            if len(own) >= 2:
                given = min(len(own), 25) / 25 * (1 + own.count(",") + min(len(own) / 100, 3)) * (1 - linked / chars)
                for level, up in enumerate(([id(node)] if kind != "p" else []) + above):
                    if level < 5:
                        points[up] = points.get(up, 0) + given / (1, 2, 4, 6, 8)[level]
            for x in below:
                spread(x, [id(node), *above])

        measure(tree)
        spread(tree, [])

        def listed(node):
            return [node] * bool(node[0]) + [y for x in node[2] for y in listed(x)]

        # A link itself counts in what is around it.
        expected = [(n[0], shares[id(n)][0], 0 if n[0] == "a" else shares[id(n)][1], pytest.approx(points.get(id(n), 0.0))) for n in listed(tree)]
        assert [(n.name, n.chars, n.linked, n.points) for n in order if n is not root] == expected


@pytest.mark.parametrize("part", ["<a", '<a "', "<a =\"", "<a '\"", "</b>", "</b", "</b ", "<aside>", "<div class=ad>", "<!--", "<!", "<![CDATA[", "</title  ", "<a b=c ", "&amp", '<a x="<a y=\'', " \t"])
def test_hostile_pages_take_linear_time(part):
    """A megabyte of each in two seconds, with twice that for a slow machine."""
    began = time.perf_counter()
    main_text(part * (1_000_000 // len(part)))
    main_text(f"<p class{' ' * 500_000}x='" + part * (500_000 // len(part)))
    assert time.perf_counter() - began < 6


def test_html_edges(spark):
    rows = [(1, "u", None, "t"), (2, "u", "", "t"), (3, "u", "<p>a, b" * 20_000, "t"), (3, "u", "<" * 50, "t"), (4, None, "<div>" * 5000 + "deep, text", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = {(r.page_id, r.n_chars > 0) for r in extract_text(df).collect()}
    assert out == {(1, False), (2, False), (3, True), (4, True)}
    assert extract_text(df.where("false")).count() == 0


def test_pages_whole(spark, data):
    """Every article of the test pages, by a plain reading of their markup."""
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    for r in entries.QUERIES["op4_html_extraction"](spark, data).collect():
        own = re.search(r"(?s)<article>(.*)</article>", pages[r.page_id])[1].replace("<br>", " ")
        blocks = [html.unescape(re.sub(r"<[^>]*>", "", b)) for b in re.split(r"</?(?:p|h1)>", own)]
        assert r.text == " ".join(" ".join(blocks).split())
        assert r.n_chars == len(r.text)


def test_hash_is_of_kept_text(spark, data):
    rows = {r.doc_id: r for r in entries.QUERIES["op3_line_dedup"](spark, data).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    clean = [i for i, r in rows.items() if not r.n_dropped]
    assert clean and all(rows[i].kept_sha256 == hashlib.sha256(texts[i].encode()).hexdigest() for i in clean)
