"""Benchmark decontamination: BM25 over test items, every passage a query.

The test items are indexed by like length, the documents are the queries: each
passage (a window of words; consecutive ones overlap by the longest such item)
asks for all items that score above a share of their own best score, an item
always as a whole. Block-max WAND prunes:
first by the greatest weight of each term in any item, then by that in each
block of items; only blocks whose bound passes are scored. What is retrieved is
verified by the overlap of word runs with the item's question (its first two
thirds) and answer (the rest). Items too short for that are found as whole runs
of their words.

An index holds a bounded number of bytes of items and goes to the tasks whole.
Larger benchmarks are dealt into several, each a pass over the documents; no
pass shuffles them. Weights and passages are those of all items, however dealt.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_words import SIGN_BYTES, Words, blocks, strings, window_hashes
from .common import checkpointed, table

K1, B = 1.2, 0.75


class Rules(NamedTuple):
    """threshold: share of an item's own score. question, answer: least shares of
    their runs of n words. least: items of fewer words must be there word for word.
    """

    threshold: float = 0.6
    question: float = 0.6
    answer: float = 0.6
    n: int = 3
    least: int = 8


class Stats(NamedTuple):
    """Of the scored items: how many, their mean number of words, and how many
    hold each of some terms (sorted).
    """

    items: int
    mean: float
    terms: np.ndarray
    df: np.ndarray


def _words(texts: pa.Array) -> Words:
    return Words(pc.utf8_lower(texts), SIGN_BYTES)


def _items(texts: pa.Array):
    """(row, hashes of its words) of each item that has words."""
    words = _words(texts)
    hashes = words.hashes()
    for row, (a, b) in enumerate(zip(words.first[:-1], words.first[1:])):
        if b > a:
            yield row, hashes[a:b]


def _runs(hashes: np.ndarray, n: int) -> tuple[int, np.ndarray]:
    """The runs of n words, of all where they are fewer, and the length of one."""
    n = min(n, len(hashes))
    return n, np.unique(window_hashes(hashes, np.array([0, len(hashes)]), n)[0]) if n else np.zeros(0, np.uint64)


def _above(x: np.ndarray) -> np.ndarray:
    """The next 32-bit number that isn't less."""
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


class Level:
    """The postings of the items of like length. Their passages have stride words
    twice; an item isn't longer than one stride.
    """

    def __init__(self, stride: int, items: np.ndarray, first: np.ndarray, item: np.ndarray, weight: np.ndarray, n_blocks: int):
        """items: numbers of the level's items. first: where each term's postings (item, weight) begin."""
        self.stride, self.first, self.items, self.weight = stride, first, items, weight
        self.own = np.searchsorted(items, item)  # the number within the level, ascending in each term
        self.size = -(-len(items) // n_blocks)
        terms = len(first) - 1
        term = np.repeat(np.arange(terms), np.diff(first))
        most = np.zeros(terms)
        np.maximum.at(most, term, weight)
        block_most = np.zeros((terms, -(-len(items) // self.size)))
        np.maximum.at(block_most, (term, self.own // self.size), weight)
        # Bounds are rounded up and added in 64 bits: none is below a score.
        self.most, self.block_most = np.where(most > 0, _above(most), 0), np.where(block_most > 0, _above(block_most), np.float32(0))

    def scores(self, terms: np.ndarray, block: int) -> dict[int, float]:
        """The scores of a block's items; its postings are found by bisection."""
        out: dict[int, float] = {}
        low, high = block * self.size, (block + 1) * self.size
        for t in terms.tolist():
            own = slice(self.first[t], self.first[t + 1])
            a, b = np.searchsorted(self.own[own], (low, high)) + self.first[t]
            for p, w in zip(self.own[a:b].tolist(), self.weight[a:b].tolist()):
                out[p] = out.get(p, 0.0) + w
        return out


class Index:
    """The inverted index of some items, in levels of like length (powers of two).
    Weights are shares of an item's score.

    stats(terms) has those of all items; without it, these are all.
    """

    def __init__(self, ids: list[int], texts: list[str], rules: Rules, stats: Callable[[np.ndarray], Stats] | None = None, n_blocks: int = 32):
        self.items, hashes = [], []
        short: dict[int, list[tuple[int, int]]] = {}
        for row, own in _items(strings(pa.array(texts, pa.string()))):
            if len(own) >= rules.least:
                self.items.append(ids[row])
                hashes.append(own)
            else:
                run = window_hashes(own, np.array([0, len(own)]), len(own))[0][0]
                short.setdefault(len(own), []).append((int(run), row))
        # By number of words: the sorted hashes of the short items and these.
        self.short = {n: (np.array([h for h, _ in sorted(own)], np.uint64), [ids[row] for _, row in sorted(own)]) for n, own in short.items()}
        if not self.items:
            return
        lengths = np.array([len(h) for h in hashes])
        pairs = [np.unique(h, return_counts=True) for h in hashes]
        item = np.repeat(np.arange(len(pairs)), [len(u) for u, _ in pairs])
        self.terms, term = np.unique(np.concatenate([u for u, _ in pairs]), return_inverse=True)
        tf = np.concatenate([c for _, c in pairs]).astype(float)
        every = stats(self.terms) if stats else Stats(len(pairs), lengths.mean(), self.terms, np.bincount(term))
        df = every.df[np.searchsorted(every.terms, self.terms)]
        norm = K1 * (1 - B + B * lengths / every.mean)
        weight = np.log1p((every.items - df + 0.5) / (df + 0.5))[term] * tf * (K1 + 1) / (tf + norm[item])
        weight /= np.bincount(item, weights=weight)[item]
        order = np.lexsort((item, term))
        term, item, weight = term[order], item[order], weight[order]
        self.levels = []
        octave = np.ceil(np.log2(lengths)).astype(int)
        for k in np.unique(octave):
            own = octave[item] == k
            first = np.searchsorted(term[own], np.arange(len(self.terms) + 1))
            self.levels.append(Level(1 << int(k), np.flatnonzero(octave == k), first, item[own], weight[own], n_blocks))
        self.runs = []
        for h in hashes:
            cut = -(-2 * len(h) // 3)
            self.runs.append(tuple(_runs(x, rules.n) for x in (h[:cut], h[cut:])))


def search(index: Index, texts: pa.Array, rules: Rules) -> list[tuple[int, int, float, float, float]]:
    """(row, item, score, question, answer) of the verified items, the best
    passage of each row and item.
    """
    words = _words(texts)
    hashes = words.hashes()
    if not len(hashes):
        return []
    found: dict[tuple[int, int], tuple[float, float, float]] = {}
    if index.items:
        at = np.minimum(np.searchsorted(index.terms, hashes), len(index.terms) - 1)
        known = np.flatnonzero(index.terms[at] == hashes)
        for level in index.levels:
            _scored(index, level, words, hashes, known, at[known], rules, found)
    found |= dict.fromkeys(_exact(index, words, hashes), (1.0, 1.0, 1.0))
    return [(*key, *value) for key, value in found.items()]


def _exact(index: Index, words: Words, hashes: np.ndarray) -> set[tuple[int, int]]:
    """(row, item) of the short items whose words follow each other in the row."""
    found = set()
    for n, (runs, items) in index.short.items():
        own, borders = window_hashes(hashes, words.first, n)
        first = np.searchsorted(runs, own)
        at = np.flatnonzero(runs[np.minimum(first, len(runs) - 1)] == own)
        row = np.searchsorted(borders, at, "right") - 1
        for pair in np.unique(row * len(runs) + first[at]).tolist():
            r, a = divmod(pair, len(runs))
            found |= {(r, item) for item in items[a : np.searchsorted(runs, runs[a], "right")]}
    return found


def passages(counts: np.ndarray, stride: int) -> np.ndarray:
    """The number of each row's passages: p covers its words from p * stride to (p + 2) * stride."""
    return np.maximum(-(-counts // stride) - 1, (counts > 0).astype(np.int64))


def _scored(index: Index, level: Level, words: Words, hashes: np.ndarray, known: np.ndarray, at: np.ndarray, rules: Rules, found: dict) -> None:
    """Adds what the passages of a level find. known: the words that some item has, at: their terms."""
    stride = level.stride
    mine = level.most[at] > 0
    known, at = known[mine], at[mine]
    count = passages(words.counts, stride)
    base = np.concatenate([[0], np.cumsum(count)])
    row = np.searchsorted(words.first, known, "right") - 1
    p = (known - words.first[row]) // stride
    here, before = p < count[row], p > 0
    ids = np.concatenate([(base[row] + p)[here], (base[row] + p - 1)[before]])
    term = np.concatenate([at[here], at[before]])
    pair = np.unique(ids * len(index.terms) + term)
    ids, term = pair // len(index.terms), pair % len(index.terms)
    if not len(ids):
        return
    begin = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    bound = np.add.reduceat(level.most[term], begin, dtype=float)
    end = np.append(begin[1:], len(ids))
    least = rules.threshold - 1e-9
    hopeful = np.flatnonzero(bound >= least)
    for low in range(0, len(hopeful), 2048):
        some = hopeful[low : low + 2048]
        sizes = end[some] - begin[some]
        starts = np.cumsum(sizes) - sizes
        mine = np.arange(sizes.sum()) + np.repeat(begin[some] - starts, sizes)
        bounds = np.add.reduceat(np.take(level.block_most, term[mine], axis=0), starts, axis=0, dtype=float)
        for k, block in zip(*np.nonzero(bounds >= least)):
            j = some[k]
            scores = level.scores(term[begin[j] : end[j]], int(block))
            best = [(int(level.items[i]), s) for i, s in scores.items() if s >= least]
            if not best:
                continue
            passage = int(ids[begin[j]])
            r = int(np.searchsorted(base, passage, "right") - 1)
            a = words.first[r] + (passage - base[r]) * stride
            runs = {}
            own = hashes[a : min(a + 2 * stride, words.first[r + 1])]
            for i, s in best:
                shares = []
                for n, part in index.runs[i]:
                    if not len(part):
                        shares.append(1.0)
                        continue
                    if n not in runs:
                        runs[n] = _runs(own, n)[1]
                    shares.append(float(np.isin(part, runs[n]).mean()))
                if shares[0] >= rules.question and shares[1] >= rules.answer:
                    key = (r, index.items[i])
                    found[key] = max(found.get(key, (0.0, 0.0, 0.0)), (s, *shares))


def _indexes(benchmark: DataFrame, rules: Rules, max_bytes: int):
    """The items, dealt into indexes of about max_bytes each, one at a time."""
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // max_bytes))
    stats = _stats(items, rules) if n > 1 else None
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").toPandas()
        yield Index(part["item_id"].tolist(), part["text"].tolist(), rules, stats)


def _stats(items: DataFrame, rules: Rules) -> Callable[[np.ndarray], Stats]:
    """The statistics of all items, for the terms of an index."""

    def run(batches):
        for _, texts in blocks(batches, "text"):
            own = [h for _, h in _items(texts) if len(h) >= rules.least]
            if not own:
                continue
            terms, df = np.unique(np.concatenate([np.unique(h) for h in own]), return_counts=True)
            yield pa.RecordBatch.from_pydict(
                {
                    "term": pa.array([None, *terms.view(np.int64).tolist()], pa.int64()),
                    "n": pa.array([len(own), *df.tolist()], pa.int64()),
                    "words": pa.array([sum(map(len, own)), *[0] * len(df)], pa.int64()),
                }
            )

    # The row without a term has the numbers of the items.
    found = items.select("text").mapInArrow(run, "term long, n long, words long")
    counts = checkpointed(found.groupBy("term").agg(F.sum("n").alias("n"), F.sum("words").alias("words")))
    every = counts.where("term IS NULL").first()

    def stats(terms: np.ndarray) -> Stats:
        asked = counts.sparkSession.createDataFrame(pa.table({"term": terms.view(np.int64)}))
        got = counts.join(asked, "term").select("term", "n").toArrow()
        own, df = got.column("term").to_numpy().view(np.uint64), got.column("n").to_numpy()
        order = np.argsort(own)
        return Stats(every.n, every.words / every.n, own[order], df[order])

    return stats


def find_leaks(docs: DataFrame, benchmark: DataFrame, rules: Rules = Rules(), max_bytes: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): the items that
    each row of docs holds, the best passage of each.

    Words are runs of a-z, digits and non-ASCII characters of the lower-cased
    text. A row and an item are told once, with the passage of the greatest score
    (then question, then answer). Items of fewer words than rules.least are found
    where all their words follow each other, with shares of 1; longer ones, of
    any length, are judged as wholes.

    Null and empty texts hold nothing; items without text or words are left out,
    and an empty table on either side gives no rows. A null item_id is told as
    null. Repeated rows are searched one by one, repeated items once; items of
    one text and several ids are told by each. Texts are searched whole, some
    megabytes at a time. Extra columns are ignored. max_bytes bounds the items
    of an index (one longer item is an index of its own); more take more passes.
    """
    spark = docs.sparkSession
    out = None
    for index in _indexes(benchmark, rules, max_bytes):
        sent = spark.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            for part, texts in blocks(batches, "text"):
                if hits := search(sent.value, texts, rules):
                    row, item, *shares = zip(*hits)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(row)), pa.array([None if i != i else i for i in item], pa.int64()), *[pa.array(s, pa.float64()) for s in shares]],
                        names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
                    )

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
            run, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
        )
        out = found if out is None else out.unionByName(found)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rules: Rules = Rules(), max_bytes: int = 4_000_000) -> DataFrame:
    """The rows of docs that find_leaks finds no item in, all columns."""
    spark = docs.sparkSession
    for index in _indexes(benchmark, rules, max_bytes):
        sent = spark.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            for part, texts in blocks(batches, "text"):
                clean = np.ones(part.num_rows, bool)
                clean[[hit[0] for hit in search(sent.value, texts, rules)]] = False
                yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
