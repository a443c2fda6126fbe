"""Substring dedup: passages of k words that an earlier document has are removed.

The minimiser of a window of k words is the least hash of its runs of m words.
Consecutive windows with one minimiser form a super-k-mer, and equal windows
have equal minimisers wherever they stand. Minimisers of one document only are
sorted out first by a small shuffle of (minimiser, id). A super-k-mer that is
left travels as one packed string of words to its minimiser's bucket; there its
windows are sorted by hash, those of one hash are compared word by word, and
each that an earlier document has goes back as a range of words.

A minimiser whose super-k-mers are very many or very long (a boilerplate passage,
a large group of copies) has no bucket: its windows go through a grouped minimum
with map-side combination instead, and a join that adaptive execution can split.
These are told apart by 128 bits besides the minimiser.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_words import Words, blocks, strings, window_hashes
from .common import NO_ID, extended, table

KEY = ["__doc", "__text"]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of x[i : i + width], as far as there are so many."""
    got = 1
    while 2 * got <= width:
        x = np.minimum(x[: len(x) - got], x[got:])
        got *= 2
    return np.minimum(x[: len(x) - (width - got)], x[width - got :]) if got < width else x


class SuperKmers:
    """The super-k-mers of the rows of a piece: row, first word, windows, minimiser."""

    def __init__(self, words: Words, k: int, m: int, longest: int = 512):
        hashes = words.hashes()
        short, borders = window_hashes(hashes, words.first, m)
        per_row = np.maximum(words.counts - k + 1, 0)
        self.borders = np.concatenate([[0], np.cumsum(per_row)])
        total = int(self.borders[-1])
        if not total:
            self.row = self.start = self.windows = np.zeros(0, np.int64)
            self.minimiser = np.zeros(0, np.int64)
            return
        least = sliding_min(short, k - m + 1)
        rows = np.repeat(np.arange(len(per_row)), per_row)
        inner = np.arange(total) - self.borders[rows]
        mins = least[borders[rows] + inner]
        new = np.ones(total, bool)
        new[1:] = (mins[1:] != mins[:-1]) | (rows[1:] != rows[:-1])
        at = np.flatnonzero(new)
        # Long runs (a word said a thousand times) are cut, so that a packed string is bounded.
        n = np.diff(np.append(at, total))
        parts = -(-n // longest)
        at = np.repeat(at, parts) + longest * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        self.row, self.start = rows[at], inner[at]
        self.windows = np.diff(np.append(at, total))
        self.minimiser = mins[at].view(np.int64)


def _packed(words: Words) -> tuple[bytes, np.ndarray]:
    """All words joined by one space, and where each starts."""
    lengths = words.ends - words.starts + 1
    begins = np.concatenate([[0], np.cumsum(lengths)])
    out = np.full(int(begins[-1]), 32, np.uint8)
    keep = np.ones(len(out), bool)
    keep[begins[1:] - 1] = False
    out[keep] = words.raw[words._inside]
    return out.tobytes(), begins


def _runs(key: np.ndarray, word: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first index, from, to) of runs of consecutive windows with one key; sorted input."""
    new = np.ones(len(word), bool)
    new[1:] = (key[1:] != key[:-1]) | (word[1:] != word[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(word)) - 1
    return at, word[at], word[last] + k


def _first_owners(words: Words, k: int, minimiser: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each window of k words the smallest doc that has the same words.
    minimiser and doc are of each window.
    """
    windows, borders = window_hashes(words.hashes(), words.first, k)
    order = np.lexsort((doc, windows, minimiser))
    new = np.ones(len(order), bool)
    new[1:] = (windows[order][1:] != windows[order][:-1]) | (minimiser[order][1:] != minimiser[order][:-1])
    group = np.cumsum(new) - 1
    lead = order[np.flatnonzero(new)]
    # Equal hashes are of equal words, but for chance: every window is held against the first of its hash.
    ids = words.exact_ids()
    n = np.diff(borders)
    start = np.arange(len(order)) - np.repeat(borders[:-1], n) + np.repeat(words.first[:-1], n)
    mine = order[~new]
    other = lead[group[~new]]
    same = np.ones(len(mine), bool)
    for i in range(k):
        same &= ids[start[mine] + i] == ids[start[other] + i]
    owner = np.empty(len(order), np.int64)
    owner[order] = doc[lead][group]
    for g in np.unique(group[~new][~same]).tolist():  # by their words, one by one
        least: dict[bytes, int] = {}
        own = order[group == g]
        texts = [ids[start[w] : start[w] + k].tobytes() for w in own]
        for t, d in zip(texts, doc[own].tolist()):
            least[t] = min(least.get(t, d), d)
        owner[own] = [least[t] for t in texts]
    return owner


def _in_bucket(k: int):
    """mapInArrow over rows sorted by minimiser: ranges to remove."""

    def found(rows: pa.Table):
        docs = rows.column("__doc").to_numpy()
        text = rows.column("__text").to_numpy()
        start = rows.column("start").to_numpy()
        words = Words(strings(rows.column("packed").combine_chunks()))
        n = np.maximum(words.counts - k + 1, 0)
        of = np.repeat(np.arange(len(n)), n)
        borders = np.concatenate([[0], np.cumsum(n)])
        owner = _first_owners(words, k, rows.column("minimiser").to_numpy()[of], docs[of])
        gone = np.flatnonzero(docs[of] > owner)
        if not len(gone):
            return None
        word = start[of[gone]] + (gone - borders[of[gone]])
        at, a, b = _runs(of[gone], word, k)
        row = of[gone[at]]
        return pa.RecordBatch.from_arrays([pa.array(docs[row]), pa.array(text[row]), pa.array(a), pa.array(b)], names=[*KEY, "a", "b"])

    def run(batches):
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            rows = pa.Table.from_batches(waiting)
            if rows.nbytes < 4_000_000:
                continue
            # All but the last minimiser are complete.
            mins = rows.column("minimiser").to_numpy()
            done = int(np.searchsorted(mins, mins[-1]))
            if done and (out := found(rows.slice(0, done))):
                yield out
            waiting = rows.slice(done).to_batches()
        if waiting and (out := found(pa.Table.from_batches(waiting))):
            yield out

    return run


def repeated_ranges(docs: DataFrame, k: int, m: int, crowd: int, crowd_bytes: int = 16_000_000) -> DataFrame:
    """(__doc, __text, a, b): words a to b - 1 are covered by windows that a
    document with a smaller __doc has. docs: __doc, __text, text.
    """

    def minimisers(batches):
        for part, texts in blocks(batches, "text"):
            words = Words(texts)
            s = SuperKmers(words, k, m)
            row = pa.array(s.row)
            first = words.first[s.row] + s.start
            size = words.ends[first + s.windows + k - 2] - words.starts[first]  # at least that of the packed string
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(row), part.column(1).take(row), pa.array(s.minimiser), pa.array(size)], names=[*KEY, "minimiser", "size"]
            )

    def super_kmers(batches):
        for part, texts in blocks(batches, "text"):
            words = Words(texts)
            s = SuperKmers(words, k, m)
            own = part.column(part.schema.get_field_index("cold"))
            values, at = own.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum([len(x) for x in own])])
            wanted = np.zeros(len(s.row), bool)
            to = np.searchsorted(s.row, np.arange(part.num_rows + 1))
            for r in range(part.num_rows):
                wanted[to[r] : to[r + 1]] = np.isin(s.minimiser[to[r] : to[r + 1]], values[at[r] : at[r + 1]])
            row, start, n = s.row[wanted], s.start[wanted], s.windows[wanted]
            data, begins = _packed(words)
            first = words.first[row] + start
            a, b = begins[first].tolist(), (begins[first + n + k - 1] - 1).tolist()
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(take), part.column(1).take(take), pa.array(s.minimiser[wanted]), pa.array(start),
                 pa.array([data[i:j] for i, j in zip(a, b)], pa.binary()).cast(pa.string())],
                names=[*KEY, "minimiser", "start", "packed"],
            )

    def single_windows(batches):
        for part, texts in blocks(batches, "text"):
            words = Words(texts)
            s = SuperKmers(words, k, m)
            windows, borders = window_hashes(words.hashes(), words.first, k)
            checks = window_hashes(words.hashes(1), words.first, k)[0]
            own = part.column(part.schema.get_field_index("hot"))
            values, at = own.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum([len(x) for x in own])])
            to = np.searchsorted(s.row, np.arange(part.num_rows + 1))
            wanted = np.zeros(len(s.row), bool)
            for r in range(part.num_rows):
                wanted[to[r] : to[r + 1]] = np.isin(s.minimiser[to[r] : to[r + 1]], values[at[r] : at[r + 1]])
            n = s.windows[wanted]
            row = np.repeat(s.row[wanted], n)
            word = np.repeat(s.start[wanted], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(take), part.column(1).take(take), pa.array(np.repeat(s.minimiser[wanted], n)),
                 pa.array(windows[borders[row] + word].view(np.int64)), pa.array(checks[borders[row] + word].view(np.int64)), pa.array(word)],
                names=[*KEY, "minimiser", "window", "check", "word"],
            )

    light = docs.mapInArrow(minimisers, "__doc long, __text long, minimiser long, size long")
    shared = (
        light.groupBy("minimiser")
        .agg(F.min("__doc").alias("least"), F.max("__doc").alias("most"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
        .where("least < most")
        .select("minimiser", ((F.col("n") > crowd) | (F.col("size") > crowd_bytes)).alias("hot"))
    )
    flagged = light.drop("size").join(shared, "minimiser").groupBy(*KEY).agg(
        F.collect_set(F.when(~F.col("hot"), F.col("minimiser"))).alias("cold"),
        F.collect_set(F.when(F.col("hot"), F.col("minimiser"))).alias("hot"),
    )
    marked = docs.join(flagged, KEY, "left")
    buckets = (
        marked.where(F.size("cold") > 0)
        .select(*KEY, "cold", "text")
        .mapInArrow(super_kmers, "__doc long, __text long, minimiser long, start long, packed string")
    )
    ranges = buckets.repartition("minimiser").sortWithinPartitions("minimiser").mapInArrow(_in_bucket(k), "__doc long, __text long, a long, b long")
    windows = (
        marked.where(F.size("hot") > 0)
        .select(*KEY, "hot", "text")
        .mapInArrow(single_windows, "__doc long, __text long, minimiser long, window long, check long, word long")
    )
    least = windows.groupBy("minimiser", "window", "check").agg(F.min("__doc").alias("least"), F.max("__doc").alias("most")).where("least < most").drop("most")
    crowded = windows.join(least, ["minimiser", "window", "check"]).where("__doc > least").select(*KEY, F.col("word").alias("a"), (F.col("word") + k).alias("b"))
    return ranges.unionByName(crowded)


def drop_repeats(docs: DataFrame, k: int = 50, m: int = 8, crowd: int = 4096) -> DataFrame:
    """docs with text without the repeated words, n_words and n_removed.

    Words are ``[^\\x20\\x09-\\x0D]+``. A word goes if a window of k words over it
    also starts in a document with a smaller doc_id; what is left is joined by
    one space. A null or empty text has no words. Rows without doc_id count as
    one document before all others; rows that repeat a doc_id aren't compared
    with each other. Columns n_words and n_removed are replaced, others pass.
    m: words of a minimiser's run. crowd: rows of a minimiser from which its
    windows are spread over tasks singly, as they are from 16 MB of text on.
    """
    docs = docs.drop("n_words", "n_removed")
    names = docs.columns
    text = F.coalesce("text", F.lit(""))
    # The id comes back from the key after the join: without further columns, both
    # joins with the texts then share one exchange of them.
    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("__doc"),
        F.xxhash64(text).alias("__text"),
        text.alias("text"),
        *[c for c in names if c not in ("doc_id", "text")],
    )
    ranges = repeated_ranges(keyed.select(*KEY, "text"), k, m, crowd).groupBy(*KEY).agg(
        F.collect_set(F.struct("a", "b")).alias("__r")
    )

    def cut(batches):
        for part, texts in blocks(batches, "text"):
            found = part.column(part.schema.get_field_index("__r")).to_pylist()
            out, words, removed = [], [], []
            for text, gone in zip(texts.to_pylist(), found):
                own = text.encode().split()  # splits at \x20 and \x09-\x0D
                words.append(len(own))
                if gone:
                    drop = np.zeros(len(own) + 1, np.int64)
                    for r in gone:
                        drop[r["a"]] += 1
                        drop[r["b"]] -= 1
                    own = [w for w, d in zip(own, np.cumsum(drop).tolist()) if not d]
                removed.append(words[-1] - len(own))
                out.append(b" ".join(own).decode())
            columns = [pa.array(out, pa.string()) if c == "text" else part.column(part.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(words, pa.int64()), pa.array(removed, pa.int64())], names=[*names, "n_words", "n_removed"])

    own_id = F.when(F.col("__doc") != NO_ID, F.col("__doc")).cast(docs.schema["doc_id"].dataType).alias("doc_id")
    joined = keyed.join(ranges, KEY, "left").select(*[own_id if c == "doc_id" else F.col(c) for c in names], "__r")
    return joined.mapInArrow(cut, extended(docs, "n_words long, n_removed long"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP8_SQL = """
WITH base AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS pos FROM base),
windows AS (SELECT doc_id, i AS pos, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM base, LATERAL (SELECT unnest(range(1, len(w) - 48)) AS i) WHERE len(w) >= 50),
firsts AS (SELECT h, min(doc_id) AS least FROM windows GROUP BY h),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM windows JOIN firsts USING (h), range(50) r(k) WHERE doc_id > least),
kept AS (SELECT w.doc_id, w.pos, w.x, g.pos IS NOT NULL AS dropped FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.pos = w.pos),
summed AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (dropped) AS n_removed, string_agg(x, ' ' ORDER BY pos) FILTER (NOT dropped) AS t FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM base d LEFT JOIN summed USING (doc_id)
"""
