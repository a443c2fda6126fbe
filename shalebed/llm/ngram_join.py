"""N-gram Jaccard join by MinHash banding.

Documents of equal words are one node first, so that copies cost nothing. The
nodes' MinHash bands are shuffled by their hashes; nodes of one band are a
bucket. A node's home is the largest bucket that it is in; small homes join the
large one that they share buckets with, and a large one is split into cells of a
bounded size. Two cells meet if some bucket has nodes of both; only the nodes of
such buckets go there, and each meeting verifies the pairs of its nodes on their
full n-gram sets, which are made once for each node. So every two nodes of a
bucket are compared exactly once, near copies of one another mostly meet in one
cell, and a chain of buckets never becomes one group. The verified links'
components are the classes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_words import Words, blocks, mix, window_hashes
from .common import NO_ID, checkpointed, table
from .components import connected_components


def choose_bands(threshold: float, recall: float = 0.9999, max_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, with which a
    pair at the threshold shares a band with the target recall.
    """
    best = None
    for rows in range(1, max_hashes + 1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding reaches the recall with so few hashes")
    return best


def shingle_hashes(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each row's runs of n words and the row borders. A row of
    fewer words has one run, of all of them; one without words has none.
    """
    hashes = words.hashes()
    runs, borders = window_hashes(hashes, words.first, n)
    counts = words.counts
    short = np.flatnonzero((counts > 0) & (counts < n))
    if not len(short):
        return runs, borders
    with np.errstate(over="ignore"):
        own = np.array([mix(np.array([sum(int(h) * 31**i for i, h in enumerate(hashes[words.first[r] : words.first[r + 1]])) & (2**64 - 1)], np.uint64))[0] for r in short], np.uint64)
    runs = np.insert(runs, borders[short], own)
    sizes = np.diff(borders)
    sizes[short] = 1
    return runs, np.concatenate([[0], np.cumsum(sizes)])


def _sequence_hashes(words: Words, salt: int) -> np.ndarray:
    """A hash of each row's words in their order."""
    place = (np.arange(len(words)) - np.repeat(words.first[:-1], words.counts)).astype(np.uint64)
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words.hashes() + mix(place * np.uint64(2) + np.uint64(salt))))])
    return mix(upto[words.first[1:]] - upto[words.first[:-1]] + words.counts.astype(np.uint64)).view(np.int64)


def _signatures(n: int, bands: int, rows: int):
    rng = np.random.default_rng(5)
    factors = rng.integers(1, 2**63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches):
        for part, texts in blocks(batches, "text"):
            words = Words(texts)
            runs, borders = shingle_hashes(words, n)
            full = np.flatnonzero(np.diff(borders))
            at = borders[:-1][full]
            out = np.zeros((part.num_rows, bands), np.uint64)
            for b in range(bands if len(full) else 0):
                h = np.full(len(full), b + 1, np.uint64)
                for r in range(rows):
                    least = np.minimum.reduceat((runs * factors[b * rows + r]) >> np.uint64(32), at)
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + least)
                out[full, b] = h
            sums = [_sequence_hashes(words, salt) for salt in (0x51, 0xA7)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(sums[0]), pa.array(sums[1]), pa.array(np.diff(borders)),
                 pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, bands, dtype=np.int32)), pa.array(out.ravel().view(np.int64)))],
                names=["doc", "text_hash", "node", "check", "runs", "bands"],
            )

    return run


def _sets(n: int):
    """Sorted distinct n-gram hashes of each row."""

    def run(batches):
        for part, texts in blocks(batches, "text"):
            runs, borders = shingle_hashes(Words(texts), n)
            sets = [np.unique(runs[a:b]).tobytes() for a, b in zip(borders[:-1], borders[1:])]
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("node")), pa.array(sets, pa.binary())], names=["node", "grams"])

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The size of the intersection of each two sets, as a matrix.

    N-grams of many sets are counted by matrix products over some thousand of
    them at a time, those of few sets pair by pair.
    """
    m = len(sets)
    out = np.zeros((m, m), np.int64)
    grams, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    new = np.concatenate([[True], grams[1:] != grams[:-1]])
    at = np.flatnonzero(new)
    held = np.diff(np.append(at, len(grams)))
    number = np.cumsum(new) - 1
    many = held > 16
    if many.any():
        column = np.cumsum(many) - 1
        use = many[number]
        col, own = column[number[use]], owner[use]
        for low in range(0, int(column[-1]) + 1, 4096):
            part = slice(*np.searchsorted(col, [low, low + 4096]))
            bits = np.zeros((m, 4096), np.float32)
            bits[own[part], col[part] - low] = 1
            out += (bits @ bits.T).astype(np.int64)
    flat = out.ravel()
    for k in range(2, min(16, int(held.max(initial=0))) + 1):
        rows = at[held == k]
        if len(rows):
            who = owner[rows[:, None] + np.arange(k)]
            for x in range(k):
                for y in range(k):
                    if x != y:
                        flat += np.bincount(who[:, x] * m + who[:, y], minlength=m * m)
    return out


def _verify(threshold: float):
    """mapInArrow over rows sorted by (i, j): links of each node and edges."""

    def verified(rows: pa.Table):
        rows = rows.sort_by("node")
        node, cell, copies = (rows.column(c).to_numpy() for c in ("node", "cell", "copies"))
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("grams")]
        size = np.array([len(s) for s in sets])
        if len(sets) == 2:
            shared = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
            common = np.array([[0, shared], [shared, 0]])
        else:
            common = overlaps(sets)
        linked = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9
        np.fill_diagonal(linked, False)
        if i != j:
            linked &= cell[:, None] != cell[None, :]
        # Components among these, by the least index reached.
        label = np.arange(len(node))
        while True:
            low = np.minimum(label, np.where(linked, label[None, :], len(node)).min(1, initial=len(node)))
            low = low[low]
            if (low == label).all():
                break
            label = low
        return pa.RecordBatch.from_arrays(
            [pa.array(node), pa.array(node[label]), pa.array((linked * copies[None, :]).sum(1).astype(np.int64))],
            names=["node", "to", "links"],
        )

    def run(batches):
        waiting: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(2)])
            cuts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)])) if batch.num_rows else []
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
                if key is not None and key != tuple(keys[:, a]):
                    yield verified(pa.Table.from_batches(waiting))
                    waiting = []
                key = tuple(keys[:, a])
                waiting.append(batch.slice(a, b - a))
        if waiting:
            yield verified(pa.Table.from_batches(waiting))

    return run


def _gathered(members: DataFrame, homes: DataFrame) -> DataFrame:
    """(home, root): homes joined to a larger one that they share buckets with.

    A group of near copies has one large home and some small ones, for those
    that miss its band; a home joins its largest neighbour if that has no larger
    one itself, so this is one step and chains stay apart.
    """
    size = homes.groupBy("home").agg(F.count(F.lit(1)).alias("c"))
    seen = checkpointed(members.select("node", "band").join(homes, "node").select("band", "home").distinct().join(size, "home"))
    # A band's largest home is the largest neighbour there of all others.
    top = seen.groupBy("band").agg(F.max(F.struct("c", "home")).alias("near"))
    larger = seen.join(top, "band").where(F.struct("c", "home") < F.col("near")).groupBy("home").agg(F.max("near").alias("near"))
    larger = checkpointed(larger.select("home", F.col("near.home").alias("root")))
    joined = larger.join(larger.select(F.col("home").alias("root")), "root", "left_anti")
    return size.select("home").join(joined, "home", "left").select("home", F.coalesce("root", "home").alias("root"))


def _meetings(nodes: DataFrame, block: int, block_runs: int) -> DataFrame:
    """(i, j, cell, node): one row for each node and meeting of cells it takes
    part in, i = j for its own cell. nodes: node, runs, bands.
    """
    banded = nodes.select("node", "runs", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = checkpointed(banded.join(buckets, "band"))
    homes = members.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("n"), "band")).alias("home"), F.first("runs").alias("runs"))
    homes = checkpointed(homes.select("node", "runs", F.col("home.band").alias("home")))
    rooted = homes.join(_gathered(members, homes), "home")
    sized = rooted.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("runs") / block_runs)).alias("parts"))
    cell = F.xxhash64("root", F.pmod(F.xxhash64("node"), "parts"))
    homes = checkpointed(rooted.join(sized, "root").select("node", cell.alias("cell")))
    # Buckets with nodes of the same cells are of one kind, so a node is joined once for each kind.
    placed = members.select("node", "band").join(homes, "node")
    kinds = placed.select("band", "cell").distinct().groupBy("band").agg(F.count(F.lit(1)).alias("cells"), F.bit_xor(F.xxhash64("cell")).alias("kind")).where("cells > 1")
    placed = checkpointed(placed.join(kinds, "band").select("kind", "node", "cell").distinct())
    others = placed.select("kind", F.col("cell").alias("other")).distinct()
    met = placed.join(others, "kind").where("cell <> other").select(F.least("cell", "other").alias("i"), F.greatest("cell", "other").alias("j"), "cell", "node")
    return homes.select(F.col("cell").alias("i"), F.col("cell").alias("j"), "cell", "node").unionByName(met.distinct())


def _classed(docs: DataFrame, threshold: float, n: int, recall: float, block: int, block_runs: int = 4_000_000) -> DataFrame:
    """(doc, text_hash, class, links, kept) for every row of docs; NO_ID for null ids."""
    bands, rows = choose_bands(threshold, recall)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    signed = keyed.mapInArrow(_signatures(n, bands, rows), "doc long, text_hash long, node long, check long, runs long, bands array<long>")
    signed = checkpointed(signed)
    nodes = (
        signed.where("runs > 0")
        .groupBy("node", "check")
        .agg(F.min(F.struct("doc", "text_hash")).alias("lead"), F.count(F.lit(1)).alias("copies"), F.first("runs").alias("runs"), F.first("bands").alias("bands"))
        .select("node", "check", "lead.*", "copies", "runs", "bands")
    )
    nodes = checkpointed(nodes)
    meetings = checkpointed(_meetings(nodes, block, block_runs))
    compared = nodes.select("node", "doc", "text_hash", "copies").join(meetings.select("node").distinct(), "node", "left_semi")
    # Each node's set is made once, of one row, however often its document and text repeat.
    sets = keyed.join(compared, ["doc", "text_hash"]).select("node", "text").mapInArrow(_sets(n), "node long, grams binary").dropDuplicates(["node"])
    sets = meetings.join(compared.select("node", "copies"), "node").join(sets, "node").select("i", "j", "cell", "node", "copies", "grams")
    found = sets.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(_verify(threshold), "node long, to long, links long")
    found = checkpointed(found)
    classes = connected_components(found.select(F.col("node").alias("u"), F.col("to").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    rooted = (
        nodes.select("node", "check", "doc", "text_hash", "copies")
        .join(classes, "node", "left")
        .join(links, "node", "left")
        .select("node", "check", "doc", "text_hash", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    )
    first = rooted.groupBy("root").agg(F.min(F.struct("doc", "text_hash")).alias("first"))
    known = rooted.join(first, "root").select("node", "check", "links", "first")
    told = signed.select("doc", "text_hash", "node", "check", (F.col("runs") > 0).alias("filled")).join(known, ["node", "check"], "left")
    return told.select(
        "doc",
        "text_hash",
        F.when(F.col("filled"), F.col("first.doc")).otherwise(F.col("doc")).alias("class"),
        F.when(F.col("filled"), F.col("links")).otherwise(F.lit(0)).cast("long").alias("links"),
        (~F.col("filled") | ((F.col("doc") == F.col("first.doc")) & (F.col("text_hash") == F.col("first.text_hash")))).alias("kept"),
    )


def join_similar(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.9999, block: int = 768) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, class_id, n_links and kept.

    Texts are linked if the Jaccard similarity of their sets of n-word runs
    (words ``[^\\x20\\x09-\\x0D]+``, unchanged) is at least the threshold. A text
    of fewer than n words has its words as its only run. Classes are the
    components of the links; class_id is the least doc_id of the class, n_links
    the number of other documents linked to this one, those of equal words
    included. kept marks one document of each class: the least doc_id and, of
    different texts with it, the least text hash.

    Texts without words (null, empty, white space) are linked to none: each is
    its own class. Rows without doc_id count as one id before all others, and
    have a null class_id where that is the least. Rows that repeat a doc_id are
    linked like others; equal rows are kept together. Extra columns are ignored.
    Components are found in rounds that grow with the logarithm of the longest
    chain of links; more than 50 are an error.

    block: the most nodes of one cell (a cell of very long texts has fewer). m
    texts that are all alike meet in m / block cells, each n-gram set as often;
    texts that share a bucket with few others are sent a few times, however long
    the chain that they are part of. No pair of a bucket is left out.
    """
    no_id = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return _classed(docs, threshold, n, recall, block).select(no_id("doc").alias("doc_id"), no_id("class").alias("class_id"), F.col("links").alias("n_links"), "kept")


def keep_one_of_each(docs: DataFrame, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """The rows of docs without all but one of each class of join_similar.

    Rows are told apart by doc_id and text, so one row stays of each class also
    where ids repeat or are null. Of rows equal in both one stays, whatever
    their other columns; texts without words all stay, but for such rows.
    """
    kept = _classed(docs, threshold, n, 0.9999, 768).where("kept").select(F.col("doc").alias("k_id"), F.col("text_hash").alias("k_text")).distinct()
    shown = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "__text": F.xxhash64(F.coalesce("text", F.lit("")))})
    same = (F.col("__id") == F.col("k_id")) & (F.col("__text") == F.col("k_text"))
    return shown.join(kept, same, "left_semi").dropDuplicates(["__id", "__text"]).drop("__id", "__text")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_similar(table(spark, sf_dir, "documents"))
