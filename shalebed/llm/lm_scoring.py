"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

P(word | context) = P(group | context) P(class | group, context) P(word | class, context).
The two softmaxes have one weight row for each hashed n-gram or skip feature of
the context, above the unigram prior of the classes. The most frequent words
are classes of their own; the others share a class with words of like endings.
Within such a class a word's share is its smoothed count, and where the two words
before it were seen with the class, an n-gram feature of word and context lifts it
above that share: its weight is the log of observed over expected, so the factor
has a closed form, and the table of these features grows with the corpus.

Passes over the text: counting words; training; and scoring. A training step sums
observed and expected counts of each feature over its documents, dealt by a hash
of the doc_id, at the same weights; expected counts are summed as whole numbers,
so neither the number of partitions nor the order of tasks matters. In scoring, words of the bounded table of frequent words
are looked up in the task; the n-grams of every place and the other words meet in
buckets of their hashes, where those of training documents are counted and all
are answered with what they add to each row. They travel in packed blocks: a
pair of context and word goes once from a block of rows, with the rows it is in.

Words are 64-bit hashes; the lowest 7 bits are the ending's class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_words import Words, blocks, mix
from .common import checkpointed, table
from .quality_rules import bucket_of

ENDINGS = 128
GROUPS = 16
CLASSES = 256
_END_ID = np.int64(-(2**62))
_BLOCK = 512
#: Tokens whose chances are worked out at once, and that a training task adds to its sums at once.
_COLUMNS, _ADDED = 8192, 150_000
#: Probabilities are summed in these parts, as whole numbers: exact up to 2^33 tokens in a task.
_PARTS = 2.0**20


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the words and of one end for each row, and the row borders."""
    words = Words(texts, fold=True)
    hashes = words.hashes()
    last = words.data[words.ends - 1].astype(np.uint64) if len(words) else np.zeros(0, np.uint64)
    before = words.data[np.maximum(words.ends - 2, 0)].astype(np.uint64) if len(words) else last
    before = np.where(words.ends - words.starts > 1, before, 0).astype(np.uint64)
    ending = mix(last * np.uint64(256) + before) % np.uint64(ENDINGS)
    ids = ((hashes >> np.uint64(7) << np.uint64(7)) | ending).view(np.int64)
    rows = len(words.first) - 1
    borders = words.first + np.arange(rows + 1)
    out = np.empty(borders[-1], np.int64)
    ends = borders[1:] - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner], out[ends] = ids, _END_ID
    return out, borders


def count_words(docs: DataFrame) -> DataFrame:
    """(id, c) of the tokens of all texts."""

    def run(batches):
        held: list[np.ndarray] = []

        def told():
            ids, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], names=["id", "n"])

        for _, texts in blocks(batches, "text", 500_000):
            held.append(_tokens(texts)[0])
            if sum(map(len, held)) > 3_000_000:
                yield told()
        if held:
            yield told()

    return docs.select("text").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("c"))


class Lexicon:
    """What tasks know of the counts: totals, class sizes, the frequent words.

    Its size is bounded: at most max_head words. Those of them that are most
    frequent are classes of their own.
    """

    def __init__(self, counts: DataFrame, max_head: int):
        per_class = counts.groupBy((F.col("id").bitwiseAND(F.lit(ENDINGS - 1))).alias("k")).agg(
            F.sum("c").alias("s"), F.count(F.lit(1)).alias("v")
        ).toPandas()
        self.total, self.distinct = int(per_class["s"].sum()), int(len(per_class) and per_class["v"].sum())
        sizes = counts.groupBy(bucket_of(F.col("c")).alias("b")).agg(F.count(F.lit(1)).alias("v")).toPandas().sort_values("b", ascending=False)
        fits = sizes[sizes["v"].cumsum() <= max_head]
        least = int(fits["b"].min()) if len(fits) else 2**62
        head = counts.where(F.col("c") >= least).toPandas().sort_values(["c", "id"], ascending=[False, True])
        top = head.head(CLASSES - ENDINGS)
        self.top_ids = np.sort(top["id"].to_numpy(np.int64))
        self.top_class = np.argsort(np.argsort(-top.sort_values("id")["c"].to_numpy(), kind="stable"), kind="stable").astype(np.int16)
        head = head.sort_values("id")
        self.head_ids, self.head_counts = head["id"].to_numpy(np.int64), head["c"].to_numpy(np.int64)
        mass, size = np.zeros(CLASSES), np.zeros(CLASSES)
        for k, s, v in zip(per_class["k"], per_class["s"], per_class["v"]):
            mass[CLASSES - ENDINGS + k], size[CLASSES - ENDINGS + k] = s, v
        for i, c in zip(top["id"], top["c"]):
            mass[CLASSES - ENDINGS + (i & (ENDINGS - 1))] -= c
            size[CLASSES - ENDINGS + (i & (ENDINGS - 1))] -= 1
        for i, c in zip(self.top_ids, self.top_class):
            mass[c] = self.head_counts[np.searchsorted(self.head_ids, i)]
        #: Denominators of a word's share in its class; 0 for classes of one word.
        self.share = np.where(np.arange(CLASSES) < CLASSES - ENDINGS, 0.0, mass + 0.1 * (size + 1))
        weight = (np.where(self.share > 0, self.share, mass + 1e-3)).reshape(GROUPS, -1)
        self.prior1 = np.log(weight.sum(1) / weight.sum()).astype(np.float32)
        self.prior2 = np.log(weight / weight.sum(1, keepdims=True)).astype(np.float32)

    def classes(self, ids: np.ndarray) -> np.ndarray:
        found = (ids & (ENDINGS - 1)).astype(np.int16) + (CLASSES - ENDINGS)
        if len(self.top_ids):
            at = np.minimum(np.searchsorted(self.top_ids, ids), len(self.top_ids) - 1)
            hit = self.top_ids[at] == ids
            found[hit] = self.top_class[at[hit]]
        return found

    def places(self, ids: np.ndarray) -> np.ndarray:
        """Where frequent words stand in the table, -1 for others."""
        if not len(self.head_ids):
            return np.full(len(ids), -1)
        at = np.minimum(np.searchsorted(self.head_ids, ids), len(self.head_ids) - 1)
        return np.where(self.head_ids[at] == ids, at, -1)


def _back(values: np.ndarray, borders: np.ndarray, k: int) -> np.ndarray:
    """What stands k tokens before in the same row, 999 for nothing."""
    place = np.arange(len(values)) - np.repeat(borders[:-1], np.diff(borders))
    out = np.full(len(values), 999, np.uint64)
    out[k:] = values[: len(values) - k]
    out[place < k] = 999
    return out


def _features(ids: np.ndarray, classes: np.ndarray, borders: np.ndarray, bits: int) -> np.ndarray:
    """Four hashed features of each token's context: the word before, the two
    classes before, and the second and the third class before (skips).
    """
    c = classes.astype(np.uint64)
    one, two, three = (_back(c, borders, k) for k in (1, 2, 3))
    raw = (_back(ids.view(np.uint64), borders, 1), one * np.uint64(1024) + two, two, three)
    return np.stack([(mix(x * np.uint64(4) + np.uint64(i)) >> np.uint64(64 - bits)).astype(np.uint16) for i, x in enumerate(raw)], axis=1)


def _second(features: np.ndarray, groups: np.ndarray, bits: int) -> np.ndarray:
    """The features within a group."""
    return (features * np.uint16(GROUPS + 1) + (groups.astype(np.uint16)[:, None] + np.uint16(1)) * np.uint16(7919)) & np.uint16((1 << bits) - 1)


def _contexts(ids: np.ndarray, classes: np.ndarray, borders: np.ndarray, every: int) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens have an n-gram feature, and the ids of their contexts: the
    two words before and the token's class, for words without a class of their own.
    """
    words = ids.view(np.uint64)
    before = mix(mix(_back(words, borders, 1)) + _back(words, borders, 2))
    at = np.flatnonzero((before % np.uint64(every) == 0) & (classes >= CLASSES - ENDINGS))
    return at, mix(before[at] + classes[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _raised(weights: np.ndarray, features: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """What the softmax has for each class before it is divided by its sum."""
    logits = np.take(weights, features[:, 0].astype(np.intp), axis=0, mode="clip")
    for j in range(1, features.shape[1]):
        logits += np.take(weights, features[:, j].astype(np.intp), axis=0, mode="clip")
    logits += prior
    np.minimum(logits, 80, out=logits)  # in reach of exp() whatever the weights
    np.exp(logits, out=logits)
    logits += np.float32(1e-30)
    return logits


def _chances(weights: np.ndarray, features: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """The probabilities of all classes: a row for each class, a column for each token."""
    out = np.empty((weights.shape[1], len(features)), weights.dtype)
    for at in range(0, len(features), _COLUMNS):
        to = slice(at, at + _COLUMNS)
        raised = _raised(weights, features[to], prior if prior.ndim == 1 else prior[to])
        np.divide(raised.T, raised.sum(1), out=out[:, to])
    return out


def _chance(weights: np.ndarray, features: np.ndarray, prior: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The probability of one class for each token."""
    raised = _raised(weights, features, prior)
    return raised[np.arange(len(raised)), target] / raised.sum(1)


class Sums:
    """For each feature row: the observed counts of the classes with it and the
    expected ones, in _PARTS. A class is a column, to which a histogram of the
    features is added: their order doesn't matter, so nothing is sorted.
    """

    def __init__(self, rows: int, classes: int):
        self.rows, self.classes = rows, classes
        self.observed = np.zeros(rows * classes, np.int64)
        self.expected = np.zeros((classes, rows))

    def add(self, features: np.ndarray, chances: np.ndarray, target: np.ndarray) -> None:
        columns = [features[:, j].astype(np.intp) for j in range(features.shape[1])]
        for rows in columns:
            self.observed += np.bincount(rows * self.classes + target, minlength=len(self.observed))
        for own, p in zip(self.expected, chances):
            parts = np.rint(p.astype(float) * _PARTS)
            for rows in columns:
                own += np.bincount(rows, parts, minlength=self.rows)

    def table(self) -> np.ndarray:
        """Whole numbers: for each feature row how often it occurred, its observed and its expected counts."""
        observed = self.observed.reshape(self.rows, self.classes)
        return np.concatenate([observed.sum(1, keepdims=True), observed, self.expected.T.astype(np.int64)], axis=1)


def changed(weights: np.ndarray, sums: np.ndarray, rate: float, damp: float) -> np.ndarray:
    """The weights after a step up the gradient, observed less expected, in the
    scaled form log(observed / expected); damp expected counts are added to both.
    """
    k = weights.shape[1]
    n, observed, expected = sums[:, :1], sums[:, 1 : 1 + k], sums[:, 1 + k :] / _PARTS
    more = damp * np.maximum(expected / np.maximum(n, 1), 1e-6)
    step = rate * np.log((observed + more) / (expected + more))
    return (weights + np.clip(step, -3, 3)).astype(np.float32)


def _pieces(batches, lexicon: Lexicon, bits: int):
    for part, texts in blocks(batches, "text", 160_000):
        ids, borders = _tokens(texts)
        classes = lexicon.classes(ids)
        yield part, ids, borders, classes, _features(ids, classes, borders, bits)


def _train_step(docs: DataFrame, lexicon: Lexicon, model, bits: int, rate: float, damp: float):
    """The model after one step over all of docs. model: two weight tables."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((lexicon, *model))  # bounded: the lexicon's head and the two tables

    def run(batches):
        lexicon, w1, w2 = sent.value
        sums = [Sums(len(w), w.shape[1]) for w in (w1, w2)]
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def added():
            classes, features = (np.concatenate(x) for x in zip(*held))
            held.clear()
            for at in range(0, len(classes), _ADDED):
                own, groups, members = features[at : at + _ADDED], *np.divmod(classes[at : at + _ADDED], GROUPS)
                inner = _second(own, groups, bits)
                sums[0].add(own, _chances(w1, own, lexicon.prior1), groups)
                sums[1].add(inner, _chances(w2, inner, lexicon.prior2[groups]), members)

        for _, _, _, classes, features in _pieces(batches, lexicon, bits):
            held.append((classes, features))
            if sum(len(c) for c, _ in held) >= _ADDED:
                added()
        if held:
            added()
        for level, own in enumerate(sums):
            table = own.table()
            for at in range(0, len(table), _BLOCK):
                values = table[at : at + _BLOCK]
                if values[:, 0].any():
                    yield pa.RecordBatch.from_arrays([pa.array([level * len(table) + at]), pa.array([values.tobytes()])], names=["block", "sums"])

    def add(batches):
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for *key, values in zip(*[c.to_pylist() for c in batch.columns[:-1]], batch.columns[-1]):
                values = np.frombuffer(values.as_buffer(), np.int64)
                if tuple(key) in total:
                    total[tuple(key)] += values
                else:
                    total[tuple(key)] = values.copy()
        if total:
            keys = [pa.array(k) for k in zip(*total)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array([v.tobytes() for v in total.values()], pa.binary())], names=batch.schema.names)

    # Each task sends whole tables, so there are fewer tasks than partitions, each of more
    # text; a tree of sums: they meet in lanes first, so that no task reads those of all.
    tasks = max(spark.sparkContext.defaultParallelism, docs.rdd.getNumPartitions() // 16)
    lanes = max(1, int(tasks**0.5))
    schema = "block long, sums binary"
    found = docs.select("text").coalesce(tasks).mapInArrow(run, schema)
    laned = found.select((F.spark_partition_id() % lanes).cast("long").alias("lane"), "block", "sums")
    laned = laned.repartition(4 * lanes, "lane", "block").mapInArrow(add, "lane long, block long, sums binary")
    out = [w.copy() for w in model]
    for block, values in laned.select("block", "sums").repartition(32, "block").mapInArrow(add, schema).collect():
        level, at = divmod(block, 1 << bits)
        rows = slice(at, at + _BLOCK)
        out[level][rows] = changed(out[level][rows], np.frombuffer(values, np.int64).reshape(_BLOCK, -1), rate, damp)
    sent.unpersist()
    return tuple(out)


def _planes(values: np.ndarray) -> bytes:
    """The first bytes of all values, then their second ones, and so on: these compress."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()


def _unplaned(data: memoryview, at: int, n: int, kind: str) -> tuple[np.ndarray, int]:
    width = np.dtype(kind).itemsize
    values = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
    return np.ascontiguousarray(values).view(kind).ravel(), at + n * width


def _runs(keys: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by (key, tag), and where there in begin a new key and a new pair."""
    order = np.argsort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = np.diff(keys[order]) != 0
    pair = (np.cumsum(new) << 32) + tags[order]
    inner = np.argsort(pair, kind="stable")  # nearly sorted
    order, pair = order[inner], pair[inner]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = np.diff(pair) != 0
    return order, np.flatnonzero(new), np.flatnonzero(fresh)


def _packed(keys: np.ndarray, tags: np.ndarray, rows: np.ndarray, trains: np.ndarray, buckets: int):
    """(bucket, bytes): the distinct pairs of key and tag, how often each stands in
    all rows and in those that train, and the rows of each.
    """
    if not len(keys):
        return
    order, _, edge = _runs(keys, tags)
    rows = rows[order]
    n = np.diff(np.append(edge, len(rows))).astype(np.uint32)
    trained = np.add.reduceat(trains[rows].astype(np.uint32), edge, dtype=np.uint32)
    keys, tags = keys[order[edge]], tags[order[edge]]
    borders = np.searchsorted((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))
    edge = np.append(edge, len(rows))
    for b in np.flatnonzero(np.diff(borders)).tolist():
        own = slice(borders[b], borders[b + 1])
        parts = [_planes(x[own]) for x in (keys, tags, n, trained)]
        yield b, b"".join([np.uint32(own.stop - own.start).tobytes(), *parts, _planes(rows[edge[own.start] : edge[own.stop]])])


def _unpacked(data: memoryview) -> list[np.ndarray]:
    """Keys, tags, times, times in training, and the rows."""
    size, at, out = int(np.frombuffer(data, np.uint32, 1)[0]), 4, []
    for kind in ("<u8", "<i4", "<u4", "<u4"):
        values, at = _unplaned(data, at, size, kind)
        out.append(values)
    return [*out, _unplaned(data, at, int(out[2].sum()), "<u4")[0]]


#: What is sent: n-grams, words outside the table of frequent ones, and what a task knows of its rows.
_GRAMS, _WORDS, _ROWS = 0, 1, 2
_ROW_TYPES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])


def score_documents(
    docs: DataFrame,
    max_head: int = 131_072,
    bits: int = 15,
    steps: int = 4,
    epochs: int = 1,
    rate: float = 0.5,
    damp: float = 30.0,
    every: int = 1,
    mass: float = 2.0,
    places: int = 2_000_000,
) -> DataFrame:
    """One row for each row of docs (doc_id, text): held_out, n_tokens, n_known,
    train_tokens, base_score and score, log10.

    Rows whose crc32 of the doc_id as text is divisible by 10 are held out, also
    those without a doc_id (an empty text). A null or empty text is one end
    token. Repeated rows are scored one by one, and each trains. With nothing to
    train on, N is 0 and every token has the probability of an unknown one.
    Other columns are ignored. Words of one count are ordered by their hashes.

    The model: max_head bounds the table of frequent words, which are those that
    may have a class of their own or n-gram features. The softmaxes have 2^bits
    weight rows each (bits up to 16). An epoch is all training documents, in
    steps parts; the rate falls as 1 / (1 + 0.3 t) with the step t, and damp is
    in expected counts. Every context of two words has n-gram features (one in
    every of them, if every isn't 1), above mass words by their shares. All
    scores but base_score depend on these. A task holds about places tokens at
    once, which changes no result.
    """
    if not 9 <= bits <= 16:
        raise ValueError("bits must be 9 to 16")
    spark = docs.sparkSession
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 1_000_000
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (remainder % 10 == 0).alias("held_out"), remainder.alias("r"))
    train = docs.where(~F.col("held_out"))
    counts = checkpointed(count_words(train))
    lexicon = Lexicon(counts, max_head)
    model = tuple(np.zeros((1 << bits, n), np.float32) for n in (GROUPS, CLASSES // GROUPS))
    for t in range(steps * epochs if lexicon.total else 0):
        model = _train_step(train.where(F.floor(F.col("r") / 10) % steps == t % steps), lexicon, model, bits, rate / (1 + 0.3 * t), damp)
    sent = spark.sparkContext.broadcast((lexicon, *model))
    total, distinct = lexicon.total, lexicon.distinct
    floor = float(np.log10(total + 0.1 * (distinct + 1)))
    buckets = total // places + 1

    def scored(batches):
        """What the task knows of its rows, and what it asks of the buckets."""
        lexicon, w1, w2 = sent.value
        share = np.where(lexicon.share > 0, lexicon.share, 1.0)
        counted = np.log10(np.append(lexicon.head_counts, 0) + 0.1)
        grams, words, rows = [], [], []
        held = n_rows = 0
        group = TaskContext.get().partitionId() << 32

        def told():
            known = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
            trains = ~np.asarray(known.column(1).to_numpy(zero_copy_only=False), bool)
            out = [(group % buckets, _ROWS, known.serialize().to_pybytes())]
            for kind, asked in ((_GRAMS, grams), (_WORDS, words)):
                keys, tags, owners = (np.concatenate(x) for x in zip(*asked))
                out += [(b, kind, data) for b, data in _packed(keys, tags, owners, trains, buckets)]
                asked.clear()
            rows.clear()
            for at in range(0, len(out), 64):
                bucket, kind, data = zip(*out[at : at + 64])
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array([group] * len(bucket)), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "rows", "kind", "data"])

        for part, ids, borders, classes, features in _pieces(batches, lexicon, bits):
            groups, members = classes // GROUPS, classes % GROUPS
            p = _chance(w1, features, lexicon.prior1, groups).astype(np.float64)
            p *= _chance(w2, _second(features, groups, bits), lexicon.prior2[groups], members)
            score = np.log10(np.maximum(p, 1e-30))
            place = lexicon.places(ids)
            rare = place < 0
            own = counted[place]
            own[rare] = 0.0  # told by the bucket
            at, context = _contexts(ids, classes, borders, every)
            within = np.where(lexicon.share[classes] > 0, own - np.log10(share[classes]), 0.0)
            # Where there is an n-gram feature, its bucket tells all but what is known here.
            within[at] = np.where(rare[at], np.log10(mass) - np.log10(share[classes[at]]), 0.0)
            which = np.repeat(np.arange(part.num_rows, dtype=np.uint32), np.diff(borders)) + np.uint32(n_rows)
            grams.append((context, (place[at] + 1).astype(np.int32), which[at]))
            seldom = np.flatnonzero(rare)
            words.append((mix(ids[seldom].view(np.uint64)), np.zeros(len(seldom), np.int32), which[seldom]))
            first = borders[:-1]
            doc, out = (part.column(part.schema.get_field_index(k)) for k in ("doc_id", "held_out"))
            known = [np.diff(borders).astype(np.int64), np.add.reduceat((~rare).astype(np.int64), first), np.add.reduceat(own, first) - floor * np.diff(borders), np.add.reduceat(score + within, first)]
            rows.append(pa.RecordBatch.from_arrays([doc, out, *map(pa.array, known)], schema=_ROW_TYPES))
            held, n_rows = held + len(at) + len(seldom), n_rows + part.num_rows
            if held >= places or n_rows >= 50_000:
                yield from told()
                held, n_rows, group = 0, 0, group + 1
        if rows:
            yield from told()

    def answered(batches):
        """A bucket's counts, and what they add to the scores of each block of rows."""
        lexicon = sent.value[0]
        share = lexicon.share[lexicon.classes(lexicon.head_ids)]
        offset = np.append(0.0, mass * (lexicon.head_counts + 0.1) / np.where(share > 0, share, 1.0))
        asked: dict[int, list] = {_GRAMS: [], _WORDS: []}
        for batch in batches:
            for group, kind, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if kind == _ROWS:
                    yield _answer([group], [kind], [data.as_py()])
                else:
                    asked[kind].append((group, data.as_buffer()))
        for kind, own in asked.items():
            if not own:
                continue
            groups, parts = [g for g, _ in own], [_unpacked(memoryview(d)) for _, d in own]
            own.clear()
            keys, tags, _, trained = (np.concatenate([x[k] for x in parts]) for k in range(4))
            order, key_edge, pair_edge = _runs(keys, tags)
            c, known = trained[order].astype(np.int64), tags[order] > 0
            pairs = np.repeat(np.add.reduceat(c, pair_edge), np.diff(np.append(pair_edge, len(c))))
            value = np.empty(len(c))
            if kind == _WORDS:
                value[order] = pairs
            else:
                about = np.repeat(np.add.reduceat(c * known, key_edge), np.diff(np.append(key_edge, len(c))))
                lift = np.log10(np.where(known, pairs + offset[tags[order]], 1.0))
                value[order] = lift - np.log10(about + mass)
            del keys, tags, trained, order, c, known, pairs
            at, told = 0, []
            for mine, times, rows in ((p[0], p[2], p[4]) for p in parts):
                own_value = np.repeat(value[at : at + len(mine)], times)
                at += len(mine)
                adds = np.bincount(rows, np.log10(own_value + 0.1) if kind == _WORDS else own_value)
                found = np.bincount(rows, own_value > 0 if kind == _WORDS else None).astype(np.uint32)
                here = np.flatnonzero(np.bincount(rows)).astype(np.uint32)
                told.append(b"".join(_planes(x) for x in (here, adds[here], *([found[here]] if kind == _WORDS else []))))
            for at in range(0, len(told), 64):
                yield _answer(groups[at : at + 64], [kind] * len(told[at : at + 64]), told[at : at + 64])

    def summed(batches):
        """The rows of each block with all that was told of them."""
        now, waiting = None, []

        def told():
            known = next(pa.ipc.read_record_batch(pa.py_buffer(d), _ROW_TYPES) for k, d in waiting if k == _ROWS)
            n_known, base, score = (known.column(k).to_numpy().copy() for k in (3, 4, 5))
            for kind, data in waiting:
                if kind == _ROWS:
                    continue
                n = len(data) // (16 if kind == _WORDS else 12)
                here, at = _unplaned(data, 0, n, "<u4")
                adds, at = _unplaned(data, at, n, "<f8")
                score[here] += adds
                if kind == _WORDS:
                    base[here] += adds
                    n_known[here] += _unplaned(data, at, n, "<u4")[0]
            waiting.clear()
            return pa.RecordBatch.from_arrays([*known.columns[:3], *map(pa.array, (n_known, base, score))], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

        for batch in batches:
            for group, kind, data in zip(*(c.to_pylist() for c in batch.columns)):
                if waiting and group != now:
                    yield told()
                now = group
                waiting.append((kind, data))
        if waiting:
            yield told()

    asked = docs.select("doc_id", "held_out", "text").mapInArrow(scored, "bucket int, rows long, kind int, data binary")
    answers = asked.repartitionById(buckets, "bucket").mapInArrow(answered, "rows long, kind int, data binary")
    out = answers.repartition("rows").sortWithinPartitions("rows").mapInArrow(summed, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def _answer(groups: list[int], kinds: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(kinds, pa.int32()), pa.array(data, pa.binary())], names=["rows", "kind", "data"])


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


