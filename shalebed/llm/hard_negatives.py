"""Hard negatives by a vector-approximation file.

Each dimension's values are cut into sixteen cells at quantiles of all rows, and a row
is approximated by its cells, two dimensions to a byte. For an anchor, tables over all
cell pairs hold the least and the greatest product that a component in these cells can
contribute; summed by table lookup over a row's bytes they bound its score from below
and above. Only rows whose bounds let them enter what is looked for are scored exactly.

Anchors (a stated query set) meet all rows in blocks: a grid of packed blocks, one join
row a cell of the grid, so a task holds one block of either side and any cell can be
made again alone. Two rounds: the best rows of an anchor's label are its positives;
these open windows of scores, in which the best rows of other labels are found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table

CELLS = 16

#: Rows and anchors of one cell of the grid.
ROWS, ANCHORS = 4096, 512


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, label, v, copies): rows that take part, equal ones as one with their number.

    v has floor(256 * x) as long. So that sums of products are exact in 64 bits, values
    beyond 2^31 / sqrt(number of components) are set to that.
    """
    x = F.col(vector)
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    top = F.floor(F.lit(2.0**31) / F.sqrt(F.greatest(F.size(x), F.lit(1))))
    whole = F.transform(x, lambda c: F.floor(F.greatest(F.least(c.cast("double") * 256, top.cast("double")), -top.cast("double"))).cast("long"))
    return vectors.where(sound).select("vec_id", F.col("label").cast("long").alias("label"), whole.alias("v")).groupBy("vec_id", "label", "v").agg(F.count(F.lit(1)).alias("copies"))


def cell_edges(rows: DataFrame) -> np.ndarray:
    """(dimensions, CELLS + 1): least value, quantiles and greatest value of each dimension,
    over all rows; a missing component of a shorter vector is 0. One row a dimension
    comes to the driver.
    """
    inner = [i / CELLS for i in range(1, CELLS)]
    found = (
        rows.select(F.posexplode("v").alias("d", "x"))
        .groupBy("d")
        .agg(F.min("x").alias("low"), F.percentile_approx("x", F.array(*map(F.lit, inner)), F.lit(1000)).alias("inner"), F.max("x").alias("high"))
        .orderBy("d")
        .collect()
    )
    edges = np.array([[r.low, *r.inner, r.high] for r in found], np.int64).reshape(-1, CELLS + 1)
    edges[:, 0], edges[:, -1] = np.minimum(edges[:, 0], 0), np.maximum(edges[:, -1], 0)
    return edges


class Approximation:
    """Cells of vectors, and bounds of inner products by table lookup."""

    def __init__(self, edges: np.ndarray):
        self.dims = len(edges)
        even = np.concatenate([edges, np.zeros((self.dims % 2, CELLS + 1), np.int64)])
        self.inner = even[:, 1:-1]
        # Cell c holds values from its lower edge up to the next one, both included.
        self.low, self.high = even[:, :-1], even[:, 1:]

    def codes(self, v: np.ndarray) -> np.ndarray:
        """(bytes, rows) for vectors (rows, dimensions): two cells to a byte."""
        cells = np.zeros((len(self.inner), len(v)), np.uint8)
        for d in range(v.shape[1]):
            cells[d] = np.searchsorted(self.inner[d], v[:, d], "right")
        return cells[0::2] * CELLS + cells[1::2]

    def tables(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each byte place, what each byte adds to the lower and to the upper bound."""
        q = np.zeros((len(self.inner), 1), np.int64)
        q[: len(anchor), 0] = anchor
        a, b = q * self.low, q * self.high
        least, most = np.minimum(a, b), np.maximum(a, b)
        return tuple((t[0::2, :, None] + t[1::2, None, :]).reshape(-1, CELLS * CELLS) for t in (least, most))


def bounds(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The sums over all byte places; codes: (bytes, rows)."""
    total = np.zeros(codes.shape[1], np.int64)
    for row, code in zip(tables, codes, strict=True):
        total += row[code]
    return total


def _least_of_best(lower: np.ndarray, copies: np.ndarray, k: int) -> int | None:
    """A score that k rows (counted with their copies) are sure to reach; None if there are fewer."""
    if len(lower) > 4 * k:
        keep = np.argpartition(-lower, k - 1)[:k]  # k rows are k copies at least
        lower, copies = lower[keep], copies[keep]
    order = np.argsort(-lower)
    enough = np.flatnonzero(np.cumsum(copies[order]) >= k)
    return int(lower[order[enough[0]]]) if len(enough) else None


def _first(score: np.ndarray, ids: np.ndarray, copies: np.ndarray, k: int) -> np.ndarray:
    """The places of the first k rows (counted with their copies), by score, then id."""
    order = np.lexsort((ids, -score))[:k]
    return order[np.cumsum(copies[order]) - copies[order] < k]


class Block:
    """A packed block of rows in the order of their labels."""

    def __init__(self, items: pa.StructArray, shape: Approximation):
        get = lambda name: items.field(name).to_numpy(zero_copy_only=False)
        order = np.argsort(get("label"), kind="stable")
        self.number, self.ids, self.label, self.copies = (get(n)[order] for n in ("number", "vec_id", "label", "copies"))
        lists = items.field("v")
        counts = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        v = np.zeros((len(order), shape.dims), np.int64)
        v[np.repeat(np.arange(len(order)), counts), np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)] = flat
        self.v = v[order]
        self.shape = shape

    def approximate(self) -> Block:
        self.codes = self.shape.codes(self.v)
        return self

    def of(self, label: int) -> slice:
        return slice(*np.searchsorted(self.label, [label, label + 1]))


def best_of_label(anchor: np.ndarray, own: int, label: int, block: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the block and scores of the first k other rows of a label."""
    at = block.of(label)
    # The row itself is no other row; its copies are.
    copies = block.copies[at] - (block.number[at] == own)
    low, high = block.shape.tables(anchor)
    floor = _least_of_best(bounds(low, block.codes[:, at])[copies > 0], copies[copies > 0], k)
    may = copies > 0 if floor is None else (copies > 0) & (bounds(high, block.codes[:, at]) >= floor)
    place = np.flatnonzero(may) + at.start
    score = block.v[place] @ anchor
    first = _first(score, block.ids[place], copies[may], k)
    return place[first], score[first]


def best_in_windows(anchor: np.ndarray, label: int, windows: list[tuple[int, int]], block: Block, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window (least and greatest score) the places and scores of the first k
    rows of other labels in it.
    """
    at = block.of(label)
    low, high = block.shape.tables(anchor)
    place = np.concatenate([np.arange(at.start), np.arange(at.stop, len(block.ids))])
    upper = bounds(high, block.codes)[place]
    may = upper >= min(w[0] for w in windows)
    place, upper = place[may], upper[may]
    lower = bounds(low, block.codes[:, place])
    wanted = np.zeros(len(place), bool)
    for least, most in windows:
        within = (upper >= least) & (lower <= most)
        sure = within & (lower >= least) & (upper <= most)
        floor = _least_of_best(lower[sure], block.copies[place[sure]], k)
        wanted |= within if floor is None else within & (upper >= floor)
    place = place[wanted]
    score = block.v[place] @ anchor
    found = []
    for least, most in windows:
        inside = np.flatnonzero((score >= least) & (score <= most))
        first = inside[_first(score[inside], block.ids[place[inside]], block.copies[place[inside]], k)]
        found.append((place[first], score[first]))
    return found


def _packed(rows: DataFrame, blocks: int, name: str, *columns: str) -> DataFrame:
    """(name, items): rows as blocks of bounded size, dealt by their numbers."""
    deal = F.pmod(F.xxhash64("number"), F.lit(blocks)).alias(name)
    return rows.select(deal, F.struct(*columns).alias("item")).groupBy(name).agg(F.collect_list("item").alias("items"))


def _grid(anchors: DataFrame, packed: DataFrame, chunks: int, blocks: int) -> DataFrame:
    """One row for each pair of a chunk of anchors and a block of rows."""
    left = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = packed.withColumnRenamed("items", "rows").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    return left.hint("shuffle_merge").join(right, ["chunk", "block"])


def _cells(batches, shape: Approximation):
    """(anchor items, block of anchors, block of rows) for each cell of the grid."""
    for batch in batches:
        for i in range(batch.num_rows):
            items, rows = (batch.column(batch.schema.get_field_index(n)).slice(i, 1).flatten() for n in ("items", "rows"))
            yield items, Block(items, shape), Block(rows, shape).approximate()


def _ranked(found: DataFrame, keys: list[str], id_: str, score: str, k: int) -> DataFrame:
    """The first k rows of each key by score, then id, copies as rows of their own."""
    from pyspark.sql import Window

    one = found.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.least(F.col("copies"), F.lit(k)).cast("int")))).drop("__copy", "copies")
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(id_))
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_negatives(vectors: DataFrame, is_anchor: Column, vector: str = "embedding", positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank (int, from 1), negative_id, positive_score, negative_score.

    vectors has vec_id, label and the vector. An anchor's positives are its first other
    rows of the same label; a positive's negatives the first rows of other labels whose
    score is between least and most hundredths of the positive's. Scores are inner
    products of floor(256 * x); higher ones come first, ties by smaller vec_id.

    Rows with a null vec_id, label or vector or a null or non-finite component take no
    part. Components that a shorter vector lacks count as 0. Repeated rows count one by
    one, as positives, as negatives and as anchors; a repeated anchor's copies are other
    rows. Other columns don't matter; an empty table gives an empty result.

    Work grows with anchors times rows, memory with a cell of the grid: ANCHORS x ROWS.
    Rows travel once for each ANCHORS anchors, packed.
    """
    rows = usable(vectors, vector)
    rows = checkpointed(rows.withColumn("number", F.monotonically_increasing_id()).withColumn("is_anchor", F.coalesce(is_anchor, F.lit(False))))
    total, asked = rows.agg(F.count(F.lit(1)), F.count_if("is_anchor")).first()
    blocks, chunks = max(1, -(-total // ROWS)), max(1, -(-asked // ANCHORS))
    shape = Approximation(cell_edges(rows))
    packed = checkpointed(_packed(rows, blocks, "block", "number", "vec_id", "label", "copies", "v"))
    anchors = rows.where("is_anchor")

    def same(batches):
        for _, asking, block in _cells(batches, shape):
            out = []
            for i in range(len(asking.ids)):
                place, score = best_of_label(asking.v[i], asking.number[i], asking.label[i], block, positives)
                copies = block.copies[place] - (block.number[place] == asking.number[i])
                out.append((np.full(len(place), asking.number[i]), block.ids[place], score, copies))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["number", "positive_id", "positive_score", "copies"])

    found = _grid(_packed(anchors, chunks, "chunk", "number", "vec_id", "label", "copies", "v"), packed, chunks, blocks)
    found = found.mapInArrow(same, "number long, positive_id long, positive_score long, copies long")
    best = checkpointed(_ranked(found, ["number"], "positive_id", "positive_score", positives))

    windows = best.groupBy("number").agg(F.collect_set("positive_score").alias("scores"))
    asked = anchors.join(windows, "number")

    def other(batches):
        for items, asking, block in _cells(batches, shape):
            scores = dict(zip(items.field("number").to_pylist(), items.field("scores").to_pylist(), strict=True))
            out = [(np.zeros(0, np.int64),) * 5]
            for i, number in enumerate(asking.number.tolist()):
                # 100 * score from least * p to most * p, in whole numbers.
                spans = [(p, (-(-least * p // 100), most * p // 100)) for p in scores[number]]
                spans = [(p, w) for p, w in spans if w[0] <= w[1]]
                if not spans:
                    continue
                for (p, _), (place, score) in zip(spans, best_in_windows(asking.v[i], asking.label[i], [w for _, w in spans], block, negatives), strict=True):
                    out.append((np.full(len(place), number), np.full(len(place), p), block.ids[place], score, block.copies[place]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["number", "positive_score", "negative_id", "negative_score", "copies"])

    found = _grid(_packed(asked, chunks, "chunk", "number", "vec_id", "label", "copies", "v", "scores"), packed, chunks, blocks)
    found = found.mapInArrow(other, "number long, positive_score long, negative_id long, negative_score long, copies long")
    hard = _ranked(found, ["number", "positive_score"], "negative_id", "negative_score", negatives)
    named = anchors.select("number", F.col("vec_id").alias("anchor_id"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy"))
    return (
        best.select("number", "positive_id", "positive_score")
        .join(hard, ["number", "positive_score"])
        .join(named, "number")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding")
    return mine_negatives(vectors, F.col("vec_id") % 50 == 0)


OP13_SQL = """
WITH usable AS (
    SELECT row_number() OVER () AS number, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
    SELECT a.number AS anchor, a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
    FROM usable a JOIN usable r ON a.number <> r.number
    WHERE a.vec_id % 50 = 0
), positives AS (
    SELECT anchor, anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
    s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON p.anchor = s.anchor AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 3
"""
