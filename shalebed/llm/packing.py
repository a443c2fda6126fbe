"""Packing by lexical retrieval: documents of like words share a training window.

Each text is tokenized once, where it is read, and what it gives is checkpointed:
full windows of a long document are sequences by themselves, without their ids;
what remains of every document (less than a window) is packed. Document
frequencies and the mean length are those of all remainders. Shards are cut from
the remainders in the order of three weighted MinHashes of their words, so that
documents of like words lie in one shard whatever the size of the corpus, and
equal ones, however many, go on into the next.

A shard is a BM25 inverted index of its remainders: the longest unused one is the
seed of a window, its nearest unused neighbours fill it, and the next neighbour is
cut to close it. The last tokens of a shard go into windows whose lengths are
powers of two. So nothing is padded.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_words import blocks, mix, strings
from .common import checkpointed, table

END = 1
_LETTER = "A-Za-zÀ-ÖØ-öø-ſ"
#: Texts of these characters only are split by the pattern below as the tokenizer splits them.
_PLAIN = re.compile(f"[\\t\\n\\r\\x20-\\x7e{_LETTER}]*")
_SPLIT = f"'(?:[sdmt]|ll|ve|re)| ?[{_LETTER}]+| ?[0-9]+| ?[^\\s{_LETTER}0-9]+|\\s+(?!\\S)|\\s+"


class _Parts(dict):
    """The ids of each part of a plain text, as bytes; emptied when it is full."""

    def __init__(self, ranks_path: str, most: int = 600_000):
        import base64

        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("pieces", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.most = most
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.sizes[list(ranks.values())] = list(map(len, ranks))

    def __missing__(self, part: bytes) -> bytes:
        self[part] = ids = array("I", self.encoding.encode_ordinary(part.decode())).tobytes()
        return ids

    def all_of(self, parts: list[bytes]) -> list[bytes]:
        """New words with a space before them are encoded together: no id reaches over the space."""
        if len(self) + len(parts) > self.most:
            self.clear()
        new = [part for part in parts if part not in self and len(part) > 1 and part[0] == 32]
        if new:
            ids = np.array(self.encoding.encode_ordinary(b"".join(new).decode()), "<u4")
            ends = np.cumsum([len(part) for part in new])
            borders = (4 * np.searchsorted(np.cumsum(self.sizes[ids]), ends, "right")).tolist()
            data = ids.tobytes()
            self.update((part, data[a:b]) for part, a, b in zip(new, [0, *borders], borders))
        return [self[part] for part in parts]


def _alone(text: str) -> bool:
    """Whether white space stands alone in a plain text, but for two line feeds
    before a word: then a split piece begins at each space, and each line feed is one.
    """
    return not ("  " in text or " \n" in text or "\n " in text or "\n\n\n" in text or text.endswith("\n\n") or "\t" in text or "\r" in text)


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit numbers.

    The same ids as the tokenizer's of tokenizer_path. Plain texts are parted at
    white space, and of a block of texts each distinct part is looked up once;
    ranks_path has the tokenizer's vocabulary as ranks.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer_path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.parts = _Parts(ranks_path)

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text]))[0].tobytes()

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        texts = strings(texts)
        plain = np.ones(len(texts), bool)
        out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(texts)
        for k, text in enumerate(texts.to_pylist()):
            if not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
                ids = self.whole.encode(text, add_special_tokens=False).ids
            elif not _alone(text):
                ids = self.parts.encoding.encode_ordinary(text)
            else:
                continue
            plain[k], out[k] = False, np.array(ids, "<u4")
        rows = np.flatnonzero(plain)
        if len(rows) < len(texts):
            texts = texts.take(pa.array(rows))
        for k, ids in zip(rows.tolist(), self._parted(texts)):
            out[k] = ids
        return out

    def _parted(self, texts: pa.Array) -> list[np.ndarray]:
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        raw = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        feed = raw == ord("\n")
        begins = feed | (raw == ord(" "))
        begins[1:] |= feed[:-1]
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(begins)
        parts = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(raw))), pa.py_buffer(raw)]).dictionary_encode()
        found = self.parts.all_of(parts.dictionary.to_numpy(zero_copy_only=False).tolist())
        length = np.fromiter(map(len, found), np.int64, len(found)) // 4
        table = np.frombuffer(b"".join(found), "<u4")
        which = parts.indices.to_numpy()
        n = length[which]
        ends = np.cumsum(n)
        ids = table[np.arange(n.sum()) + np.repeat((np.cumsum(length) - length)[which] - (ends - n), n)]
        borders = np.append(0, ends)[np.searchsorted(starts, offsets)].tolist()
        return [ids[a:b] for a, b in zip(borders, borders[1:])]


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(tokenizer_path: str, ranks_path: str) -> Encoder:
    key = (tokenizer_path, ranks_path)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


class Terms:
    """The remainders' statistics: how many, their mean length, and how many hold each id."""

    def __init__(self, n: int, total: int, df: np.ndarray):
        self.n, self.mean, self.df = max(1, n), max(1.0, total / max(1, n)), df
        self.idf = np.log1p((self.n - np.minimum(df, self.n) + 0.5) / (df + 0.5))
        draws = (mix(np.arange(3 * len(df), dtype=np.uint64)).astype(float) + 1) / 2.0**64
        self._draws = -np.log(np.minimum(draws, 1 - 1e-16)).reshape(3, -1) / self.idf

    def content(self, ids: list[np.ndarray]) -> np.ndarray:
        """Three weighted MinHashes of each remainder: equal ones have equal, and
        like ones share the first with the likelihood of their weighted overlap.
        """
        first = np.cumsum([0, *[len(x) for x in ids]])[:-1]
        every = np.concatenate(ids)
        return np.stack([np.minimum.reduceat(d[every], first) for d in self._draws], axis=1)


class Shard:
    """The inverted index of a shard's remainders and the windows they fill. Ids
    that an eighth of the remainders have are in a dense table, others have postings.
    """

    def __init__(self, ids: list[np.ndarray], window: int, terms: Terms):
        self.ids, self.window = ids, window
        m = len(ids)
        self.left = np.array([len(x) for x in ids])
        self.begun = np.zeros(m, np.int64)
        owner = np.repeat(np.arange(m), self.left)
        pair, tf = np.unique(owner * 65536 + np.concatenate(ids).astype(np.int64), return_counts=True)
        doc, term = pair // 65536, pair % 65536
        norm = 1.2 * (0.25 + 0.75 * self.left / terms.mean)
        weight = terms.idf[term] * tf * 2.2 / (tf + norm[doc])
        here = np.bincount(term, minlength=65536)
        common = here > max(1, m // 8)
        column = np.cumsum(common) - 1
        use = common[term]
        self.dense = np.zeros((m, int(common.sum())), np.float32)
        self.dense[doc[use], column[term[use]]] = weight[use]
        use = ~use & (here[term] > 1)  # an id of one remainder finds none
        doc, term, weight = doc[use], term[use], weight[use]
        self.doc_first = np.searchsorted(doc, np.arange(m + 1))
        self.doc_terms = term
        order = np.argsort(term, kind="stable")
        self.posted, self.posted_weight = doc[order], weight[order]
        self.term_first = np.searchsorted(term[order], np.arange(65537))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every remainder for all distinct ids of the seed."""
        scores = self.dense @ (self.dense[seed] > 0).astype(np.float32)
        spans = [slice(self.term_first[t], self.term_first[t + 1]) for t in self.doc_terms[self.doc_first[seed] : self.doc_first[seed + 1]].tolist()]
        if spans:
            scores = scores + np.bincount(
                np.concatenate([self.posted[s] for s in spans]), np.concatenate([self.posted_weight[s] for s in spans]), len(self.left)
            )
        return scores

    def neighbours(self, seed: int) -> np.ndarray:
        """The unused remainders that share words with the seed, best first."""
        scores = self.scores(seed)
        scores[self.left == 0] = 0
        found = np.flatnonzero(scores)
        return found[np.argsort(-scores[found], kind="stable")]

    def windows(self):
        """Lists of (remainder, its start, length), each list one window."""
        order = np.argsort(-self.left, kind="stable")
        next_seed, space = 0, 0
        pieces: list[tuple[int, int, int]] = []

        def take(i: int, n: int) -> None:
            pieces.append((i, int(self.begun[i]), n))
            self.begun[i] += n
            self.left[i] -= n

        while True:
            while next_seed < len(order) and not self.left[order[next_seed]]:
                next_seed += 1
            if next_seed == len(order):
                break
            if not pieces:
                space = self.window
            seed = int(order[next_seed])
            n = min(int(self.left[seed]), space)
            take(seed, n)
            space -= n
            if space:
                near = self.neighbours(seed)
                for i in near.tolist():
                    if self.left[i] <= space:
                        n = int(self.left[i])
                        take(i, n)
                        space -= n
                        if not space:
                            break
                else:
                    rest = near[self.left[near] > 0] if len(near) else near
                    if len(rest):
                        take(int(rest[0]), space)
                        space = 0
            if not space:
                yield pieces
                pieces = []
        # The last tokens: windows of the powers of two that add up to them.
        total = self.window - space if pieces else 0
        for bit in range(total.bit_length() - 1, -1, -1):
            space = total & (1 << bit)
            own = []
            while space:
                i, start, n = pieces.pop(0)
                if n > space:
                    pieces.insert(0, (i, start + space, n - space))
                    n = space
                own.append((i, start, n))
                space -= n
            if own:
                yield own


def _statistics(rests: DataFrame) -> Terms:
    """Of all remainders (length, ids); a row for each of at most 65,536 ids comes to the driver."""

    def run(batches):
        df, n, total = np.zeros(65536, np.int64), 0, 0
        for batch in batches:
            for ids in batch.column(0):
                own = np.frombuffer(ids.as_buffer(), "<u2")
                df[np.unique(own)] += 1
                n, total = n + 1, total + len(own)
        seen = np.flatnonzero(df)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *seen.tolist()]), pa.array([n, total, *df[seen].tolist()])], names=["id", "n"])

    found = dict(rests.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n")).collect())
    df = np.zeros(65536, np.int64)
    for k, n in found.items():
        if k >= 0:
            df[k] = n
    return Terms(found.get(-1, 0), found.get(-2, 0), df)


#: The columns of a piece.
_PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
_PIECE_TYPES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    ranks_path: str,
    window: int = 2048,
    docs_per_shard: int = 2048,
    with_ids: bool = False,
    max_tasks: int = 20_000,
) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and the ids themselves if with_ids.

    A document's ids end with one id 1; a null or empty text has that only.
    Each id is in one piece; the pieces of a sequence follow each other without
    gaps, window ids at most. Repeated rows are packed one by one; a null doc_id
    stays null. Columns but doc_id and text are ignored. A shard holds at most
    docs_per_shard remainders, a task several shards one after the other, so its
    memory is bounded however long the texts are and however many are equal.
    All ids of a seed are looked up. The vocabulary has fewer than 65,536 ids.
    """

    def cut(batches):
        encode = encoder(tokenizer_path, ranks_path).encode_all
        for part, texts in blocks(batches, "text"):
            out = []
            for doc_id, ids in zip(part.column(0).to_pylist(), encode(texts)):
                ids = np.append(ids, np.uint32(END))
                n = len(ids)
                for start in range(0, n, window):
                    own = ids[start : start + window]
                    full = len(own) == window
                    short = None if full and not with_ids else own.astype("<u2").tobytes()
                    out.append((doc_id, start, len(own), zlib.crc32(own), n, short))
            kinds = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[*_PIECE[:5], "ids"])

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cuts = checkpointed(dealt.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary").withColumn("row", F.monotonically_increasing_id()))
    rests = cuts.where(F.col("length") < window)
    statistics = _statistics(rests)
    sent = docs.sparkSession.sparkContext.broadcast(statistics)  # of at most 65,536 ids
    shards = max(1, -(-statistics.n // docs_per_shard))
    keys = ["k1", "k2", "k3", "salt"]

    def keyed(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids = [np.frombuffer(x.as_buffer(), "<u2") for x in part.column(part.schema.get_field_index("ids"))]
                content = sent.value.content(ids)
                salt = mix(part.column(part.schema.get_field_index("row")).to_numpy().astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(c) for c in content.T], pa.array(salt)], names=[*part.schema.names, *keys])

    def filled(task: int, begun: int, rows: pa.Table):
        doc, start, length, crc, total = (rows.column(c).to_pylist() for c in _PIECE[:5])
        arrays = [np.frombuffer(x.as_buffer(), "<u2") for x in rows.column("ids")]
        out, sequence = [], begun
        for pieces in Shard(arrays, window, sent.value).windows():
            offset = 0
            for r, at, n in pieces:
                own = arrays[r][at : at + n]
                code = crc[r] if n == length[r] else zlib.crc32(own.astype("<u4").tobytes())
                out.append((doc[r], start[r] + at, n, code, total[r], 2 * ((task << 33) + sequence), offset, own.tobytes() if with_ids else None))
                offset += n
            sequence += 1
        columns = list(zip(*out))
        return sequence, pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:7]] + [pa.array(columns[7], pa.binary())], names=_PIECE)

    def fill(batches):
        waiting: list[pa.RecordBatch] = []
        held = sequence = 0
        for batch in batches:
            while batch.num_rows:
                task = batch.column(0)[0].as_py()
                part = batch.slice(0, docs_per_shard - held)
                waiting.append(part)
                held += part.num_rows
                batch = batch.slice(part.num_rows)
                if held == docs_per_shard:
                    sequence, out = filled(task, sequence, pa.Table.from_batches(waiting))
                    yield out
                    waiting, held = [], 0
        if held:
            yield filled(task, sequence, pa.Table.from_batches(waiting))[1]

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, row long, k1 double, k2 double, k3 double, salt long"
    packed = (
        rests.mapInArrow(keyed, schema)
        .repartitionByRange(max(1, min(shards // 4, max_tasks)), *keys)
        .sortWithinPartitions(*keys)
        .select(F.spark_partition_id().cast("long").alias("task"), *_PIECE[:5], "ids")
        .mapInArrow(fill, _PIECE_TYPES)
    )
    # Packed sequences have even numbers, those that are one document's window odd ones.
    whole = cuts.where(F.col("length") == window).select(
        *_PIECE[:5], (2 * F.col("row") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids"
    )
    pieces = packed.unionByName(whole)
    if not with_ids:
        return pieces.drop("ids")
    # Two bytes an id in transit, numbers in the result.
    pairs = F.transform(F.sequence(F.lit(0), F.col("length") - 1), lambda i: F.hex(F.substring("ids", (2 * i + 1).cast("int"), F.lit(2))))
    return pieces.withColumn("ids", F.transform(pairs, lambda h: F.conv(F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2)), 16, 10).cast("int")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
    )
