"""Encoding and decoding with a byte-pair vocabulary of words, by speculation.

A greedy longest match proposes the pieces of a word, which is right for most
words. Whether it is can be told from adjacent pieces alone: merges have one rank
each and every piece comes from one merge, so merges inside two pieces happen in
the same order whatever stands around them, and the first merge across a border
would also be made if the two pieces stood alone. Two pieces may stand side by side
unless some right edge of the left one and some left edge of the right one, that
exist at the same time, are merged before either is merged into its own piece.
That is looked up for all adjacent pairs of all words at once, edge by edge. Only
words with a pair that may not are encoded by merging, from the lowest rank up.
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_words import Words, blocks, strings
from .common import WHITE, extended, table

END = "</w>"
_LATE = np.int64(1) << 40


def _letters() -> list[str]:
    """The character that stands for each byte in vocabularies of byte-level pieces:
    printable ones of Latin-1 for themselves, the others by number from 256.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def _unassigned() -> np.ndarray:
    """For each code point whether this Python's Unicode tables don't know it: tables of
    another version may give it a case or a kind.
    """
    return np.array([unicodedata.category(chr(i)) == "Cn" for i in range(0x110000)])


class Lookup:
    """Numbers by 64-bit keys, for arrays of keys; -1 for keys that have none."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 3).bit_length())
        self._shift = np.uint64(64 - bits)
        self._keys = np.full((1 << bits) + 64, -1, np.int64)
        self._values = np.full((1 << bits) + 64, -1, np.int64)
        for k, v, p in zip(keys.tolist(), values.tolist(), self._place(keys).tolist(), strict=True):
            while self._keys[p] >= 0:
                p += 1
            self._keys[p], self._values[p] = k, v

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        place = self._place(keys)
        found = np.where(self._keys[place] == keys, self._values[place], -1)
        open_ = np.flatnonzero((self._keys[place] != keys) & (self._keys[place] >= 0))
        while len(open_):
            place[open_] += 1
            at = self._keys[place[open_]]
            hit = at == keys[open_]
            found[open_[hit]] = self._values[place[open_[hit]]]
            open_ = open_[~hit & (at >= 0)]
        return found


class Remembered:
    """Ids of strings that were met."""

    def __init__(self):
        self.place: dict = {}
        self.size = 0
        self._ids, self._ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def add(self, new: list, ids: np.ndarray, ends: np.ndarray) -> None:
        self.place |= {w: len(self.place) + i for i, w in enumerate(new)}
        self._ends = np.concatenate([self._ends, ends + len(self._ids)])
        self._ids = np.concatenate([self._ids, ids.astype(np.int32)])
        self.size += sum(map(len, new)) + 100 * len(new)

    def places(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def ids_of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the strings at these places one behind another, and where each one's end."""
        counts = self._ends[places + 1] - self._ends[places]
        total = np.cumsum(counts)
        return self._ids[np.arange(total[-1] if len(total) else 0) + np.repeat(self._ends[places + 1] - total, counts)], total


class WordEncoder:
    """A vocabulary file of the tokenizers library: BPE over the bytes of words, with
    a mark at their ends, after NFC and lower-casing. Another kind is an error.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]], [s["type"] for s in steps]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != END or kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or spec["decoder"] or spec["post_processor"]:
            raise ValueError(f"{path}: not a vocabulary of lower-case words with ends")
        self._path, self._library = path, None
        self._words = regex.compile(steps[0]["pattern"]["Regex"])
        self._words_and_lines = regex.compile(steps[0]["pattern"]["Regex"] + r"|\n")
        self._unknown = _unassigned()
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        marks = "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))
        self._special = regex.compile(f"({marks})") if marks else None
        letters = _letters()
        # Symbols 0-255 are bytes, 256-511 bytes at the end of a word.
        self._symbol = np.array([vocab[c + e] for e in ("", END) for c in letters], np.int64)
        self._compile(vocab, [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])
        self._clear()

    def _compile(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        n = max(vocab.values()) + 1
        self._n = n
        self.born = np.full(n, -1, np.int64)
        self._left, self._right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if self.born[z] >= 0 or max(self.born[x], self.born[y]) >= rank:
                raise ValueError(f"{self._path}: merge {rank} makes a piece again or uses a later one")
            self.born[z], self._left[z], self._right[z] = rank, x, y
            self.ranks[x, y] = rank, z
        pairs = np.array(list(self.ranks), np.int64).reshape(-1, 2)
        self._made = np.array([z for _, z in self.ranks.values()], np.int64)
        self._merge = Lookup(pairs[:, 0] * n + pairs[:, 1], np.arange(len(pairs)))
        # Pieces as symbols, in a trie; those that merging doesn't make of their own bytes are never right.
        spelt: dict[int, list[int]] = {int(i): [s] for s, i in enumerate(self._symbol)}
        for z in np.argsort(self.born, kind="stable"):
            if self.born[z] >= 0:
                spelt[int(z)] = spelt[int(self._left[z])] + spelt[int(self._right[z])]
        made = np.flatnonzero(self.born >= 0)
        holds = dict(zip(made.tolist(), self._pairs_hold(self._left[made], self._right[made], self.born[made]).tolist(), strict=True))
        whole = dict.fromkeys(self._symbol.tolist())
        for z in made[np.argsort(self.born[made])].tolist():
            if holds[z] and int(self._left[z]) in whole and int(self._right[z]) in whole:
                whole[z] = None
        nodes: dict[tuple[int, int], int] = {}
        piece = {0: -1}
        for z in whole:
            at = 0
            for s in spelt[z]:
                at = nodes.setdefault((at, s), len(nodes) + 1)
            piece[at] = z
        self._piece = np.array([piece.get(i, -1) for i in range(len(nodes) + 1)], np.int64)
        self._trie = Lookup(np.array([a * 512 + s for a, s in nodes], np.int64), np.array(list(nodes.values()), np.int64))

    def _pairs_hold(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge crosses the border of pieces a and b (before rank until)."""
        a, b = a.copy(), b.copy()
        held = np.ones(len(a), bool)
        # a is the right edge of the left piece, b the left edge of the right one; dead_a, dead_b: when they were merged away.
        dead_a = np.full(len(a), _LATE) if until is None else until.astype(np.int64).copy()
        dead_b = dead_a.copy()
        open_ = np.arange(len(a))
        while len(open_):
            x, y = a[open_], b[open_]
            rank = self._merge(x * self._n + y)
            # Of equal ranks the leftmost merge goes first: inside the left piece before the border, at the border before inside the right one.
            crosses = (rank >= 0) & (rank < dead_a[open_]) & (rank <= dead_b[open_])
            if until is not None:
                crosses &= rank < until[open_]
            held[open_[crosses]] = False
            later_a = self.born[x] > self.born[y]
            over = crosses | ((self.born[x] < 0) & (self.born[y] < 0))
            go_a, go_b = open_[later_a & ~over], open_[~later_a & ~over]
            dead_a[go_a], a[go_a] = self.born[a[go_a]], self._right[a[go_a]]
            dead_b[go_b], b[go_b] = self.born[b[go_b]], self._left[b[go_b]]
            open_ = open_[~over]
        return held

    def propose(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy pieces of words that stand one behind another in data (symbols), and
        the word of each. ends: where each word ends.
        """
        n = len(data)
        word = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        node = np.zeros(n, np.int64)
        best, length = np.full(n, -1, np.int64), np.ones(n, np.int64)
        live, depth = np.arange(n), 0
        while len(live):
            at = self._trie(node[live] * 512 + data[live + depth])
            live, at = live[at >= 0], at[at >= 0]
            depth += 1
            node[live] = at
            found = self._piece[at]
            best[live[found >= 0]], length[live[found >= 0]] = found[found >= 0], depth
            live = live[live + depth < ends[word[live]]]
        onward = np.arange(n) + length
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        chosen = np.zeros(n, bool)
        places, lanes = starts[starts < ends], ends[starts < ends]
        for _ in range(64):
            chosen[places] = True
            places = onward[places]
            lanes, places = lanes[places < lanes], places[places < lanes]
            if not len(places):
                break
        steps = onward.tolist() if len(places) else []
        for p, end in zip(places.tolist(), lanes.tolist(), strict=True):  # words of over 64 pieces
            while p < end:
                chosen[p] = True
                p = steps[p]
        return best[chosen], word[chosen]

    def merged(self, symbols: list[int]) -> list[int]:
        """A word's pieces by merging: the lowest rank first, of equal ones the leftmost."""
        ids = self._symbol[symbols].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(*r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.ranks.get((ids[i], ids[i + 1])))]
        queue = [(rank, i, z, x, y) for rank, z, i, x, y in queue]
        heapq.heapify(queue)
        while queue:
            _, i, z, x, y = heapq.heappop(queue)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], ids[j] = z, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k, m in ((before[i], i), (i, after[i])):
                if k >= 0 and m < n and (r := self.ranks.get((ids[k], ids[m]))):
                    heapq.heappush(queue, (r[0], k, r[1], ids[k], ids[m]))
        return [i for i in ids if i >= 0]

    def merged_together(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """The same for many short words at once, a merge of each word in a step."""
        width = int(sizes.max())
        place = np.arange(width)
        inside = place < sizes[:, None]
        ids = np.full((len(sizes), width + 1), -1, np.int64)
        ids[:, :width][inside] = self._symbol[data[(starts[:, None] + place)[inside]]]
        ranks = np.full((len(sizes), width), _LATE)

        def rank(rows, columns):
            ok = (columns >= 0) & (columns < width)
            a = ids[rows, np.where(ok, columns, 0)]
            b = ids[rows, np.where(ok, columns + 1, 0)]
            found = np.where(ok & (a >= 0) & (b >= 0), self._merge(np.maximum(a, 0) * self._n + np.maximum(b, 0)), -1)
            ranks[rows[ok], columns[ok]] = np.where(found[ok] < 0, _LATE, found[ok])

        for c in range(width - 1):
            rank(np.arange(len(sizes)), np.full(len(sizes), c))
        live = np.arange(len(sizes))
        while len(live):
            at = ranks[live].argmin(axis=1)  # of equal ranks the leftmost
            best = ranks[live, at]
            live, at = live[best < _LATE], at[best < _LATE]
            if not len(live):
                break
            onward = np.minimum(place + (place > at[:, None]), width)
            kept = np.take_along_axis(ids[live], onward, 1)
            kept[np.arange(len(live)), at] = self._made[ranks[live, at]]
            ids[live, :width] = kept
            ranks[live] = np.take_along_axis(np.pad(ranks[live], ((0, 0), (0, 1)), constant_values=_LATE), onward, 1)
            rank(live, at - 1)
            rank(live, at)
        return [row[row >= 0] for row in ids]

    def _mended(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """The pieces of words by merging, words of like length together."""
        found: list = [None] * len(sizes)
        order = np.argsort(sizes, kind="stable")
        short = order[: np.searchsorted(sizes[order], 64, "right")]
        for part in np.array_split(short, max(1, len(short) // 4096)) if len(short) else []:
            for i, ids in zip(part.tolist(), self.merged_together(data, starts[part], sizes[part]), strict=True):
                found[i] = ids
        for i in order[len(short) :].tolist():
            found[i] = np.array(self.merged(data[starts[i] : starts[i] + sizes[i]].tolist()), np.int64)
        return found

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one behind another, and where each word's end."""
        raw = [w.encode() for w in words]
        ends = np.cumsum([len(r) for r in raw])
        data = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        data[ends - 1] += 256
        ids, word = self.propose(data, ends)
        same = word[1:] == word[:-1]
        fails = np.zeros(len(words), bool)
        fails[word[1:][same][~self._pairs_hold(ids[:-1][same], ids[1:][same])]] = True
        counts = np.bincount(word, minlength=len(words))
        if not fails.any():
            return ids, np.cumsum(counts)
        which = np.flatnonzero(fails)
        first = np.cumsum(counts) - counts
        parts, at = [], 0
        for w, pieces in zip(which.tolist(), self._mended(data, np.concatenate([[0], ends[:-1]])[which], np.diff(ends, prepend=0)[which]), strict=True):
            parts += [ids[at : first[w]], pieces]
            at = first[w] + counts[w]
            counts[w] = len(pieces)
        return np.concatenate([*parts, ids[at:]]), np.cumsum(counts)

    def _clear(self) -> None:
        """Forgets all words and chunks but the special strings."""
        self._words_known = Remembered()
        self._chunks_known = Remembered()
        self._words_known.add(list(self.special), np.array(list(self.special.values()), np.int64), np.arange(1, len(self.special) + 1))

    def _learn(self, words: list[str]) -> None:
        if new := [w for w in dict.fromkeys(words) if w not in self._words_known.place]:
            self._words_known.add(new, *self.encode_words(new))

    def _chunks(self, chunks: list[bytes]) -> np.ndarray:
        """Where the ids of chunks without white space are. What is known is forgotten when
        it takes over some 60 MB.
        """
        if self._words_known.size + self._chunks_known.size > 60_000_000:
            self._clear()
        if new := [c for c in chunks if c not in self._chunks_known.place]:
            flat, last = self._split_all(new)
            self._learn(flat)
            ids, ends = self._words_known.ids_of(self._words_known.places(flat))
            self._chunks_known.add(new, ids, np.concatenate([[0], ends])[last])
        return self._chunks_known.places(chunks)

    def _split_all(self, chunks: list[bytes]) -> tuple[list[str], np.ndarray]:
        """The words of all chunks one behind another, and where each chunk's end."""
        joined = b"\n".join(chunks).decode(errors="replace")
        if (self._special and self._special.search(joined)) or self._newer(joined):
            words = [self.split(c) for c in joined.split("\n")]
            return [w for ws in words for w in ws], np.cumsum([len(ws) for ws in words])
        found = self._words_and_lines.findall(self._normal(joined))
        lines = np.array([i for i, w in enumerate(found) if w == "\n"], np.int64)
        return [w for w in found if w != "\n"], np.append(lines - np.arange(len(lines)), len(found) - len(lines))

    def _newer(self, text: str) -> bool:
        return not text.isascii() and bool(self._unknown[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any())

    def _normal(self, text: str) -> str:
        """NFC and lower case; a sigma at the end of a word is lower-cased as any other here."""
        return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def split(self, text: str) -> list[str]:
        """The words of a text and the special strings in it."""
        words: list[str] = []
        for i, part in enumerate(self._special.split(text) if self._special else [text]):
            if i % 2:
                words.append(part)
            elif self._newer(part):
                words += self._by_library(part)
            else:
                words += self._words.findall(self._normal(part))
        return words

    def _by_library(self, text: str) -> list[str]:
        """Words of a text with characters whose kind depends on the version of Unicode."""
        if self._library is None:
            from tokenizers import Regex, Tokenizer, pre_tokenizers

            pattern = self._words.pattern
            self._library = Tokenizer.from_file(self._path).normalizer, pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        normal, split = self._library
        return [w for w, _ in split.pre_tokenize_str(normal.normalize_str(text))]

    def encode(self, text: str, piece: int = 1_000_000) -> np.ndarray:
        """The ids of a text, which is cut before white space into pieces of about so many characters."""
        return np.concatenate([self.encode_rows(strings(pa.array([part])))[0] for part in _cut(text, piece)])

    def encode_rows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one behind another, and where each text's end. No word,
        special string or composed character crosses white space, so equal chunks
        between white space have equal ids, wherever they stand.
        """
        words = Words(texts)
        codes, chunks = words.distinct()
        places = self._chunks(chunks)[codes]  # before ids are looked up, as it may forget
        ids, ends = self._chunks_known.ids_of(places)
        return ids, np.concatenate([[0], ends])[words.first[1:]]


def _cut(text: str, size: int):
    """Pieces that begin at white space: no word, special string or composed character crosses these borders."""
    border = regex.compile(f"[{WHITE}]")
    at = 0
    while len(text) - at > size and (m := border.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


class WordDecoder:
    """The pieces of a vocabulary file, with its special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names = {i: s for s, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self._names = pa.array([names.get(i) for i in range(max(names) + 1)], pa.string())
        self._there = np.array([i in names for i in range(max(names) + 1)])

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of ids that stand one behind another: pieces as the vocabulary spells
        them, joined by one space, as this kind of file has no decoder. An id that it
        doesn't have has no piece.
        """
        there = (ids >= 0) & (ids < len(self._there))
        there[there] = self._there[ids[there]]
        ends = np.concatenate([[0], np.cumsum(there)])[np.concatenate([[0], ends])]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), self._names.take(pa.array(ids[there])))
        return pc.binary_join(lists, " ")


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each path and Python worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """docs with ids array<int>, the tokens of each whole text as the tokenizers library
    gives them for the vocabulary file at path (special strings in a text are tokens).

    A null text counts as empty: no ids. A column named ids is replaced, all others
    pass through; repeated rows are encoded one by one; an empty table gives an empty
    one. Rows go through in blocks of about 2 MB of text, long texts in pieces, and the
    words that a worker remembers are bounded, so memory follows the longest text only.
    One pass, no shuffle.
    """
    docs = docs.drop("ids")

    def run(batches):
        machine = encoder(path)
        for part, texts in blocks(batches, "text"):
            if len(texts) == 1:  # it may be a long one
                ids = machine.encode(texts[0].as_py())
                ends = np.array([len(ids)])
            else:
                ids, ends = machine.encode_rows(texts)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*part.schema.names, "ids"])

    return docs.mapInArrow(run, extended(docs, "ids array<int>"))


def decode_ids(docs: DataFrame, path: str) -> DataFrame:
    """docs with decoded string, the text of ids array<int> as the library's decode gives
    it with special tokens kept; null ids count as none, and ids that the vocabulary
    doesn't have are passed over, as is a null among them.

    A column named decoded is replaced, all others pass through. One pass, no shuffle.
    """
    docs = docs.drop("decoded")

    def run(batches):
        machine = WordDecoder(path)
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            step = max(1, 1_000_000 * batch.num_rows // max(1, len(batch.column(at).flatten())))
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                flat, sizes = part.column(at).flatten().fill_null(-1), pc.list_value_length(part.column(at)).fill_null(0)
                texts = machine.decode(flat.to_numpy(zero_copy_only=False), np.cumsum(sizes.to_numpy(zero_copy_only=False)))
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, "decoded"])

    return docs.mapInArrow(run, extended(docs, "decoded string"))


def op11_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = decode_ids(encode_texts(docs, path).select("doc_id", "ids"), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
