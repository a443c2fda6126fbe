"""Token counts from a byte-pair vocabulary compiled to a transducer.

In byte-pair encoding with one rank for each piece, the encoding of a prefix
ends in the one piece t that can follow the encoding of what stands before it:
pieces a, b may stand side by side if and only if a + b alone encodes to [a, b].
So a machine that reads characters needs to remember only the places where a
piece may have begun: a trie node, the piece that ended there, and how many
tokens fewer or more there were. Such a set is a state; a transition carries the
change of the token count. States are finite in number and made when first met.

Text is cut into chunks that advance in step, one array operation for each
character of all chunks. A chunk's map from state to state is known after that
for the state it started from, and for all states that met the same one on the
way, as a word border makes them do. Chunks without such a meeting are run from
every state that is live at their borders, and their maps are composed by
doubling (a parallel prefix scan), so a text without word borders takes no more
steps than the number of live states and the logarithm of its length ask for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .arrow_words import blocks
from .common import extended, table

SPACE = "▁"
_END, _SPACE = 0, 1
_BEGIN, _UNKNOWN = -1, -2
_STATE, _SHIFT, _BIAS = (1 << 24) - 1, 24, 64
#: Runs of spaces longer than this are counted with the period below.
_RUN, _PERIOD = 128, 16


class Vocabulary:
    """Pieces with their ranks, and encodings of short strings by merging."""

    def __init__(self, ranks: dict[str, float]):
        self.ranks = ranks
        self.ids = {p: i for i, p in enumerate(ranks)}
        self.pieces = list(ranks)
        self._pairs: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        odd = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
        return cls({model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not any(f(i) for f in odd)})

    def merge(self, text: str) -> list[str]:
        """Merges the pair of the best rank, the leftmost of equals, until none is left."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank > best):
                    best, at = rank, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def whole(self, piece: int) -> bool:
        if piece not in self._whole:
            self._whole[piece] = len(self.merge(self.pieces[piece])) == 1
        return self._whole[piece]

    def side_by_side(self, a: int, b: int) -> bool:
        if a < 0:
            return self.whole(b)
        known = self._pairs.get((a, b))
        if known is None:
            left, right = self.pieces[a], self.pieces[b]
            known = self._pairs[a, b] = self.merge(left + right) == [left, right]
        return known


class Transducer:
    """Counts tokens. max_entries bounds the table: a full one starts anew with
    the next segment of text.
    """

    def __init__(self, vocabulary: Vocabulary, max_entries: int = 34_000_000):
        self.vocabulary = vocabulary
        self.max_entries = max_entries
        children: list[dict[str, int]] = [{}]
        token = [-1]
        for piece, number in vocabulary.ids.items():
            if SPACE in piece[1:] and piece.strip(SPACE):
                raise ValueError(f"a piece spans words: {piece!r}")
            if len(piece) > 1 and not piece.strip(SPACE):
                continue  # runs of spaces are counted apart
            node = 0
            for c in piece:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    token.append(-1)
                node = children[node][c]
            token[node] = number
        self._children, self._token = children, token
        known = sorted({c for p in vocabulary.ids for c in p} - {SPACE})
        single = [c for c in known if c in vocabulary.ids]
        # Classes: end of text, space, characters of one to four bytes without a piece, each known character.
        self._kind = np.full(0x110000, 2, np.int32)
        self._kind[0x80:], self._kind[0x800:], self._kind[0x10000:] = 3, 4, 5
        self._kind[0xD800] = _END
        self._kind[[0x20, ord(SPACE)]] = _SPACE
        self._kind[[ord(c) for c in single]] = np.arange(6, 6 + len(single))
        self._chars = [""] * 6 + single
        self._space = vocabulary.ids[SPACE]
        self._runs = [len(vocabulary.merge(SPACE * n)) for n in range(_RUN + 2 * _PERIOD + 2)]
        step = [b - a for a, b in zip(self._runs, self._runs[1:])]
        if any(step[i] != step[i + _PERIOD] for i in range(_RUN, _RUN + _PERIOD)):
            raise ValueError("runs of spaces aren't periodic")
        self._restart()

    def _restart(self) -> None:
        self._local = np.full(len(self._chars), -1, np.int64)
        self._kinds: list[int] = []
        self._states: list[tuple] = []
        self._number: dict[tuple, int] = {}
        self._table = np.full((1024, 128), -1, np.int32)
        self._add((0, ((0, _BEGIN, 0),)))

    def _add(self, state: tuple) -> int:
        number = self._number.get(state)
        if number is None:
            number = self._number[state] = len(self._states)
            self._states.append(state)
            if number >= len(self._table):
                self._table = np.concatenate([self._table, np.full_like(self._table, -1)])
        return number

    def _next(self, state: tuple, kind: int) -> tuple[tuple, int]:
        run, items = state
        if kind == _END:
            return self._states[0], 0
        if kind == _SPACE:
            n = run + 1
            change = self._runs[n] - self._runs[n - 1]
            if n >= _RUN + _PERIOD:
                n -= _PERIOD
            return (n, ((self._children[0][SPACE], _BEGIN, -change), (0, self._space, 0))), change
        if kind < 6:
            return (0, ((0, _UNKNOWN, 0),)), kind - 1
        c, going, last = self._chars[kind], [], None
        for node, before, fewer in items:
            child = self._children[node].get(c)
            if child is None:
                continue
            if (t := self._token[child]) >= 0 and self.vocabulary.side_by_side(before, t):
                last = (t, fewer + 1)
            if self._children[child]:
                going.append((child, before, fewer))
        change = last[1]
        return (0, (*((n, b, f - change) for n, b, f in going), (0, last[0], 0))), change

    def _fill(self, entries: np.ndarray) -> None:
        width = self._table.shape[1]
        for entry in entries.tolist():
            state, column = divmod(entry, width)
            following, change = self._next(self._states[state], self._kinds[column])
            number = self._add(following)
            self._table[state, column] = number | (change + _BIAS) << _SHIFT

    def _step(self, states: np.ndarray, columns: np.ndarray) -> np.ndarray:
        at = states * self._table.shape[1] + columns
        found = self._table.ravel()[at]
        if found.min() < 0:
            self._fill(np.unique(at[found < 0]))
            found = self._table.ravel()[at]
        return found

    def _columns(self, kinds: np.ndarray) -> np.ndarray:
        new = np.unique(kinds)
        new = new[self._local[new] < 0]
        if len(new):
            self._local[new] = np.arange(len(self._kinds), len(self._kinds) + len(new))
            self._kinds += new.tolist()
            while len(self._kinds) > self._table.shape[1]:
                self._table = np.concatenate([self._table, np.full_like(self._table, -1)], axis=1)
        return self._local[kinds]

    def count(self, texts: list[str], chunk: int = 384, segment: int = 4_000_000) -> np.ndarray:
        """The number of tokens of each text. Texts are read in segments of so
        many characters, a longer one in several.
        """
        mark = "\ud800"  # no text has it
        out: list[int] = []
        state, begun = 0, 0

        def read(parts: list[str]) -> None:
            nonlocal state, begun
            if self._table.size > self.max_entries:
                kept = self._states[state]
                self._restart()
                state = self._add(kept)
            kinds = self._kind[np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")]
            changes, state = self._changes(kinds, state, chunk)
            upto = np.cumsum(changes)
            ends = upto[kinds == _END]
            out.extend(np.diff(np.concatenate([[-begun], ends])).tolist())
            begun = int(upto[-1] - ends[-1]) if len(ends) else begun + int(upto[-1])

        held, size = [], 0
        for text in texts:
            whole = SPACE + text if text else ""
            for at in range(0, max(1, len(whole)), segment):
                held.append(whole[at : at + segment])
                size += len(held[-1])
                if size >= segment:
                    read(held)
                    held, size = [], 0
            held.append(mark)
            size += 1
        if held:
            read(held)
        return np.array(out, np.int64)

    def _changes(self, kinds: np.ndarray, start: int, chunk: int) -> tuple[np.ndarray, int]:
        """The change of the token count with each character, and the state after the last."""
        n, chunk = len(kinds), max(1, min(chunk, len(kinds)))
        lanes = -(-n // chunk)
        columns = np.zeros(lanes * chunk, np.int64)
        padded = np.concatenate([kinds, np.full(lanes * chunk - n, _END, kinds.dtype)])
        columns = np.ascontiguousarray(self._columns(padded).reshape(lanes, chunk).T)
        found = np.empty((chunk, lanes), np.int32)
        assumed = np.zeros(lanes, np.int64)
        assumed[0] = start
        states = assumed.copy()
        for i in range(chunk):
            found[i] = self._step(states, columns[i])
            states = (found[i] & _STATE).astype(np.int64)
        rounds, few = 0, True
        while True:
            ended = (found[-1] & _STATE).astype(np.int64)
            again = np.flatnonzero(assumed[1:] != ended[:-1]) + 1
            if not len(again):
                break
            states = assumed[again] = ended[again - 1]
            for i in range(chunk):
                now = self._step(states, columns[i, again])
                met = (now & _STATE) == (found[i, again] & _STATE)
                found[i, again] = now
                states = (now & _STATE).astype(np.int64)[~met]
                again = again[~met]
                if not len(again):
                    break
            rounds += 1
            if rounds % 2 == 0 and len(again) and few:
                # These met no state of before, and what follows them without a word border may not either.
                bare = ~np.isin(columns[:, again[0] :], self._local[[_END, _SPACE]]).any(0)
                few = self._compose(columns, found, assumed, np.union1d(again, again[0] + np.flatnonzero(bare)))
        return ((found >> _SHIFT) - _BIAS).T.ravel()[:n], int(found[(n - 1) % chunk, -1] & _STATE)

    def _compose(self, columns: np.ndarray, found: np.ndarray, assumed: np.ndarray, lanes: np.ndarray, most: int = 128) -> bool:
        """Runs lanes (chunks whose states may meet none of before) from their true
        states; not if more than most states are live at their borders.
        """
        ended = (found[-1] & _STATE).astype(np.int64)
        live, new = np.zeros(0, np.int64), np.unique(ended[lanes - 1])
        maps = np.zeros((len(lanes), 0), np.int64)
        while len(new):
            if len(live) + len(new) > most or len(lanes) * len(new) > 4_000_000:
                return False
            states, at = np.tile(new, len(lanes)), np.repeat(lanes, len(new))
            for i in range(len(columns)):
                states = (self._step(states, columns[i, at]) & _STATE).astype(np.int64)
            live = np.concatenate([live, new])
            maps = np.concatenate([maps, states.reshape(len(lanes), -1)], axis=1)
            new = np.setdiff1d(states, live)
        order = np.argsort(live)
        maps = order[np.searchsorted(live, maps, sorter=order)]
        # Maps of neighbours are composed by doubling: in the end each has all from the first of its run on.
        begins = np.concatenate([[True], np.diff(lanes) > 1])
        first = np.flatnonzero(begins)[np.cumsum(begins) - 1]
        place, step = np.arange(len(lanes)), 1
        while step < len(lanes):
            own = place[place - step >= first]
            if not len(own):
                break
            maps[own] = np.take_along_axis(maps[own], maps[own - step], axis=1)
            step *= 2
        head = order[np.searchsorted(live, ended[lanes[first] - 1], sorter=order)]
        begun = np.where(begins, head, maps[np.maximum(place - 1, 0), head])
        states = assumed[lanes] = live[begun]
        for i in range(len(columns)):
            found[i, lanes] = self._step(states, columns[i, lanes])
            states = (found[i, lanes] & _STATE).astype(np.int64)
        return True


_compiled: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One for each path and Python worker."""
    if path not in _compiled:
        _compiled[path] = Transducer(Vocabulary.load(path))
    return _compiled[path]


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    model_path: a sentencepiece model, BPE with byte fallback and no
    normalisation. A null text counts as empty: 0 bytes, 0 tokens. Columns of
    the new names are replaced, all others pass through; repeated rows are
    counted one by one. Texts of any length are read in segments, so memory
    doesn't grow with them. One pass, no shuffle.
    """
    docs = docs.drop("n_bytes", "n_tokens", "over_limit")

    def run(batches):
        machine = transducer(model_path)
        for part, texts in blocks(batches, "text"):
            n = machine.count(texts.to_pylist())
            size = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1])
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(size), pa.array(n.astype(np.int64)), pa.array(n > limit)],
                names=[*part.schema.names, "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.mapInArrow(run, extended(docs, "n_bytes long, n_tokens long, over_limit boolean"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).select(
        "doc_id", "n_bytes", "n_tokens", "over_limit"
    )
