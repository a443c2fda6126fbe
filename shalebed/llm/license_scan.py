"""License scans by template markup compiled to token automata.

A template is a license text or notice in which ``<<optional>> ... <</optional>>``
may be missing and ``<<any a-b>>`` stands for a to b words of any kind (a name,
a year). It is compiled to an automaton over words: each state has the words it
moves on, whether any word moves it, and the states it reaches without a word.
A text is accepted where all mandatory wording stands, word by word, however
long it is. Short phrases are searched as runs of consecutive words.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .arrow_words import SIGN_BYTES, Words, blocks, hash_words
from .common import extended, table
from .license_texts import TEMPLATES

#: Phrases and labels of the base (fixed values).
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Automaton:
    """moves: per state, the word that moves it on (or None for any) and where to;
    jumps: per state, the states reached without a word. The last one accepts.
    """

    def __init__(self, markup: str):
        self.moves: list[tuple[int | None, int] | None] = [None]
        self.jumps: list[list[int]] = [[]]
        #: The first mandatory word and the most words that may stand before it.
        self.first: int | None = None
        self.before = 0
        opened: list[int] = []
        for mark in re.findall(rf"<<[^>]*>>|{_WORD}", markup.lower()):
            here = len(self.moves) - 1
            if mark == "<<optional>>":
                opened.append(here)
                self._new()
                self.jumps[here].append(here + 1)
            elif mark == "<</optional>>":
                if not opened:
                    raise ValueError("an optional part is closed that wasn't opened")
                self._new()
                self.jumps[here].append(here + 1)
                self.jumps[opened.pop()].append(here + 1)
            elif any_words := re.fullmatch(r"<<any (\d+)-(\d+)>>", mark):
                least, most = map(int, any_words.groups())
                self.before += most if self.first is None else 0
                steps = [here]
                for _ in range(most):
                    self.moves[-1] = (None, len(self.moves))
                    steps.append(self._new())
                for at in steps[least:-1]:
                    self.jumps[at].append(steps[-1])
            elif mark.startswith("<<"):
                raise ValueError(f"unknown markup: {mark}")
            else:
                word = int(hash_words([mark])[0])
                if self.first is None:
                    if opened:
                        self.before += 1
                    else:
                        self.first = word
                self.moves[-1] = (word, len(self.moves))
                self._new()
        if opened or self.first is None:
            raise ValueError("a template needs closed optional parts and a mandatory word")
        self.start = frozenset(self._closed({0}))

    def _new(self) -> int:
        self.moves.append(None)
        self.jumps.append([])
        return len(self.moves) - 1

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for to in self.jumps[todo.pop()]:
                if to not in states:
                    states.add(to)
                    todo.append(to)
        return states

    def _after(self, states, word: int) -> set[int]:
        return self._closed({m[1] for s in states if (m := self.moves[s]) and (m[0] is None or m[0] == word)})

    def openings(self) -> set[tuple[int | None, int | None]]:
        """The first two words of all wordings; None for any word or, after one word, for none."""
        found: set[tuple[int | None, int | None]] = set()
        for word in {self.moves[s][0] for s in self.start if self.moves[s]}:
            states = self._after(self.start, -1 if word is None else word)
            found |= {(word, self.moves[s][0] if self.moves[s] else None) for s in states if self.moves[s] or s == len(self.moves) - 1}
        return found

    def longest(self, words: np.ndarray, start: int) -> int:
        """Where the longest accepted wording from start ends, or -1. It reads on
        only while a state is left, so never further than the longest wording.
        """
        states, end, last = self.start, -1, len(self.moves) - 1
        for at in range(start, len(words) + 1):
            if last in states:
                end = at
            if at == len(words):
                break
            states = self._after(states, int(words[at]))
            if not states:
                break
        return end


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: dict[str, list[str]]):
        self.phrases = [(hash_words(re.findall(_WORD, p.lower())), label) for p, label in phrases.items()]
        # A wording is tried where its first two words stand; one that may open with any words, around its first mandatory one.
        self.pairs: dict[tuple[int, int], list[tuple[Automaton, str]]] = {}
        self.singles: dict[int, list[tuple[Automaton, str]]] = {}
        for label, own in templates.items():
            for automaton in map(Automaton, own):
                openings = automaton.openings()
                if any(one is None for one, _ in openings):
                    self.singles.setdefault(automaton.first, []).append((automaton, label))
                    continue
                for one, two in openings:
                    (self.singles if two is None else self.pairs).setdefault(one if two is None else (one, two), []).append((automaton, label))
        self.single_words = np.array(sorted(self.singles), np.uint64)
        self.first_words = np.array(sorted({one for one, _ in self.pairs}), np.uint64)

    def scan(self, words: Words):
        """For each row: places of phrases [(start, end, label)] and of templates."""
        hashes, rows = words.hashes(), words.rows()
        base: dict[int, list[tuple[int, int, str]]] = {}
        tried: dict[tuple[int, int], tuple[str, dict[int, int]]] = {}
        for phrase, label in self.phrases:
            k = len(phrase)
            if len(hashes) < k:
                continue
            hit = rows[: len(rows) - k + 1] == rows[k - 1 :]
            for i, word in enumerate(phrase):
                hit &= hashes[i : len(hashes) - k + 1 + i] == word
            for at in np.flatnonzero(hit).tolist():
                row = int(rows[at])
                start = at - int(words.first[row])
                base.setdefault(row, []).append((start, start + k, label))
        found = [(at, self.singles[int(hashes[at])]) for at in np.flatnonzero(np.isin(hashes, self.single_words)).tolist()]
        for at in np.flatnonzero(np.isin(hashes[:-1], self.first_words)).tolist():
            if automata := self.pairs.get((int(hashes[at]), int(hashes[at + 1]))):
                found.append((at, automata))
        for at, automata in found:
            row = int(rows[at])
            own, end = int(words.first[row]), int(words.first[row + 1])
            text = hashes[own:end]
            for automaton, label in automata:
                # All openings of which this may be the first mandatory word.
                lead = automaton.before if int(hashes[at]) == automaton.first else 0
                ends = tried.setdefault((row, id(automaton)), (label, {}))[1]
                for start in range(max(0, at - own - lead), at - own + 1):
                    if start not in ends:
                        ends[start] = automaton.longest(text, start)
        more: dict[int, list[tuple[int, int, str]]] = {}
        for (row, _), (label, ends) in tried.items():
            most = -1
            for start, to in sorted(ends.items()):
                if to > max(most, start):  # not within a place before
                    more.setdefault(row, []).append((start, to, label))
                    most = to
        return base, more


def _covered(places: list[tuple[int, int, str]]) -> int:
    """The words under sorted places."""
    total = end = 0
    for a, b, _ in places:
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels,
    score and matches (start, length in words, and label of each place).

    Words are digits, a-z and non-ASCII characters after A-Z are lower-cased.
    Base: places of phrases. labels has those of templates too. A place of a
    template has optional and replaceable words that lead in and ends with its
    longest wording; one within another of the same template isn't told. score:
    the share of the words that stand in some place. A null or empty text has no words, no
    places, null first_word and last_word, empty labels and score 0. Repeated
    rows are scanned one by one; columns of the new names are replaced. One pass,
    no shuffle.
    """
    new = {
        "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(),
        "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(),
        "matches": pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("label", pa.string())])),
    }
    docs = docs.drop(*new)

    def run(batches):
        scanner = Scanner(phrases, templates)
        for part, texts in blocks(batches, "text"):
            words = Words(texts, SIGN_BYTES, fold=True)
            base, more = scanner.scan(words)
            out = []
            for row, n in enumerate(words.counts.tolist()):
                own, other = base.get(row, []), more.get(row, ())
                starts = [p[0] for p in own]
                places = sorted({*own, *other})
                covered = _covered(places)
                out.append(
                    (
                        n, len(own), min(starts, default=None), max(starts, default=None),
                        ",".join(sorted({p[2] for p in own})), ",".join(sorted({p[2] for p in places})),
                        covered / n if n else 0.0, [{"start": a, "length": b - a, "label": x} for a, b, x in places],
                    )
                )
            columns = [pa.array(c, kind) for c, kind in zip(zip(*out), new.values())]
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *new])

    return docs.mapInArrow(
        run,
        extended(
            docs,
            "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
            "matches array<struct<start: long, length: long, label: string>>",
        ),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
