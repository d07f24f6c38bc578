"""Licence scan: a generalised suffix automaton of licence words, matching statistics, chained matches.

The automaton holds every run of words of every template. A text is streamed through it word by word,
which gives for each word the longest run ending there that some template has. Runs that cannot be
extended are matches; matches of enough words are chained, in the order of both text and template, into
spans, and a template covered enough by a span labels the text. Phrases are templates of their own: one
ends at a word if it is a suffix of the run there, which the suffix links tell.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.common import arrow_map, batch_of, raw_texts
from parcelwise.llm.license_texts import PHRASES, TEMPLATES

#: Words of a match, at least; share of a template's words that a span covers, at least; and words of
#: the text between two matches of a span, at most.
LEAST = 3
SHARE = 0.8
GAP = 20
#: Templates are shipped to every task, so their words together are bounded.
MOST_WORDS = 1 << 18

#: A-Z to a-z; ASCII other than letters and digits to blanks.
KEPT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(KEPT).split()


class Span(NamedTuple):
    label: str
    first_word: int
    last_word: int
    covered: int
    share: float


class Found(NamedTuple):
    n_words: int
    places: list[int]
    base_labels: set[str]
    spans: list[Span]


class Automaton:
    """Generalised suffix automaton over numbered words."""

    def __init__(self, texts: Sequence[Sequence[int]], least: int):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for text in texts:
            last = 0
            for word in text:
                last = self._extend(last, word)
        #: Where the runs of a state end: (text, position behind the last word), for states of enough words.
        self.ends: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for number, text in enumerate(texts):
            state = 0
            for place, word in enumerate(text, 1):
                state = self.next[state][word]
                self.ends[state].append((number, place))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.length[self.link[state]] >= least:
                self.ends[self.link[state]] += self.ends[state]

    def _state(self, length: int, after: dict[int, int], link: int) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _target(self, state: int, word: int) -> int:
        """The state behind ``word`` that ends with ``state``'s longest run and the word, split off if need be."""
        old = self.next[state][word]
        if self.length[old] == self.length[state] + 1:
            return old
        new = self._state(self.length[state] + 1, dict(self.next[old]), self.link[old])
        self.link[old] = new
        while state >= 0 and self.next[state].get(word) == old:
            self.next[state][word] = new
            state = self.link[state]
        return new

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._target(last, word)
        new = self._state(self.length[last] + 1, {}, 0)
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._target(state, word)
        return new

    def statistics(self, words: Sequence[int]) -> Iterator[tuple[int, int]]:
        """For each word, the state and the length of the longest run of some text that ends there."""
        after, link, length = self.next, self.link, self.length
        state = size = 0
        for word in words:
            while state and word not in after[state]:
                state = link[state]
                size = length[state]
            if word in after[state]:
                state = after[state][word]
                size += 1
            yield state, size


def chain(matches: Sequence[tuple[int, int, int]], size: int, gap: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, covered) of the best chain in each stretch of matches (start, place, words).

    Matches come by start. A stretch ends where more than ``gap`` words follow without a match. A chain
    goes forward in text and template without overlap; equal ones begin and end as early as they can.
    ``size`` is the template's number of words.
    """
    begin = 0
    while begin < len(matches):
        reach, end = matches[begin][0], begin
        while end < len(matches) and matches[end][0] - reach <= gap:
            reach = max(reach, matches[end][0] + matches[end][2])
            end += 1
        top = [(0, 0)] * (size + 1)  # a Fenwick tree of the best (covered, -first) by place in the template
        waiting: list[tuple[int, int, tuple[int, int]]] = []
        best = (0, 0, 0)
        for start, place, words in matches[begin:end]:
            while waiting and waiting[0][0] <= start:
                _, at, value = heapq.heappop(waiting)
                while at <= size:
                    top[at] = max(top[at], value)
                    at += at & -at
            covered, first, at = 0, -start, place
            while at > 0:
                if top[at][0] and top[at] > (covered, first):
                    covered, first = top[at]
                at -= at & -at
            heapq.heappush(waiting, (start + words, place + words, (covered + words, first)))
            best = max(best, (covered + words, first, -(start + words - 1)))
        yield -best[1], -best[2], best[0]
        begin = end


class Scanner:
    def __init__(self, templates: Sequence[tuple[str, str]], phrases: Mapping[str, str], least: int, share: float, gap: int):
        texts = [words_of(text.encode()) for _, text in templates]
        sought = [words_of(phrase.encode()) for phrase in phrases]
        if sum(map(len, texts)) + sum(map(len, sought)) > MOST_WORDS:
            raise ValueError(f"templates hold more than {MOST_WORDS} words")
        if not all(sought):
            raise ValueError("a phrase has no words")
        self.numbers = {w: i for i, w in enumerate(sorted({w for t in texts + sought for w in t}), 1)}
        numbered = [[self.numbers[w] for w in t] for t in texts + sought]
        self.labels = [label for label, _ in templates]
        self.sizes = [len(t) for t in texts]
        self.share, self.gap, self.least = share, gap, least
        self.automaton = Automaton(numbered, least)
        #: Words that a run needs to matter, and the pairs of neighbouring words that templates have.
        self.shortest = min([least, *map(len, sought)])
        self.stride = len(self.numbers) + 1
        self.pairs = np.unique([a * self.stride + b for t in numbered for a, b in zip(t, t[1:])]).astype(np.int64)
        # Phrases by the states that end with them: (words, label)
        own = defaultdict(list)
        for text, label in zip(numbered[len(texts) :], phrases.values()):
            state = 0
            for word in text:
                state = self.automaton.next[state][word]
            own[state].append((len(text), label))
        self.phrases: list[list[tuple[int, str]]] = [[] for _ in self.automaton.next]
        for state in sorted(range(1, len(self.phrases)), key=lambda s: self.automaton.length[s]):
            self.phrases[state] = own[state] + self.phrases[self.automaton.link[state]]

    def runs(self, numbers: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches (start, end) of the text outside of which no run of ``shortest`` words can lie."""
        if self.shortest < 2 or len(numbers) < 2:
            yield 0, len(numbers)
            return
        joined = np.isin(numbers[:-1] * self.stride + numbers[1:], self.pairs)
        edges = np.flatnonzero(np.diff(joined.astype(np.int8), prepend=0, append=0))
        for start, end in edges.reshape(-1, 2):
            if end - start + 1 >= self.shortest:
                yield int(start), int(end) + 1

    def scan(self, raw: bytes) -> Found:
        words = words_of(raw)
        get = self.numbers.get
        numbers = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        places, base = [], set()
        matches: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for start, end in self.runs(numbers):
            held = (0, 0)
            for at, (state, size) in enumerate(self.automaton.statistics(numbers[start:end].tolist()), start):
                for count, label in self.phrases[state]:
                    if count <= size:
                        places.append(at - count + 1)
                        base.add(label)
                if size <= held[1]:
                    self._keep(matches, at, *held)
                held = state, size
            self._keep(matches, end, *held)
        spans = []
        for text, found in matches.items():
            for first, last, covered in chain(sorted(found), self.sizes[text], self.gap):
                spans.append(Span(self.labels[text], first, last, covered, covered / self.sizes[text]))
        return Found(len(words), places, base, sorted(spans, key=lambda s: (s.first_word, s.last_word, s.label, s.covered, s.share)))

    def _keep(self, matches: dict, end: int, state: int, size: int) -> None:
        """Note a match of ``size`` words that ends before word ``end``, at each of its places in templates."""
        if size >= self.least:
            for text, place in self.automaton.ends[state]:
                if text < len(self.sizes):
                    matches[text].append((end - size, place - size, size))


def scanned(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = tuple(TEMPLATES),
    phrases: Mapping[str, str] = PHRASES,
    least: int = LEAST,
    share: float = SHARE,
    gap: int = GAP,
) -> DataFrame:
    """Phrase places, licence spans and labels of every row of ``docs``.

    ``n_base`` counts the places of phrases, ``first_word`` and ``last_word`` are the smallest and largest
    start (NULL without any), ``base_labels`` the labels of phrases. ``spans`` are the stretches that cover
    at least ``share`` of a template; their labels and the base ones make up ``labels``. ``score`` is the
    largest share of a template that a span covers, and 1 where a phrase, which is a template too, occurs.
    NULL and empty texts have no words, no labels and score 0. Texts of any length are scanned whole. NULL
    and repeated doc_ids come back as they are, an empty table gives an empty result. Other columns are not
    read. ``templates`` may hold about 260,000 words, since every task gets the automaton.
    """
    scanner = Scanner(templates, phrases, least, share, gap)
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())])
    schema = pa.schema([
        ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("spans", pa.list_(span)), ("score", pa.float64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in raw_texts(batch.column(1)):
                found = scanner.scan(raw)
                covering = [s for s in found.spans if s.share >= scanner.share]
                score = 1.0 if found.places else max((s.share for s in found.spans), default=0.0)
                rows.append((
                    found.n_words, len(found.places), min(found.places, default=None), max(found.places, default=None),
                    sorted(found.base_labels), sorted(found.base_labels | {s.label for s in covering}),
                    [s._asdict() for s in covering], score,
                ))
            columns = list(zip(*rows)) or [()] * len(schema)
            yield batch_of(
                schema.insert(0, pa.field("doc_id", batch.column(0).type)),
                doc_id=batch.column(0), **{f.name: list(c) for f, c in zip(schema, columns)},
            )

    return arrow_map(
        docs.select("doc_id", F.col("text")), run,
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, "
        "spans array<struct<label string, first_word long, last_word long, covered long, share double>>, score double",
    )
