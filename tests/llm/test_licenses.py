"""The licence scan against plain search, its automaton against all substrings, chains against all chains."""

from __future__ import annotations

import itertools
import re

import numpy as np
import pytest

from parcelwise.llm import license_scan as ls
from parcelwise.llm.license_texts import PHRASES, TEMPLATES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def slow_base(text):
    words = slow_words(text)
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), sorted(labels)


def scan(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as n_words", "'x' as labels")
    return {r.doc_id: r for r in ls.scanned(docs.repartition(3)).collect()}


def noisy(seed, pieces):
    draw = np.random.default_rng(seed)
    filler = ["the", "license", "mit", "general", "public", "gnu", "apache", "software", "é", "x1"]
    out = []
    for piece in pieces:
        out += list(draw.choice(filler, size=draw.integers(0, 25))) + [piece]
    return " ".join(out)


def test_base_equals_plain_search(spark):
    texts = [None, "", "MIT", "the MIT  License.", "mit-license Mit\nLICENSE mit license", "MIT licenses", "GNU General Public License",
             "general public general public license apache license", "École MIT license é", "mit\x00license"]
    texts += [noisy(s, ["MIT License", "Apache License", "General Public License, version 3"] * (s % 3)) for s in range(60)]
    got = scan(spark, texts)
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == slow_base(text), text
        assert set(r.base_labels) <= set(r.labels) and r.labels == sorted(set(r.labels)) and 0 <= r.score <= 1


def test_spans_cover_templates(spark):
    words = [slow_words(t) for _, t in TEMPLATES]
    texts = []
    for w in words:
        texts.append(" ".join(["aaa"] * 7 + w + ["bbb"]))
        texts.append(" ".join(w[: len(w) // 2]))
        texts.append(" ".join(x if i % 25 != 12 else "changed" for i, x in enumerate(w)))
    got = scan(spark, texts)
    for k, ((label, _), w) in enumerate(zip(TEMPLATES, words)):
        whole, half, edited = got[3 * k], got[3 * k + 1], got[3 * k + 2]
        assert label in whole.labels and whole.score == 1.0
        assert (label, 7, 6 + len(w), len(w)) in [(s.label, s.first_word, s.last_word, s.covered) for s in whole.spans]
        if len(w) > 30:
            assert label in edited.labels
            assert label not in half.labels or label in half.base_labels


def test_long_and_repeated_texts(spark):
    text = TEMPLATES[0][1] + " " + "word " * 200_000 + TEMPLATES[2][1] * 300
    docs = spark.createDataFrame([(None, text), (None, text), (1, "x" * 1_000_000)], "doc_id long, text string")
    rows = ls.scanned(docs).collect()
    assert [r.doc_id for r in rows] == [None, None, 1] and rows[0] == rows[1]
    assert {"mit", "apache"} <= set(rows[0].labels) and rows[0].n_base == 300 and rows[2].n_words == 1
    assert ls.scanned(docs.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_statistics_are_longest_runs(seed):
    draw = np.random.default_rng(seed)
    texts = [draw.integers(1, 4, draw.integers(1, 14)).tolist() for _ in range(4)]
    words = draw.integers(0, 4, 60).tolist()
    automaton = ls.Automaton(texts, 1)
    runs = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for at, (state, size) in enumerate(automaton.statistics(words)):
        run = tuple(words[at - size + 1 : at + 1])
        assert size == max((n for n in range(at + 2) if tuple(words[at - n + 1 : at + 1]) in runs), default=0)
        if size:
            ends = {(k, j) for k, t in enumerate(texts) for j in range(size, len(t) + 1) if tuple(t[j - size : j]) == run}
            assert set(automaton.ends[state]) == ends and len(automaton.ends[state]) == len(ends)


@pytest.mark.parametrize("seed", range(8))
def test_chain_is_best(seed):
    draw = np.random.default_rng(seed)
    matches = sorted({(int(draw.integers(0, 30)), int(draw.integers(0, 12)), int(draw.integers(1, 5))) for _ in range(9)})
    best = 0
    for n in range(1, 7):
        for some in itertools.combinations(matches, n):
            if all(a[0] + a[2] <= b[0] and a[1] + a[2] <= b[1] for a, b in zip(some, some[1:])):
                best = max(best, sum(m[2] for m in some))
    assert [c for _, _, c in ls.chain(matches, 20, 1000)] == [best]
    parts = list(ls.chain(matches + [(200, 3, 2)], 20, 50))
    assert len(parts) == 2 and parts[1] == (200, 201, 2)
