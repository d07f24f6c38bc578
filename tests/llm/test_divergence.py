"""The source audit against plain counting, with ordinary and with colliding digests."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelwise.llm import source_divergence as sd


def slow_audit(rows, least=3, top=200):
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = [(lang, source, re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text.translate(lower))) for text, lang, source in rows]
    out = []
    for lang in {r[0] for r in split}:
        mine = [(s, w) for g, s, w in split if g == lang]
        docs = Counter(t for _, w in mine for t in set(w))
        kept = [t for t, n in docs.items() if n >= least]
        counts = {s: Counter() for s, _ in mine}
        whole = Counter()
        for s, w in mine:
            counts[s].update(t for t in w if docs[t] >= least)
            whole.update(t for t in w if docs[t] >= least)

        def shares(c):
            total = sum(c.values()) + len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 1) // total for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        f = lambda x, y: (x - y) ** 2 // y
        for s in counts:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in counts if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(found[:most])]
    return sorted(out)


def corpus(n, sources=6, seed=3):
    draw = np.random.default_rng(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "É", "ru", "ß") for b in ("n", "sh", "rt", "日本", "nd", "x")] + ["The", "the", "I", "It's"]
    weight = 1 / np.arange(1, len(words) + 1)
    rows = []
    for i in range(n):
        own = np.roll(weight, i % sources)
        text = " ".join(draw.choice(words, size=draw.integers(0, 30), p=own / own.sum()))
        rows.append((text + "-7" * (i % 2), "en" if i % 3 else "de", "hot" if i % 2 else f"s{i % sources}"))
    return rows


ODD = [(None, None, None), ("", "", ""), ("alone", "xx", "only"), ("a a a b", "yy", "p"), ("a c", "yy", "r"), ("a \x00 [a]", "yy", None),
       ("zz", "ww", "p"), ("zz", "ww", "q"), ("zz", None, "q"), ("zz ZZ", None, "q"), ("zz zz", None, "q")]


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"term": F.lit("t"), "n": F.lit(1), "digest": F.lit(2)})
    return sorted(tuple(r) for r in sd.audited(docs.repartition(5), **options).select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("digest", [F.xxhash64, lambda c: F.pmod(F.xxhash64(c), F.lit(5))])
def test_equals_plain_counting(spark, digest):
    rows = corpus(150) + ODD + corpus(12)
    assert run(spark, rows, digest=digest) == slow_audit(rows)


def test_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(sd, "HELD", 10)
    rows = corpus(120, sources=9) + ODD
    assert run(spark, rows, top=3, block_rows=7, block_pairs=12) == slow_audit(rows, top=3)


def test_small_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, None, None)]) == []
    rows = [("long " * 50_000 + "q" * 100_000, "en", "a")] * 3 + [("long", "en", "b")]
    assert run(spark, rows) == slow_audit(rows)


def test_counts_shuffle_digests_only(spark):
    docs = spark.createDataFrame(corpus(20), "text string, lang string, source string")
    found = sd.occurrences(docs).withColumn("term", F.col("term").cast("string")).withColumn("digest", F.xxhash64("term"))
    plan = sd.kept_counts(found.select("lang", "source", "digest", "n", "docs").repartition("lang", "digest"), ["digest"], 3)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1
