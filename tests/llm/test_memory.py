"""What the language model holds in a Python worker, beside the batch that it reads."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from parcelwise.llm import perplexity


def peak_of(run):
    """What ``run`` returns, and the most bytes it held meanwhile."""
    tracemalloc.start()
    try:
        result = run()
        return result, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_counting_holds_little(spark, monkeypatch):
    """12 MB of texts over 16 letters, up to a million 5-grams: all are counted in 160 MB, and handed over in small batches."""
    runs = []
    real = perplexity.arrow_map
    monkeypatch.setattr(perplexity, "arrow_map", lambda df, run, schema: runs.append(run) or real(df, run, schema))
    perplexity.counted(spark.createDataFrame([("a",)], "text string"))
    letters = np.random.default_rng(3).integers(97, 113, (3000, 4000), np.uint8)
    batch = pa.RecordBatch.from_arrays([pa.array([row.tobytes().decode() for row in letters])], names=["text"])

    def run():
        sizes, total = [], 0
        for out in runs[0](iter([batch])):
            sizes.append(out.num_rows)
            total += int(out.column(1).to_numpy().sum())
        return sizes, total

    (sizes, total), peak = peak_of(run)
    assert total == letters.size
    assert max(sizes) <= 1 << 16
    assert peak < 160e6


def test_merged_rows():
    rows = np.random.default_rng(4).integers(-50, 50, (4, 5000))
    rows[0] += 50
    cut = [rows[:, a:b][:, np.argsort(rows[0, a:b], kind="stable")] for a, b in ((0, 1), (1, 3000), (3000, 5000))]
    want = [(g, *(f(rows[i, rows[0] == g]) for i, f in ((1, np.sum), (2, np.min), (3, np.max)))) for g in np.unique(rows[0])]
    assert perplexity.merged(cut).T.tolist() == [list(map(int, x)) for x in want]


def test_lookups_hold_little(monkeypatch):
    """Looking up a million n-grams in parts takes 24 bytes for each, the result of 8 bytes included."""
    monkeypatch.setattr(perplexity, "PIECE", 1 << 16)
    draw = np.random.default_rng(5)
    known = np.unique(draw.integers(0, 1 << 40, 300_000, np.uint64))
    packed = draw.choice(known, 1 << 20)
    packed[::1000] += np.uint64(1)  # a few that order 5 lacks
    whole, parts = [], []
    for k in range(1, 6):
        grams = np.unique(known & np.uint64((1 << (8 * k)) - 1))
        logp, backoff = -draw.random(len(grams)), -draw.random(len(grams))
        arrays = lambda at: perplexity.Arrays.of(grams[at], logp[at], backoff[at])  # noqa: E731, B023
        n = 7 if k == 5 else 1
        whole.append(arrays(slice(None)))
        parts.append(perplexity.Parts([SimpleNamespace(value=arrays(grams % np.uint64(n) == i)) for i in range(n)], whole[0].unseen))
    given = packed.copy()
    found, peak = peak_of(lambda: perplexity.log_probabilities(parts, packed))
    assert np.array_equal(found, perplexity.log_probabilities(whole, packed))
    assert np.array_equal(packed, given)
    assert peak < 24 * len(packed)
