"""Quality classifier: naive Bayes support vectors.

Features are n-gram indicators, hashed: n-grams of one to four bytes, and n-grams of the text's
recurrence pattern (runs of a word repeated at once, and the share of word triples seen before).
Each indicator is scaled by its class log-count ratio, rows are scaled to length one, and a linear
hinge-loss model is fitted by dual coordinate descent. Blocks of the sample are fitted in parallel
and their weights averaged; margins of rows outside the fit turn into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.common import arrow_map, batch_of, bounded_sample, byte_view, id_crc, kept_rows, labelled_sample, slices, stored

BITS = 18
SIZE = 1 << BITS
#: Bound on the labelled rows used; of them, one block of ``BLOCK`` calibrates.
SAMPLE = 16_000
BLOCK = 4_000
#: Bytes of text hashed at once; the hashes of a byte take 16 bytes.
SLICE = 1 << 20
RUNS = (2, 3, 5, 9, 17)
TENTHS = 10
FACTORS = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F))


def positions(values: np.ndarray) -> list[np.ndarray]:
    """Hashed feature of the n-gram that starts at each byte, for n = 1 to 4."""
    packed = np.zeros(len(values), np.uint32)
    hashed = []
    for n, factor in enumerate(FACTORS):
        packed = packed[: len(values) - n] << np.uint32(8)
        packed = packed | values[n:]
        hashed.append((packed * factor + factor) >> np.uint32(32 - BITS))
        if n + 1 >= len(values):
            break
    return hashed


def recurrence(raw: bytes) -> list[int]:
    """Features of repeated words; they take the last places of the table."""
    words = raw.split()
    found = []
    longest = run = 1
    for same in map(bytes.__eq__, words, words[1:]):
        run = run + 1 if same else 1
        if run > longest:
            longest = run
    found += [SIZE - 1 - i for i, r in enumerate(RUNS) if longest >= r]
    if len(words) >= 3:
        share = 1 - len(set(zip(words, words[1:], words[2:]))) / (len(words) - 2)
        found += [SIZE - 1 - len(RUNS) - i for i in range(int(share * TENTHS))]
    return found


def features(values: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Distinct features of each text, ascending."""
    if len(values) == 0:
        yield from (np.zeros(0, np.int64) for _ in offsets[1:])
        return
    hashed, data = positions(values), values.tobytes()
    flags = np.zeros(SIZE, bool)
    for start, end in zip(offsets[:-1], offsets[1:]):
        if start == end:
            yield np.zeros(0, np.int64)
            continue
        for n, h in enumerate(hashed):
            flags[h[start : max(start, end - n)]] = True
        flags[recurrence(data[start:end])] = True
        found = np.flatnonzero(flags)
        flags[found] = False
        yield found


@dataclass
class Model:
    """Weight of each indicator, already times its log-count ratio; squared ratios; calibration."""

    weights: np.ndarray
    squares: np.ndarray
    slope: float
    offset: float

    def margin(self, found: np.ndarray) -> float:
        norm = self.squares[found].sum()
        return float(self.weights[found].sum() / np.sqrt(norm)) if norm > 0 else 0.0

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -30, 30)))


def dual_descent(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, cost: np.ndarray, sweeps: int = 12) -> np.ndarray:
    """Weights of the linear hinge-loss model over unit rows of ratio-scaled indicators."""
    weights = np.zeros(SIZE)
    alpha = np.zeros(len(rows))
    scaled = []
    for found in rows:
        x = ratio[found]
        norm = np.sqrt((x * x).sum())
        scaled.append((x / norm if norm > 0 else x).astype(np.float32))
    order = np.random.default_rng(0)
    for _ in range(sweeps):
        moved = 0.0
        for i in order.permutation(len(rows)):
            found, x, y = rows[i], scaled[i], labels[i]
            step = 1 - y * float(weights[found] @ x)
            now = min(max(alpha[i] + step, 0.0), cost[i])  # rows have length one, so the curvature is one
            if now != alpha[i]:
                weights[found] += (now - alpha[i]) * y * x
                moved = max(moved, abs(now - alpha[i]))
                alpha[i] = now
        if moved < 1e-3:
            break
    return weights


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 30, ridge: float = 1e-3) -> np.ndarray:
    """Newton fit of a small logistic model; ``x`` has a column of ones."""
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (p - y) + ridge * beta
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(beta))
        move = np.linalg.solve(hessian, gradient)
        beta -= np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    return beta


def fit(labelled: DataFrame, label: str, sample: int = SAMPLE, block: int = BLOCK) -> Model | float:
    """Model from rows of (doc_id, text, label 0/1); the share of label 1 where one class is absent.

    At most ``sample`` rows are used, chosen by a hash. One block of them takes no part in the fit: the
    margins of its rows, which the weights have not seen, tell how a margin becomes a score.
    """
    labelled = labelled.where(F.col(label).isin(0, 1)).select("doc_id", "text", F.col(label).cast("int").alias("label"))
    return learnt(bounded_sample(labelled, ["doc_id", "text", "label"], sample), block)


def learnt(rows: DataFrame, block: int = BLOCK) -> Model | float:
    """``fit`` on all of the (doc_id, text, label 0/1) given."""
    rows = rows.withColumn("draw", F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(1 << 20)))
    schema = pa.schema([("draw", pa.int64()), ("label", pa.int32()), ("found", pa.list_(pa.int32()))])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, SLICE):
            found = [f.astype(np.int32) for f in features(*byte_view(batch.column(2)))]
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, found)]).astype(np.int32), np.concatenate(found) if found else np.zeros(0, np.int32))
            yield batch_of(schema, draw=batch.column(0), label=batch.column(1), found=lists)

    taken = stored(arrow_map(rows.select("draw", "label", "text"), extract, "draw long, label int, found array<int>"))
    n, ones = taken.agg(F.count("*"), F.sum("label")).first()
    if not n or ones in (0, n):
        return 0.5 if not n else float(ones / n)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, SIZE), np.int64)
        for batch in batches:
            values, sizes = batch.column(1).flatten().to_numpy(), batch.column(1).value_lengths().to_numpy()
            owner = np.repeat(batch.column(0).to_numpy(), sizes)
            for y in (0, 1):
                counts[y] += np.bincount(values[owner == y], minlength=SIZE)
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0][at]), pa.array(counts[1][at])], names=["f", "n0", "n1"])

    counts = arrow_map(taken.select("label", "found"), tally, "f long, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    totals = np.ones((2, SIZE))  # add-one smoothing
    totals[0][counts.f], totals[1][counts.f] = totals[0][counts.f] + counts.n0, totals[1][counts.f] + counts.n1
    ratio = np.log(totals[1] / totals[1].sum()) - np.log(totals[0] / totals[0].sum())
    shared = taken.sparkSession.sparkContext.broadcast(ratio)
    blocks = max(1, -(-n // block) - 1)
    share = ones / n

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        y = np.where(frame.label.to_numpy() == 1, 1.0, -1.0)
        cost = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
        weights = dual_descent(list(frame.found), y, shared.value, cost)
        at = np.flatnonzero(weights)
        return pd.DataFrame({"f": at, "w": weights[at] * len(frame), "n": len(frame)})

    # of few rows a fifth is held out, and the others are one block
    number = F.col("draw") % (blocks + 1) if n >= 2 * block else F.least(F.col("draw") % 5, F.lit(1))
    placed = taken.withColumn("block", number.cast("int"))
    fitted = placed.where("block > 0")
    if fitted.select("label").distinct().count() < 2:  # a handful of rows, all of a class or held out
        fitted = placed
    parts = fitted.groupBy("block").applyInPandas(solve, "f long, w double, n long")
    weight = parts.groupBy("f").agg(F.sum("w").alias("w")).toPandas()
    used = fitted.count()
    weights = np.zeros(SIZE)
    weights[weight.f] = weight.w / used
    model = Model(weights * ratio, ratio * ratio, 1.0, 0.0)
    margins = arrow_map(placed.where("block = 0").select("label", "found"), _margins(model), "label int, margin double").toPandas()
    if margins.label.nunique() == 2:
        x = np.column_stack([margins.margin, np.ones(len(margins))])
        model.slope, model.offset = logistic(x, margins.label.to_numpy().astype(float), ridge=0.05)
    return model


def _margins(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = [model.margin(f) for f in batch.column(1).to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(margins, pa.float64())], names=["label", "margin"])

    return run


def scores_of(model: Model | float, texts: pa.Array) -> np.ndarray:
    if isinstance(model, float):
        return np.full(len(texts), model)
    return model.scores(np.array([model.margin(f) for f in features(*byte_view(texts))]))


def score(docs: DataFrame, model: Model | float, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted of every row of ``docs``; only the text is looked at.

    Empty and NULL texts have no features and get the score of a zero margin. Repeated rows come back
    repeated.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, SLICE):
            scores = scores_of(shared.value, batch.column(1))
            yield batch_of(schema, doc_id=batch.column(0), score=scores, predicted=(scores >= threshold).astype(np.int32))

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double, predicted int")


def marks_of(labels: DataFrame, label: str, held_out: Column) -> DataFrame:
    """(doc_id, label) of the rows marked 0 or 1 outside ``held_out``; ids with two labels count twice."""
    marks = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out)
    return marks.select("doc_id", F.col(label).cast("int").alias("label"))


def held_out(column: str = "doc_id") -> Column:
    return id_crc(column) % 5 == 0


def classified(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, learnt from the rows that are not held out."""
    model = learnt(labelled_sample(docs, marks_of(labels, "quality", held_out()), sample))
    return score(docs, model, threshold).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the rows predicted 0, each by its own text."""
    shared = docs.sparkSession.sparkContext.broadcast(learnt(labelled_sample(docs, marks_of(labels, "quality", held_out()), sample)))
    return kept_rows(docs, "text", lambda texts: scores_of(shared.value, texts) >= threshold, SLICE)
