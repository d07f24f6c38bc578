"""Benchmark decontamination by the q-gram lemma in diagonal bands.

A benchmark item is cut into passages of ``length`` characters that overlap by half. If a passage
of length m occurs in a text with at most e edits, the two share at least m - q + 1 - q * e of the
passage's q-grams, on diagonals (text position less passage position) that lie within e of one
another. The scan looks up every q-gram of a text in a sorted array of the passages' q-grams, counts
the distinct shared ones in bands of e + 1 diagonals, keeps neighbouring bands that reach the bound
together, and verifies them by a bit-parallel alignment of all candidates of a text at once.

A passage too short for the bound takes the longest q at which it still asks for one q-gram, which is
m / (e + 1); without edits that is the whole passage. So items of any length are looked for.

Texts and items are compared lower-cased, with runs of white space as one space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.common import arrow_map, batch_of, kept_rows, slices

Q = 8
LENGTH = 60
EDIT_SHARE = 0.1
#: Characters of benchmark text that one scan holds; longer benchmarks are scanned in blocks.
BLOCK = 4_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)
FILTER_BITS = 22
PIECE = 1 << 20
#: Shared q-grams that are held at once, and candidates that are aligned at once.
HELD = 1 << 21
ALIGNED = 1 << 11
WORD_BITS = 64
#: Codes of no character, beyond the end of a passage and of a text.
NO_PASSAGE, NO_TEXT = 0xFFFFFFFF, 0xFFFFFFFE


def normal(text: str | None) -> str:
    return " ".join((text or "").split()).lower()


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def hashes(values: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of the q-gram that starts at each character."""
    n = len(values) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    result = values * MIX
    width = 1
    while width < q:
        step = min(width, q - width)  # two stretches that overlap where q is no power of two
        result = (result[:-step] ^ (result[:-step] >> np.uint64(29))) * MIX + result[step:]
        width += step
    result *= MIX
    return result ^ (result >> np.uint64(32))


@dataclass
class Grams:
    """The q-grams of the passages that share a q, in ascending order of hash."""

    q: int
    span: int  # text positions over which the q-grams of one region spread
    grams: np.ndarray
    passage: np.ndarray
    place: np.ndarray
    bits: np.ndarray


@dataclass
class Index:
    """The passages of a block of items, and their q-grams."""

    items: list[int]
    passages: list[tuple[int, str, int]]  # place in ``items``, text, edits allowed
    sizes: np.ndarray
    edits: np.ndarray
    codes: np.ndarray  # a row a passage, for those that fit a machine word
    groups: list[Grams]

    @staticmethod
    def of(rows: list[tuple[int, str]], q: int, length: int, share: float) -> Index:
        items, passages = [], []
        parts: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        spans: dict[int, int] = {}
        for item, text in rows:
            text = normal(text)
            if not text:
                continue
            items.append(item)
            last = max(0, len(text) - length)
            for start in sorted({*range(0, last + 1, max(1, length // 2)), last}):
                part = text[start : start + length]
                edits = int(len(part) * share)
                own = max(1, min(q, len(part) // (edits + 1)))
                h = hashes(codes(part), own)
                parts.setdefault(own, []).append((h, np.full(len(h), len(passages)), np.arange(len(h))))
                spans[own] = max(spans.get(own, 0), len(part) + 2 * (edits + 1))
                passages.append((len(items) - 1, part, edits))
        groups = []
        for own, found in sorted(parts.items()):
            grams, passage, place = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(grams, kind="stable")
            bits = np.zeros(1 << FILTER_BITS, bool)
            bits[grams >> np.uint64(64 - FILTER_BITS)] = True
            groups.append(Grams(own, spans[own], grams[order], passage[order], place[order], bits))
        matrix = np.full((len(passages), WORD_BITS), NO_PASSAGE, np.uint32)
        for number, (_, part, _) in enumerate(passages):
            if len(part) <= WORD_BITS:
                matrix[number, : len(part)] = codes(part)
        sizes, edits = (np.array(x, np.int64) for x in ([len(p) for _, p, _ in passages], [e for _, _, e in passages]))
        return Index(items, passages, sizes, edits, matrix, groups)


def distance(a: str, b: str, edits: int) -> int:
    """Fewest edits that turn ``a`` into some stretch of ``b``, computed to ``edits`` + 1.

    ``b`` is a window whose length exceeds that of ``a`` by the band's width, so row i needs the
    columns i .. i + width only.
    """
    width = max(0, len(b) - len(a)) + edits
    big = edits + 1
    previous = {j: 0 for j in range(0, min(len(b), width) + 1)}
    for i, x in enumerate(a, 1):
        now = {}
        for j in range(max(0, i - edits), min(len(b), i + width) + 1):
            best = previous.get(j, big) + 1
            if j:
                best = min(best, previous.get(j - 1, big) + (x != b[j - 1]), now.get(j - 1, big) + 1)
            now[j] = min(best, big)
        if min(now.values(), default=big) > edits:
            return big
        previous = now
    return min(previous.values(), default=big)


def candidates(values: np.ndarray, index: Index, group: Grams) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(passages, first diagonals of their bands, about where a shared q-gram is) that share as many q-grams as the lemma asks for."""
    q = group.q
    positions_, lefts_, founds_ = [], [], []
    for first in range(0, len(values), PIECE):
        own = hashes(values[first : first + PIECE + q - 1], q)
        near = np.flatnonzero(group.bits[own >> np.uint64(64 - FILTER_BITS)])
        own = own[near]
        left = np.searchsorted(group.grams, own, "left")
        found = np.searchsorted(group.grams, own, "right") - left
        some = found > 0
        positions_.append(near[some] + first)
        lefts_.append(left[some])
        founds_.append(found[some])
    if not positions_:
        return
    at, left, found = (np.concatenate(x) for x in (positions_, lefts_, founds_))
    running = np.cumsum(found)
    begin = 0
    while begin < len(at):
        # a stretch of the text; the next one starts early enough to hold any region this one cuts
        end = int(np.searchsorted(running, running[begin] + HELD))
        end = min(len(at), max(end, int(np.searchsorted(at, at[begin] + 2 * group.span))))
        yield from crowded(at[begin:end], left[begin:end], found[begin:end], index, group)
        if end == len(at):
            return
        begin = int(np.searchsorted(at, at[end] - group.span))


def crowded(at: np.ndarray, left: np.ndarray, found: np.ndarray, index: Index, group: Grams) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    entry = np.repeat(left - (np.cumsum(found) - found), found) + np.arange(found.sum())
    passage, place = group.passage[entry], group.place[entry]
    step = index.edits[passage] + 1
    offset = int(group.span)  # keeps the numbers of bands above zero
    band = (np.repeat(at, found) - place) // step + offset
    bands = int(band.max()) + 2  # one more than there are: no band is next to one of another passage
    places = int(place.max()) + 1
    cells = (passage * bands + band) * places + place
    cells.sort()
    held = cells[np.diff(cells, prepend=-1) != 0]
    cells = held // places
    starts = np.flatnonzero(np.diff(cells, prepend=-1))
    shared = np.diff(starts, append=len(cells))
    # a place and its diagonal give a position, which names the text
    first = held[starts] % places
    cells = cells[starts]
    together = shared.copy()
    beside = np.flatnonzero(cells[1:] == cells[:-1] + 1)
    together[beside] += shared[beside + 1]
    number = cells // bands
    needed = index.sizes[number] - group.q + 1 - group.q * index.edits[number]
    keep = together >= needed
    number = number[keep]
    if len(number):
        diagonal = (cells[keep] % bands - offset) * (index.edits[number] + 1)
        yield number, diagonal, diagonal + first[keep]


def least_edits(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, number: np.ndarray, index: Index) -> np.ndarray:
    """``distance`` of each passage to its window of the text: Myers' bit vectors, all windows in step."""
    sizes = index.sizes[number]
    width = int((ends - starts).max())
    at = starts[:, None] + np.arange(width)
    window = np.where(at < ends[:, None], values[np.minimum(at, len(values) - 1)], np.uint32(NO_TEXT))
    pattern = index.codes[number]
    high = np.uint64(1) << (sizes - 1).astype(np.uint64)
    up, down = np.full(len(number), ~np.uint64(0)), np.zeros(len(number), np.uint64)
    score = sizes.copy()
    best = score.copy()
    one = np.uint64(1)
    for j in range(width):
        equal = np.packbits(pattern == window[:, j : j + 1], axis=1, bitorder="little").view(np.uint64).ravel()
        vertical = equal | down
        level = (((equal & up) + up) ^ up) | equal
        rise = down | ~(level | up)
        fall = up & level
        score += (rise & high) != 0
        score -= (fall & high) != 0
        np.minimum(best, score, out=best)
        rise <<= one
        fall <<= one
        up = fall | ~(vertical | rise)
        down = rise & vertical
    return best


def hits(texts: list[str], index: Index) -> Iterator[tuple[int, int, int, int]]:
    """(text, passage, start in the text, edits) of the regions of normal texts that hold a passage."""
    # the texts lie so far apart that the q-grams of no region are in two of them
    gap = np.full(2 * max((g.span for g in index.groups), default=0), NO_TEXT, np.uint32)
    values = np.concatenate([gap, *(x for text in texts for x in (codes(text), gap))])
    lengths = np.array([len(text) for text in texts], np.int64)
    begins = len(gap) + np.cumsum(lengths + len(gap)) - lengths - len(gap)
    for group in index.groups:
        for number, diagonal, near in candidates(values, index, group):
            # a position is a diagonal of the band and a place, so ``near`` is less than a span early
            text = np.searchsorted(begins, near + group.span, "right") - 1
            edits = index.edits[number]
            starts = np.maximum(begins[text], diagonal - edits)
            ends = np.minimum(begins[text] + lengths[text], diagonal + 2 * (edits + 1) + index.sizes[number] + edits)
            for first in range(0, len(number), ALIGNED):
                part = slice(first, first + ALIGNED)
                if index.sizes[number[part]].max() <= WORD_BITS:
                    used = least_edits(values, starts[part], ends[part], number[part], index)
                else:
                    used = np.array([
                        distance(index.passages[n][1], texts[t][a - begins[t] : b - begins[t]], index.passages[n][2])
                        for n, t, a, b in zip(number[part], text[part], starts[part], ends[part])
                    ])
                for i in np.flatnonzero(used <= edits[part]) + first:
                    yield int(text[i]), int(number[i]), int(starts[i] - begins[text[i]]), int(used[i - first])


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, length: int = LENGTH, share: float = EDIT_SHARE, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, start, edits and n_passages of every document and item that share a passage.

    ``start`` is where in the normalised text the first region begins, ``edits`` the fewest of any
    passage. Items shorter than ``length`` are one passage, however short; NULL or empty ones match
    nothing, and neither do NULL and empty texts. ``share`` of a passage's characters may be edited. Rows with a NULL id are compared too. Repeated
    rows of either table come back once for each row of ``docs``. Other columns are not read.
    """
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text")).where("text is not null").distinct()
    ddl = "doc_id long, item_id long, start long, edits int, n_passages int"
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("edits", pa.int32()), ("n_passages", pa.int32())])
    result = None
    for rows in blocks(items, block):
        shared = docs.sparkSession.sparkContext.broadcast(vars(Index.of(rows, q, length, share)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(**shared.value)
            for batch in slices(batches, 1):
                ids = batch.column(0).to_pylist()
                best: dict[tuple[int, int], list] = {}
                for row, number, start, used in hits([normal(t) for t in batch.column(1).to_pylist()], index):
                    item = index.items[index.passages[number][0]]
                    entry = best.setdefault((row, item), [start, used, set()])
                    entry[0], entry[1] = min(entry[0], start), min(entry[1], used)
                    entry[2].add(number)
                out = [(ids[row], item, s, e, len(n)) for (row, item), (s, e, n) in best.items()]
                if out:
                    columns = list(zip(*out))
                    yield batch_of(schema, **{f.name: columns[i] for i, f in enumerate(schema)})

        found = arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, ddl)
        result = found if result is None else result.unionByName(found)
    return docs.sparkSession.createDataFrame([], ddl) if result is None else result


def blocks(items: DataFrame, most: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``most`` characters, each brought to the driver on its own."""
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-total // most)
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        yield sorted((tuple(r) for r in own.collect()), key=repr)


def keep_clean(
    docs: DataFrame, benchmark: DataFrame, q: int = Q, length: int = LENGTH, share: float = EDIT_SHARE, block: int = BLOCK
) -> DataFrame:
    """``docs`` without the rows whose own text holds a benchmark passage."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text")).where("text is not null").distinct()
    for rows in blocks(items, block):
        shared = docs.sparkSession.sparkContext.broadcast(vars(Index.of(rows, q, length, share)))

        def clean(texts: pa.Array, shared=shared) -> np.ndarray:
            kept = np.ones(len(texts), bool)
            for row, *_ in hits([normal(t) for t in texts.to_pylist()], Index(**shared.value)):
                kept[row] = False
            return kept

        docs = kept_rows(docs, "text", clean)
    return docs
