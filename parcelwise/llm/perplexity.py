"""N-gram perplexity rules: a modified Kneser-Ney model over all documents, and bands by language.

The units are UTF-8 bytes, so one model serves every script and needs no vocabulary. Spark counts
the 5-grams of every text, and the bands by language decide what is unusual; each text starts with
four zero bytes, so every shorter n-gram is a suffix of a 5-gram, and the continuation counts of the lower orders come from distinct longer n-grams.
Probabilities are interpolated by joins on suffix and context. The finished model is five pairs of
sorted hash arrays (hash, log probability, back-off weight) with an index on the leading hash bits.
No text makes itself look usual: what it alone holds is unseen when it is judged, copies of it included.

Size: no order is cut; the model grows with the corpus. It is dealt by n-gram into parts of about
``slots`` entries, which pass through the driver one at a time. A task scores a slice of texts by
passes over the parts, of which it holds one at a time where an order has several.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import gcd

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.common import arrow_map, batch_of, byte_view, slices, stored

ORDER = 5
SLOTS = 1 << 22
PIECE = 1 << 20
#: Rows of counts that a worker holds before it merges them, and rows it hands to Spark at once.
HELD = 1 << 20
HANDED = 1 << 16
MIX = np.uint64(0x9E3779B97F4A7C15)
INDEX_BITS = 20
#: What a byte costs at the most in ``log_ppl``, in nats; infinity gives the model's own perplexity.
WORST = float("inf")
SYMBOLS = (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")


def grams(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The n-gram that ends at each byte, packed into an integer; bytes before a text are zero."""
    packed = np.zeros(len(values), np.uint64)
    place = np.arange(len(values), dtype=np.int64) - np.repeat(offsets[:-1], np.diff(offsets))
    for back in range(ORDER - 1, -1, -1):
        packed <<= np.uint64(8)
        if back < len(values):
            earlier = values[: len(values) - back].astype(np.uint64)
            packed[back:] |= np.where(place[back:] >= back, earlier, np.uint64(0))
    return packed


def pieces(values: np.ndarray, offsets: np.ndarray, size: int | None = None) -> Iterator[np.ndarray]:
    """``grams`` of a batch in pieces of ``size`` bytes, or ``PIECE``; a piece may start within a text.

    A longer piece is filled ``PIECE`` bytes at a time.
    """
    size = size or PIECE
    for begin in range(0, len(values), size):
        packed = np.empty(min(size, len(values) - begin), np.uint64)
        for at in range(0, len(packed), PIECE):
            start, end = begin + at, begin + min(at + PIECE, len(packed))
            first = max(0, start - ORDER + 1)
            inner = offsets[(offsets > first) & (offsets < end)]
            cut = np.concatenate([[first], inner, [end]]) - first
            # a text that began before ``first`` has all its bytes here but for the first ones of the piece
            packed[at : end - begin] = grams(values[first:end], cut)[start - first :]
        yield packed


def piece_counts(packed: np.ndarray, text: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Rows (gram, n, least name, greatest name) of a piece; ``text`` numbers the text of each byte."""
    order = np.argsort(names, kind="stable")
    rank = np.empty(len(names), np.uint64)
    rank[order] = np.arange(len(names), dtype=np.uint64)
    keys = packed << np.uint64(24) | rank[text]  # an n-gram has 40 bits, a piece less than 2 ** 24 texts
    keys.sort()
    starts = np.flatnonzero(np.diff(keys >> np.uint64(24), prepend=np.uint64(1 << 50)))
    ends = np.append(starts[1:], len(keys)) - 1
    named = names[order]
    ranks = (keys & np.uint64(0xFFFFFF)).astype(np.int64)
    return np.stack([(keys[starts] >> np.uint64(24)).astype(np.int64), ends - starts + 1, named[ranks[starts]], named[ranks[ends]]])


def merged(held: list[np.ndarray]) -> np.ndarray:
    """One row for each n-gram; a column at a time, so that no second copy of all rows is needed."""
    column = lambda i: np.concatenate([rows[i] for rows in held])
    found = column(0)
    order = np.argsort(found, kind="stable")
    found = found[order]
    starts = np.flatnonzero(np.diff(found, prepend=-1))
    result = np.empty((4, len(starts)), np.int64)
    result[0] = found[starts]
    for i, join in enumerate((np.add, np.minimum, np.maximum), 1):
        join.reduceat(column(i)[order], starts, out=result[i])
    return result


def counted(docs: DataFrame) -> DataFrame:
    """(gram, n, lo, hi): how often each 5-gram of bytes occurs in all texts, whatever the rules say of them.

    ``lo`` and ``hi`` are the least and the greatest name (a hash) of the texts that hold it, so they
    are equal if no other text does.
    """
    schema = pa.schema([("gram", pa.int64()), ("n", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])

    def emit(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        for start in range(0, rows.shape[1], HANDED):
            gram, n, lo, hi = rows[:, start : start + HANDED]
            yield batch_of(schema, gram=gram, n=n, lo=lo.astype(np.int32), hi=hi.astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in slices(batches, 0):
            values, offsets = byte_view(batch.column(0))
            data = values.tobytes()
            names = np.array([xxhash.xxh32_intdigest(data[a:b]) - (1 << 31) for a, b in zip(offsets[:-1], offsets[1:])], np.int64)
            at = 0
            for packed in pieces(values, offsets, HELD // 4):
                text = np.searchsorted(offsets, np.arange(at, at + len(packed)), "right") - 1
                at += len(packed)
                first = text[0]
                held.append(piece_counts(packed, text - first, names[first : text[-1] + 1]))
                size += held[-1].shape[1]
                if size > HELD:
                    held = [merged(held)]
                    size = held[0].shape[1]
                    if size > HELD // 2:
                        yield from emit(held[0])
                        held, size = [], 0
        if held:
            yield from emit(merged(held))

    return arrow_map(docs.select("text"), run, "gram long, n long, lo int, hi int").groupBy("gram").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )


def suffix(gram: Column, length: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << (8 * length)) - 1))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from the counts of counts."""
    n1, n2, n3, n4 = (x or 0 for x in counts.agg(*(F.sum((F.col("n") == k).cast("int")) for k in (1, 2, 3, 4))).first())
    if not (n1 and n2 and n3):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.0), k) for k, d in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3), 1))


@dataclass
class Arrays:
    """One order: hashes in ascending order, natural logs of probability and back-off weight."""

    hashes: np.ndarray
    logp: np.ndarray
    backoff: np.ndarray
    index: np.ndarray
    unseen: float = -float(np.log(256))  # of a byte that order 1 lacks

    @staticmethod
    def of(grams_: np.ndarray, logp: np.ndarray, backoff: np.ndarray) -> Arrays:
        hashes = grams_.astype(np.uint64) * MIX  # an odd factor: distinct n-grams keep distinct hashes
        order = np.argsort(hashes)
        hashes = hashes[order]
        bounds = np.searchsorted(hashes, np.arange(1 << INDEX_BITS, dtype=np.uint64) << np.uint64(64 - INDEX_BITS))
        return Arrays(hashes, logp[order].astype(np.float32), backoff[order].astype(np.float32),
                      np.append(bounds, len(hashes)).astype(np.int32))

    def find(self, grams_: np.ndarray) -> np.ndarray:
        """Position of each n-gram, or -1."""
        if not len(self.hashes):
            return np.full(len(grams_), -1, np.int32)
        hashes = grams_ * MIX
        slot = (hashes >> np.uint64(64 - INDEX_BITS)).astype(np.int32)
        at, end = self.index[slot], self.index[slot + 1]
        found = np.where((at < end) & (self.hashes[np.minimum(at, len(self.hashes) - 1)] == hashes), at, -1)
        open_ = np.flatnonzero((found < 0) & (at + 1 < end))
        step = 1
        while len(open_):
            here = at[open_] + step
            hit = self.hashes[here] == hashes[open_]
            found[open_[hit]] = here[hit]
            open_ = open_[~hit & (here + 1 < end[open_])]
            step += 1
        return found

    def take(self, grams_: np.ndarray, what: str) -> np.ndarray:
        """``logp``, the log probability, or NaN; or ``backoff``, the log of the back-off weight, 0 if there is none."""
        lacking = np.float32(np.nan if what == "logp" else 0)
        if not len(self.hashes):
            return np.full(len(grams_), lacking)
        at = self.find(grams_)
        return np.where(at >= 0, getattr(self, what)[at], lacking)


@dataclass
class Parts:
    """One order, dealt into arrays that the executors fetch: the arrays of part i hold the n-grams that leave i over."""

    arrays: list[Broadcast]
    unseen: float

    def take(self, grams_: np.ndarray, what: str) -> np.ndarray:
        """As of ``Arrays``, for ``PIECE`` n-grams at a time: what a lookup needs besides does not grow with their number."""
        parts = len(self.arrays)
        found, part = np.empty(len(grams_), np.float32), np.zeros(len(grams_), np.min_scalar_type(parts))
        blocks = [slice(start, start + PIECE) for start in range(0, len(grams_), PIECE)]
        for block in blocks if parts > 1 else ():
            part[block] = grams_[block] % np.uint64(parts)
        for i, shared in enumerate(self.arrays):
            for block in blocks:
                at = np.flatnonzero(part[block] == i)
                if len(at):
                    found[block][at] = shared.value.take(grams_[block][at], what)
            if parts > 1:
                vars(shared).pop("_value", None)  # one part at a time; it is read again from the executor's copy
        return found


def model(docs: DataFrame, slots: int = SLOTS) -> list[Arrays]:
    """The arrays of orders 1 to 5, in one piece: an order keeps the n-grams with a count of at least
    total / ``slots``, and back-off reaches the others. ``judged`` takes the whole model, in parts."""
    orders = list(estimated(docs, slots))
    arrays = [collected(entries) for entries, _ in orders]
    arrays[0].unseen += orders[0][1]
    return arrays


def whole_model(docs: DataFrame, slots: int = SLOTS) -> list[Parts]:
    """Orders 1 to 5 with all their n-grams, in parts of about ``slots`` entries."""
    context = docs.sparkSession.sparkContext
    orders = []
    for entries, unseen in estimated(docs, None, others=True):
        entries = stored(entries)
        parts = -(-entries.count() // slots) or 1
        while gcd(parts, 2 * 255) > 1:  # 256 leaves 1 over if divided by a factor of 255: bytes would be added up
            parts += 1
        if parts > 1:
            entries = stored(entries.withColumn("part", F.col("gram") % parts).repartition("part").sortWithinPartitions("part"))
        chosen = (entries.where(F.col("part") == i) if parts > 1 else entries for i in range(parts))
        orders.append(Parts([context.broadcast(collected(c)) for c in chosen], -float(np.log(256)) + unseen))
    return orders


def estimated(docs: DataFrame, slots: int | None, others: bool = False) -> Iterator[tuple[DataFrame, float]]:
    """(gram, p, gamma) of the orders 1 to 5, and what the cost of an unseen byte gains from the root.

    With ``others``, an n-gram that a single text holds is counted, but its mass goes to the back-off:
    no other text can ask for it, and that text is judged by what the others teach.
    """
    raw = stored(counted(docs))
    levels = {ORDER: raw}
    for k in range(ORDER - 1, 0, -1):
        # distinct n-grams one longer, counted by their suffix
        levels[k] = stored(levels[k + 1].select(suffix(F.col("gram"), k).alias("gram"), "lo", "hi").groupBy("gram").agg(
            F.count("*").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
        ))
    lower, bonus = None, 0.0
    for k in range(1, ORDER + 1):
        counts = levels[k]
        d1, d2, d3 = discounts(counts)
        n = F.col("n")
        cut = F.when(n == 1, d1).when(n == 2, d2).otherwise(d3)
        total = counts.agg(F.sum("n")).first()[0] or 0
        least = max(1, -(-total // slots)) if slots else 1
        held = (F.col("n") >= least) & (F.col("lo") < F.col("hi")) if others else F.col("n") >= least
        context = F.shiftright("gram", 8)
        weighed = counts.withColumn("context", context).withColumn("mass", n - cut)
        contexts = weighed.groupBy("context").agg(
            F.sum("n").alias("all"), F.sum(F.when(held, F.col("mass")).otherwise(0.0)).alias("kept")
        ).where("kept > 0").select("context", "all", (1 - F.col("kept") / F.col("all")).alias("gamma"))
        contexts = stored(contexts)
        kept = weighed.where(held).join(contexts, "context").select(
            "gram", (F.col("mass") / F.col("all")).alias("alpha"), "gamma"
        )
        if lower is None:
            root = contexts.first()
            bonus = float(np.log(max(root["gamma"], 1e-9))) if root else 0.0
            probability = kept.select("gram", (F.col("alpha") + F.col("gamma") / 256).alias("p"))
        else:
            below = lower.select(F.col("gram").alias("end"), F.col("p").alias("q"))
            # a suffix occurs at least as often as the n-gram, yet its continuation count may be below the cut
            probability = kept.withColumn("end", suffix(F.col("gram"), k - 1)).join(below, "end", "left").select(
                "gram", (F.col("alpha") + F.col("gamma") * F.coalesce("q", F.lit(1 / 256))).alias("p")
            )
        lower = stored(probability)
        if k > 1:
            # the back-off weight of a context is stored with the n-gram one shorter, if there is one
            weights = contexts.select(F.col("context").alias("gram"), "gamma")
            yield previous.join(weights, "gram", "full"), bonus
        previous = lower
    yield previous.withColumn("gamma", F.lit(1.0)), bonus


def collected(entries: DataFrame) -> Arrays:
    """The arrays of some entries; NaN for what an entry lacks."""
    rows = entries.select("gram", F.coalesce(F.log("p"), F.lit(float("nan"))).alias("p"), F.log(F.greatest(F.coalesce("gamma", F.lit(1.0)), F.lit(1e-9))).alias("g")).toArrow()
    return Arrays.of(*(rows.column(i).to_numpy() for i in range(3)))


def log_probabilities(orders: list[Arrays] | list[Parts], packed: np.ndarray) -> np.ndarray:
    """Natural log of the probability of the last byte of each packed n-gram."""
    result = np.zeros(len(packed), np.float64)
    rest, here = None, packed  # the places that are still open, at first all of them, and their n-grams
    for k in range(ORDER, 0, -1):
        logp = orders[k - 1].take(here, "logp")
        lacking = np.isnan(logp)
        if rest is None:
            np.copyto(result, logp, where=~lacking)
        else:
            result[rest[~lacking]] += logp[~lacking]
        open_ = np.flatnonzero(lacking)
        rest, here = open_ if rest is None else rest[open_], here[open_]
        if not len(rest):
            break
        if k > 1:
            result[rest] += orders[k - 2].take(here >> np.uint64(8), "backoff")
            here &= np.uint64((1 << (8 * (k - 1))) - 1)
        else:
            result[rest] += orders[0].unseen
    return result


def base_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = raw.split()
    n = len(words)
    later = 0 if raw.isascii() else np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) == 0x80)
    word_chars = sum(map(len, words)) - int(later)  # bytes that do not continue a character
    symbols = sum(map(raw.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()] if b"\n" in raw else []
    repeated = 0
    if n >= 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            seen: dict[tuple, int] = {}
            for window in windows:
                seen[window] = seen.get(window, 0) + 1
            hit = np.fromiter((seen[x] > 1 for x in windows), bool, n - 2)
            cover = np.zeros(n, bool)
            for shift in range(3):
                cover[shift : shift + n - 2] |= hit
            repeated = int(cover.sum())
    return n, word_chars, symbols, len(lines) - len(set(lines)), repeated


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, orders: list[Parts], worst: float = WORST) -> DataFrame:
    """doc_id, text_hash, lang, the base counts and log_ppl, the mean negative log probability of a byte, each ``worst`` at most."""
    # each piece passes over all parts, so fewer and longer pieces where there are many
    piece, slice_ = (8 * PIECE, 8 * PIECE) if max(len(o.arrays) for o in orders) > 1 else (PIECE, 4 * PIECE)
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("lang", pa.string()), *((m, pa.int64()) for m in MEASURES), ("log_ppl", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, slice_):
            values, offsets = byte_view(batch.column(2))
            total, at = np.zeros(batch.num_rows), 0
            for packed in pieces(values, offsets, piece):
                costs = log_probabilities(orders, packed)
                running = np.zeros(len(costs) + 1)
                np.cumsum(np.maximum(costs, -worst, out=costs), out=running[1:])
                del costs
                ends = np.clip(offsets - at, 0, len(packed))
                total += running[ends[1:]] - running[ends[:-1]]
                at += len(packed)
            length = np.diff(offsets)
            ppl = np.where(length > 0, -total / np.maximum(length, 1), np.nan)
            data = values.tobytes()
            counts = np.array([base_counts(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], np.int64).reshape(-1, 5)
            yield batch_of(schema, doc_id=batch.column(0), text_hash=batch.column(3), lang=batch.column(1).cast(pa.string()),
                           log_ppl=pa.array(ppl, from_pandas=True), **{m: counts[:, i] for i, m in enumerate(MEASURES)})

    ddl = "doc_id long, text_hash long, lang string, " + ", ".join(f"{m} long" for m in MEASURES) + ", log_ppl double"
    hashed = F.xxhash64("text").alias("text_hash")
    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text", hashed), run, ddl)


def judged(
    docs: DataFrame, slots: int = SLOTS, width: float = 4.0, headroom: float = 0.05, worst: float = WORST
) -> DataFrame:
    """Base counts, log_ppl, base_failed and kept for every row of ``docs``, by ``verdicts``."""
    return verdicts(docs, slots, width, headroom, worst).drop("text_hash", "lang")


def verdicts(
    docs: DataFrame, slots: int = SLOTS, width: float = 4.0, headroom: float = 0.05, worst: float = WORST
) -> DataFrame:
    """Base counts, log_ppl, base_failed and kept for every row of ``docs``.

    The bands of a language are its quartiles of log_ppl, over its documents that pass the base
    rules. The upper one is raised by ``width`` times their distance, and by ``headroom`` times the
    median at least. The lower one goes down by ``width`` times their distance, or a twentieth of the
    median if that is more, so that texts near to others stay for the stages that look for copies.
    ``log_ppl`` is the mean cost of a byte, each ``worst`` nats at most; a text is judged by
    n-grams that another text holds too. A NULL language has bands of its own, and so has each other value of ``lang``. Empty and NULL texts have
    no words and fail the base rules. Repeated rows come back repeated. Other columns are not read.
    """
    rows = stored(measured(docs, whole_model(docs, slots), worst).withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    ))
    quartile = lambda q: F.percentile_approx("log_ppl", q, 1000)
    bands = rows.where("not base_failed").groupBy("lang").agg(
        quartile(0.25).alias("q1"), quartile(0.5).alias("q2"), quartile(0.75).alias("q3")
    )
    spread = F.col("q3") - F.col("q1")
    below = width * F.greatest(spread, F.col("q2") / 20)
    above = F.greatest(width * spread, headroom * F.col("q2"))
    bands = stored(bands.select("lang", (F.col("q1") - below).alias("lower"), (F.col("q3") + above).alias("upper")))
    inside = F.col("log_ppl").between(F.col("lower"), F.col("upper"))
    return rows.join(bands, rows["lang"].eqNullSafe(bands["lang"]), "left").select(
        "doc_id", "text_hash", rows["lang"], *MEASURES, "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"), "log_ppl",
        "lower", "upper",
    )


def keep_good(docs: DataFrame, slots: int = SLOTS, width: float = 4.0, headroom: float = 0.05) -> DataFrame:
    """``docs`` without the rows that the rules reject.

    A verdict follows from the text and the language, so it finds its rows by doc_id, language and a hash
    of the text; rows that share an id or have none do not decide for each other.
    """
    bad = verdicts(docs, slots, width, headroom).where("not kept").select(
        F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), F.col("text_hash").alias("_hash")
    ).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("lang").eqNullSafe(F.col("_lang")) & (F.xxhash64("text") == F.col("_hash"))
    return docs.join(bad, same, "left_anti")
