"""Source divergence audit: which sources of a language differ, and by which terms.

Terms take part in shuffles as 64-bit digests; their texts stay in a stored table beside the counts
until late. The smallest and largest text of each kept digest show whether two terms share it; such
digests are counted again by text and split. Texts are joined back only to the rows that are returned.

Counts are dealt by (language, digest), so one shuffle serves the counts by source, the document
frequency and the language's total. Divergences between sources are summed in blocks of terms and
sources: a term is compared only between sources that have it, and the rest follows in closed form
from the share that a source gives to every term it lacks.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.llm.common import arrow_map, batch_of, raw_texts, ship, stored

UNIT = 1_000_000_000
LEAST_DOCS = 3
TOP = 200
#: Terms that a task holds before it hands its counts on.
HELD = 200_000
#: Counts, and sums between sources, that one block holds.
BLOCK_ROWS = 250_000
BLOCK_PAIRS = 1 << 20

#: A-Z to a-z; ASCII other than letters to blanks.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms(raw: bytes) -> list[bytes]:
    return raw.translate(LETTERS).split()


def occurrences(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of a term, added up within a task."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])

    def handed(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            size = len(n)
            if size:
                yield batch_of(
                    schema, lang=pa.repeat(lang, size), source=pa.repeat(source, size), term=list(n),
                    n=list(n.values()), docs=[docs[t] for t in n],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = defaultdict(lambda: (Counter(), Counter()))
        for batch in batches:
            for lang, source, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw_texts(batch.column(2))):
                n, docs = held[lang, source]
                words = terms(raw)
                n.update(words)
                docs.update(set(words))
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from handed(held)
                held.clear()
        yield from handed(held)

    return arrow_map(docs.select("lang", "source", "text"), run, "lang string, source string, term binary, n long, docs long")


def numbered_groups(docs: DataFrame) -> DataFrame:
    """(lang, source, slot): every occurring group, numbered within its language."""
    window = Window.partitionBy("lang").orderBy("source")
    return docs.select("lang", "source").distinct().withColumn("slot", (F.row_number().over(window) - 1).cast("int"))


def kept_counts(counts: DataFrame, key: list[str], least: int) -> DataFrame:
    """Counts of the terms in at least ``least`` documents of their language.

    ``lang_n`` is the language's count, ``first`` marks one row a term. ``counts`` is dealt by the
    language and the digest.
    """
    term = Window.partitionBy("lang", *key)
    return (
        counts.groupBy("lang", "source", *key).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .withColumns({
            "lang_docs": F.sum("docs").over(term), "lang_n": F.sum("n").over(term),
            "first": F.row_number().over(term.orderBy("source")) == 1,
        })
        .where(F.col("lang_docs") >= least)
    )


def vocabulary(found: DataFrame, least: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """Counts of kept terms by group, and the texts of the terms.

    ``found`` has a ``digest`` for each term. A term is known by its digest and ``piece``: 0 where the
    digest has one text, else the number of the text among those that share the digest.
    """
    key = ["lang", "digest"]
    counts = stored(kept_counts(found.select("lang", "source", "digest", "n", "docs").repartition(*key), ["digest"], least))
    texts = found.groupBy(*key).agg(F.min("term").alias("low"), F.max("term").alias("high"))
    texts = stored(texts.join(counts.where("first").select(*key), key, "left_semi"))
    counts = counts.select("lang", "source", "digest", F.lit(0).alias("piece"), "n", "lang_n", "first")
    names = texts.select(*key, F.lit(0).alias("piece"), F.col("low").alias("term"))
    shared = texts.where("low <> high").select(*key)
    if shared.isEmpty():
        return counts, names
    split = kept_counts(found.join(shared, key, "left_semi").repartition(*key), ["digest", "term"], least)
    piece = F.dense_rank().over(Window.partitionBy(*key).orderBy("term")).alias("piece")
    split = stored(split.select("lang", "source", "digest", piece, "n", "lang_n", "first", "term"))
    return (
        counts.join(shared, key, "left_anti").unionByName(split.drop("term")),
        names.join(shared, key, "left_anti").unionByName(split.where("first").select(*key, "piece", "term")),
    )


def per_unit(count: str, total: str) -> Column:
    """1 + floor(UNIT * (count + 1) / total), exact at any size; NULL without a total."""
    return F.expr(f"1 + (cast({UNIT} as decimal(38,0)) * ({count} + 1)) div nullif(cast({total} as decimal(38,0)), 0)")


def divergence(p, q):
    """floor((p - q)^2 / q), for arrays of whole numbers."""
    return (p - q) * (p - q) // q


def block_sums(term: np.ndarray, slot: np.ndarray, p: np.ndarray, zero: np.ndarray, low: int, high: int) -> np.ndarray:
    """Divergence sums of sources ``low`` to ``high`` against all sources, over the terms of a block.

    ``term``, ``slot`` and ``p`` tell the share of a term in a source that has it, ``zero`` the share
    of a term that a source lacks. First every term counts as lacking in at least one of the two; then
    the pairs that meet in a term are set right.
    """
    order = np.lexsort((slot, term))
    term, slot, p = term[order], slot[order], p[order]
    own = np.bincount(slot, minlength=len(zero))
    none = divergence(zero[low:high, None], zero[None, :])
    sums = (len(np.unique(term)) - own[low:high, None] - own[None, :]) * none
    alike = np.unique(np.stack([slot, p]), axis=1, return_counts=True)
    (slots, shares), times = alike
    mine = (slots >= low) & (slots < high)
    for other in range(len(zero)):
        np.add.at(sums[:, other], slots[mine] - low, divergence(shares[mine], zero[other]) * times[mine])
    for one in range(low, high):
        np.add.at(sums[one - low], slots, divergence(zero[one], shares) * times)
    for apart in range(1, len(zero)):
        met = np.flatnonzero(term[apart:] == term[:-apart])
        if not len(met):
            break
        for i, j in ((met, met + apart), (met + apart, met)):
            inside = (slot[i] >= low) & (slot[i] < high)
            i, j = i[inside], j[inside]
            a, b, x, y = slot[i], slot[j], p[i], p[j]
            change = divergence(x, y) - divergence(x, zero[b]) - divergence(zero[a], y) + none[a - low, b]
            np.add.at(sums, (a - low, b), change)
    return sums


def between_sources(shares: DataFrame, groups: DataFrame, block_rows: int, block_pairs: int) -> DataFrame:
    """(lang, slot, other, value): summed divergence of each source from each other of its language.

    A block holds the terms of one bucket and a range of sources, against all sources of the language.
    The number of buckets follows from the counts of the language, the ranges from its sources.
    """
    schema = pa.schema([("lang", pa.string()), ("slot", pa.int32()), ("other", pa.int32()), ("value", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("slot")
        lang, width, block = right.column("lang")[0], right.column("width")[0].as_py(), right.column("block")[0].as_py()
        size = right.num_rows
        low, high = block * width, min(size, (block + 1) * width)
        if left.num_rows:
            names = left.select(["digest", "piece"]).to_pandas()
            numbers = names.groupby(["digest", "piece"], sort=False).ngroup().to_numpy()
            slot, p = left.column("slot").to_numpy(), left.column("p").to_numpy()
            sums = block_sums(numbers, slot, p, right.column("zero").to_numpy(), low, high)
        else:
            sums = np.zeros((high - low, size), np.int64)
        one, other = np.divmod(np.arange((high - low) * size), size)
        one += low
        apart = one != other
        n = int(apart.sum())
        return pa.Table.from_batches([batch_of(schema, lang=pa.repeat(lang, n), slot=one[apart], other=other[apart], value=sums.ravel()[apart])])

    sized = groups.withColumns({
        "buckets": F.expr(f"cast(ceil((lang_rows + 1) / {block_rows}) as int)"),
        "width": F.expr(f"cast(greatest(1, {block_pairs} div sources) as int)"),
    }).withColumn("blocks", F.expr("cast(ceil(sources / width) as int)"))
    every = sized.select(
        "lang", "slot", "zero", "width", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"), "blocks"
    ).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = shares.join(sized.select("lang", "slot", "buckets", "blocks"), ["lang", "slot"]).select(
        "lang", F.expr("cast(pmod(digest, buckets) as int)").alias("bucket"), "digest", "piece", "slot", "p",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
    )
    key = ["lang", "bucket", "block"]
    parts = spread.groupBy(*key).cogroup(every.groupBy(*key)).applyInArrow(run, "lang string, slot int, other int, value long")
    return parts.groupBy("lang", "slot", "other").agg(F.sum("value").alias("value"))


def audited(
    docs: DataFrame,
    least: int = LEAST_DOCS,
    top: int = TOP,
    digest: Callable[[Column], Column] = F.xxhash64,
    block_rows: int = BLOCK_ROWS,
    block_pairs: int = BLOCK_PAIRS,
) -> DataFrame:
    """lang, source, part, item, value and rank: what each (lang, source) group differs by.

    Part ``pair`` has a row for each other source of the language, part ``term`` the first ``top`` terms
    that the group uses more than its language. NULL text, lang and source are read as empty texts and an
    empty text has no terms; such a group still has its pairs, whose value is 0 if the language keeps no
    term. Each row of ``docs`` is a document, so repeated rows count again. Equal values rank by the
    bytes of the item. An empty table gives an empty result; a group that is alone in its language has
    terms but no pairs. Texts of any length are read whole. Other columns are not read.
    """
    ship(docs.sparkSession)
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    found = stored(
        occurrences(docs).withColumn("term", F.col("term").cast("string")).withColumn("digest", digest(F.col("term")))
    )
    counts, names = vocabulary(found, least)
    langs = counts.groupBy("lang").agg(
        F.count_if("first").alias("kept"), F.sum("n").alias("lang_total"), F.count("*").alias("lang_rows")
    )
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = numbered_groups(docs).withColumn("sources", F.count("*").over(Window.partitionBy("lang")).cast("int"))
    groups = stored(
        groups.join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
        .na.fill(0, ["kept", "lang_total", "lang_rows", "total"])
        .withColumn("zero", per_unit("0", "total + kept"))
    )
    shares = stored(
        counts.join(groups, ["lang", "source"]).select(
            "lang", "source", "slot", "digest", "piece",
            per_unit("n", "total + kept").alias("p"), per_unit("lang_n", "lang_total + kept").alias("q"),
        )
    )

    group = Window.partitionBy("lang", "source")
    by_value = group.orderBy(F.desc("value"))
    over = shares.where("p > q").withColumn("value", F.expr("((p - q) * (p - q)) div q"))
    # Ties at the last rank stay until their texts are there to order them.
    first = over.withColumn("rank", F.rank().over(by_value)).where(F.col("rank") <= top).drop("rank")
    shown = first.join(names, ["lang", "digest", "piece"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")

    sums = between_sources(shares, groups, block_rows, block_pairs)
    place = groups.select("lang", "slot", "source")
    pairs = (
        sums.join(place, ["lang", "slot"])
        .join(place.select("lang", F.col("slot").alias("other"), F.col("source").alias("item")), ["lang", "other"])
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    )
    rank = F.row_number().over(group.orderBy(F.desc("value"), "item")).alias("rank")
    return pairs.select("*", rank).unionByName(shown.select("*", rank).where(F.col("rank") <= top))
