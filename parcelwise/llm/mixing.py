"""Mixing sources to target weights by entropy balancing.

Document rates w minimise the relative entropy sum(size * w * (log w - 1)) subject to one token
constraint per source, sum(size * w) = target. The optimum is exponentially tilted,
w = exp(lambda of the source), and the convex dual sum(size * exp(lambda)) - target * lambda is
solved by Newton steps. Each document has one source, so the Hessian is diagonal, and the steps of
all sources run in parallel over the table of sources.

Rates become whole copies by systematic rounding: documents of a source are ranked by size, and
rank k gets an extra copy when k times the fractional rate passes a whole number. Similar sizes are
neighbours in that order, so surplus and shortfall cancel. Of ``STARTS`` starting points the one
nearest to the target is taken. All rounding is in whole numbers, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.llm.common import WORD, stored

WEIGHTS = (5, 2, 1)
MOST = 3
UNIT = 1_000_000_000
STARTS = 16
HEX = "0123456789abcdef"
NEWTON_STEPS = 64


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and size (words) of every row; a NULL text has size 0."""
    return docs.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    )


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size and target: shares by weight, stopped at ``most`` times the source's size.

    Sources in code point order, NULL last, take the weights in turn. A source is stopped if its
    cap does not exceed its share of what the sources with a smaller cap per weight leave.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy("room", F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    free = F.when(F.col("stopped"), 0).otherwise(F.col("weight"))
    return (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("long"))
        .withColumn("cap", most * F.col("source_size"))
        .withColumn("room", F.col("cap") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("stopped", F.col("cap") * F.col("open") <= F.col("left") * F.col("weight"))
        .withColumn("rest", F.sum("source_size").over(everything) - F.sum(F.when(F.col("stopped"), F.col("cap")).otherwise(0)).over(everything))
        .withColumn("shares", F.sum(free).over(everything))
        .select(
            "source", "source_size",
            F.when(F.col("stopped"), F.col("cap").cast("double"))
            .otherwise(F.col("weight") * F.col("rest") / F.col("shares")).alias("target"),
        )
    )


def rate(size: Column, target: Column, steps: int = NEWTON_STEPS) -> Column:
    """exp(lambda) at the optimum of the dual, by Newton steps from lambda = 0.

    The gradient over the Hessian is 1 - target / (size * exp(lambda)). Steps downwards are at most 1,
    and a step upwards is at most target / size - 1, which the cap bounds.
    """
    step = lambda x, _: x - 1 + target / size * F.exp(-x)
    tilted = F.exp(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), step))
    return F.when((size > 0) & (target > 0), tilted).otherwise(0.0)


def band(size: Column) -> Column:
    """Grows with the size: its number of digits, and its first two digits in fives."""
    digits = size.cast("string")
    return 20 * F.length(digits) + F.floor(F.substr(digits, F.lit(1), F.lit(2)).cast("int") / 5)


def split(doc_id: Column) -> Column:
    """One of 64 parts, by an MD5 of the id, so that equal sizes in a large source are no single group."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))
    digit = lambda k: F.instr(F.lit(HEX), F.substr(digest, F.lit(k), F.lit(1))) - 1
    return digit(1) + 16 * (digit(2) % 4)


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, rate, copies and taken of every row.

    Empty and NULL texts have size 0 and take nothing. A NULL source is a source of its own. Repeated
    rows are documents of their own. Other columns are not read.
    """
    sizes = stored(sized(docs))
    sources = targets(sizes, weights, most).withColumn(
        "scaled", F.round(rate(F.col("source_size"), F.col("target")) * UNIT).cast("long")
    )
    sources = stored(sources.withColumn("scaled", F.least(F.col("scaled"), F.lit(most * UNIT))))
    placed = sizes.withColumn("band", band(F.col("size"))).withColumn("split", split(F.col("doc_id")))
    blocks = placed.groupBy("source", "band", "split").count()
    within = Window.partitionBy("source").orderBy("band", "split").rowsBetween(Window.unboundedPreceding, -1)
    blocks = stored(blocks.withColumn("before", F.coalesce(F.sum("count").over(within), F.lit(0))).drop("count"))
    own = Window.partitionBy("source", "band", "split").orderBy("size", "doc_id")
    same = lambda a, b, *names: [a[n].eqNullSafe(b[n]) for n in names]
    ranked = placed.withColumn("rank", F.row_number().over(own))
    ranked = ranked.join(blocks, same(ranked, blocks, "source", "band", "split")).select(
        ranked["doc_id"], ranked["source"], ranked["size"], (ranked["rank"] + blocks["before"]).alias("rank")
    )
    ranked = ranked.join(sources, same(ranked, sources, "source")).select(
        "doc_id", ranked["source"], "size", "rank", "source_size", "target", "scaled"
    )
    ranked = stored(ranked)

    def copies(start: Column) -> Column:
        part, k = F.col("scaled") % UNIT, F.col("rank")
        passed = lambda x: F.call_function("div", x + start, F.lit(UNIT))
        return F.call_function("div", F.col("scaled"), F.lit(UNIT)) + passed(part * k) - passed(part * (k - 1))

    starts = [UNIT // STARTS * i + UNIT // (2 * STARTS) for i in range(STARTS)]
    totals = ranked.groupBy("source").agg(
        F.first("target").alias("goal"), *(F.sum(F.col("size") * copies(F.lit(s))).alias(f"t{i}") for i, s in enumerate(starts))
    )
    misses = F.array(*(F.struct(F.abs(F.col(f"t{i}") - F.col("goal")), F.lit(s).alias("start")) for i, s in enumerate(starts)))
    best = stored(totals.select("source", F.array_min(misses)["start"].cast("long").alias("start")))
    return (
        ranked.join(best, same(ranked, best, "source"))
        .withColumn("copies", copies(F.col("start")).cast("long"))
        .select(
            "doc_id", "size", "source_size", "target", (F.col("scaled") / UNIT).alias("rate"), "copies",
            (F.col("copies") * F.col("size")).alias("taken"),
        )
    )
