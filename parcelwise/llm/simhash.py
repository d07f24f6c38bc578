"""Near-duplicate detection by SimHash with a byte-position inverted index and count filtering.

A fingerprint has eight bytes. If two fingerprints differ in at most two bits, at least six of their
positional bytes are the same. Postings of single bytes would be lists of a 256th of all fingerprints,
so the index posts each distinct fingerprint under every five of its eight positional bytes. A pair
that shares s bytes meets in (s over 5) of the 56 lists: the tally of meetings counts the shared bytes.
Pairs that meet in fewer than (6 over 5) = 6 lists share fewer than six bytes and go; only the others
are compared bit by bit.

Posting lists longer than ``longest`` are not paired up. Their members are linked exactly through
one-bit neighbours: two fingerprints differ in at most two bits if and only if some value is within
one bit of both. A value has 65 such neighbours at most, so this is linear in the members. A pair that
meets in a long list is found there; any other pair has all its meetings tallied.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.common import arrow_map, batch_of, checkpointed, raw_texts, stored

SEED = 42
POSITIONS = 8
MOST_BITS = 2
POSTED = 5
LEAST_MEETINGS = math.comb(POSITIONS - MOST_BITS, POSTED)
LONGEST = 32
CHUNK = 1 << 16


def fingerprint(raw: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of the ``shingle``-word shingles, repeats included; 0 without words."""
    words = raw.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles = iter([words])
        n = 1
    else:
        shingles = zip(*(words[i:] for i in range(shingle)))
        n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(b" ".join(s), SEED) for s in shingles), np.uint64, n).astype(">u8")
    ones = np.zeros(64, np.int64)
    for start in range(0, n, CHUNK):
        bits = np.unpackbits(hashes[start : start + CHUNK].view(np.uint8)).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) for every row; ``fp`` is the fingerprint as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t, shingle) for t in raw_texts(batch.column(1))), np.uint64, batch.num_rows)
            yield batch_of(schema, doc_id=batch.column(0), fp=prints.view(np.int64))

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fp long")


def postings(prints: DataFrame) -> DataFrame:
    """(key, value, fp): every fingerprint under each choice of five positional bytes."""
    masks = [sum(0xFF << 8 * p for p in chosen) for chosen in combinations(range(POSITIONS), POSTED)]
    signed = F.array(*(F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in masks))
    return prints.select("fp", F.posexplode(signed).alias("key", "mask")).select(
        "key", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp"
    )


def tallied(short: DataFrame) -> DataFrame:
    """(u, v, meetings) of the pairs that meet in posting lists; a list holds ``longest`` members at most."""
    return (
        short.groupBy("key", "value").agg(F.collect_list("fp").alias("members"))
        .select("members", F.explode("members").alias("u"))
        .select("u", F.explode(F.filter("members", lambda m: m > F.col("u"))).alias("v"))
        .groupBy("u", "v").agg(F.count("*").alias("meetings"))
    )


def links(prints: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Edges (u, v) that connect all distinct fingerprints with at most two differing bits."""
    posted = postings(prints)
    lists = stored(posted.groupBy("key", "value").count().where("count > 1"))
    short = tallied(posted.join(lists.where(F.col("count") <= longest).drop("count"), ["key", "value"]))
    short = short.where(F.col("meetings") >= LEAST_MEETINGS).select("u", "v").where(
        F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MOST_BITS
    )
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)))
    crowded = posted.join(lists.where(F.col("count") > longest), ["key", "value"], "left_semi").select("fp").distinct()
    near = (
        crowded.select("fp", F.explode(F.transform(flips, lambda f: f.bitwiseXOR(F.col("fp")))).alias("middle"))
        .groupBy("middle").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1)
        .select(F.array_min("members").alias("u"), F.explode("members").alias("v")).where("u <> v")
    )
    return short.unionByName(near).distinct()


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").where("m <> v").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    """``edges`` point from the larger end to the smaller one."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every linked node but the smallest of its component, with that smallest node.

    Alternating large and small stars; each round is checkpointed, and its work follows the edges.
    """
    edges = checkpointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        edges = checkpointed(small_star(large_star(edges).distinct()).distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return edges
        state = now


def near_duplicates(docs: DataFrame, shingle: int = 3, longest: int = LONGEST) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of ``docs``.

    NULL and empty texts and texts of white space have fingerprint zero, which is linked like any
    other. Repeated rows come back repeated. Rows with a NULL doc_id are linked and returned, but
    never name a component; a component of such rows alone has a NULL component_id. Other columns of
    ``docs`` are not read.
    """
    prints = stored(fingerprints(docs, shingle))
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(classes.select("fp"), longest))
    rooted = classes.join(roots.withColumnRenamed("u", "fp").withColumnRenamed("v", "root"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    named = stored(
        rooted.join(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("fp", "component_id")
    )
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``docs`` with the smallest doc_id of each component only.

    Rows that share a doc_id count as one document, of which one row stays. Rows without a doc_id
    cannot be told apart by it and all stay.
    """
    groups = stored(near_duplicates(docs, shingle))
    named = groups.where("doc_id is not null")
    gone = named.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    repeated = named.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(repeated, "doc_id", "left_anti").unionByName(once)
