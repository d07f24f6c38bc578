"""Exact token counts through a histogram of encoded lengths.

Every text is encoded by a public tokenizer; only its length goes on. Documents are aggregated by
length, and suffix sums over the histogram answer totals, quantiles and truncated totals for every
context limit: with a limit of L, the corpus keeps the tokens of all shorter documents and L of each
other one.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.llm.common import arrow_map, batch_of, slices, stored

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's tokenizer cuts a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
STEP = 1024
# Fixed value: the characters that the pattern's \s stands for (Unicode White_Space).
BLANK = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Longer runs of blanks are encoded on their own: the pattern's matcher backs up over a run, and a
#: million blanks are more than it can bear.
LONG_RUN = re.compile(f"{BLANK}{{4096,}}")


def encoder(path: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokens(own, text: str | None) -> int:
    """How many tokens ``text`` encodes to, whatever its length; NULL has none.

    The pattern takes a run of blanks as one piece, but for its last blank where something follows. So
    a text may be cut around such a piece without changing a token, and the piece needs no pattern.
    """
    if not text:
        return 0
    at = count = 0
    for run in LONG_RUN.finditer(text):
        end = run.end() - (run.end() < len(text))
        count += len(own.encode_ordinary(text[at : run.start()])) + len(own._encode_single_piece(text[run.start() : end]))
        at = end
    return count + len(own.encode_ordinary(text[at:]))


def lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(length, n_docs): how many of ``docs`` encode to each length, one partial count a slice of texts."""
    schema = pa.schema([("length", pa.int64()), ("n_docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in slices(batches, 0):
            counts: dict[int, int] = {}
            for text in batch.column(0).to_pylist():
                n = tokens(own, text)
                counts[n] = counts.get(n, 0) + 1
            yield batch_of(schema, length=list(counts), n_docs=list(counts.values()))

    found = arrow_map(docs.select("text"), run, "length long, n_docs long")
    return found.groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def histogram(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each encoded length: n_docs, n_tokens, and the answers at that context limit.

    docs_from, tokens_from: documents of this length or more and their tokens. truncated_total: tokens
    of the corpus if every document is cut to this length. quantile: the share of documents that are no
    longer. total_docs, total_tokens: of the corpus. NULL and empty texts have length 0; texts of any
    length are encoded whole, runs of a million blanks or letters included; repeated rows count as often
    as they occur; other columns are not read; an empty table gives no rows.

    Sums run over blocks of 1,024 lengths, and then within each block, so no task sees all lengths.
    """
    rows = stored(lengths(docs, vocabulary).withColumn("n_tokens", F.col("length") * F.col("n_docs")).withColumn("block", F.floor(F.col("length") / STEP)))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    sums = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t")).select(
        "block", *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_later") for c in "dt"),
        F.sum("d").over(whole).alias("total_docs"), F.sum("t").over(whole).alias("total_tokens"),
    )
    within = Window.partitionBy("block").orderBy(F.col("length").desc())
    return (
        rows.join(sums, "block")
        .withColumn("docs_from", F.col("d_later") + F.sum("n_docs").over(within))
        .withColumn("tokens_from", F.col("t_later") + F.sum("n_tokens").over(within))
        .select(
            "length", "n_docs", "n_tokens", "docs_from", "tokens_from",
            (F.col("total_tokens") - F.col("tokens_from") + F.col("length") * F.col("docs_from")).alias("truncated_total"),
            ((F.col("total_docs") - F.col("docs_from") + F.col("n_docs")) / F.col("total_docs")).alias("quantile"),
            "total_docs", "total_tokens",
        )
    )


def truncated_total(table: DataFrame, limit: int) -> DataFrame:
    """tokens: the corpus total with every document cut to ``limit``, from a histogram."""
    return table.agg(F.coalesce(F.sum(F.least(F.col("length"), F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("tokens"))
