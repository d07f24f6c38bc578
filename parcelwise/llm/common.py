"""Helpers that several corpus operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Words everywhere in this package: runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the executors this package once a session: Spark serves the archive to them."""
    context = spark.sparkContext
    if getattr(context, "_corpus_code", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(os.path.dirname(here))
    path = os.path.join(tempfile.mkdtemp(prefix="code-"), "corpus_code.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder in (os.path.dirname(here), here):
            for name in sorted(os.listdir(folder)):
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    archive.write(file, os.path.relpath(file, root))
    context.addPyFile(path)
    context._corpus_code = True


def arrow_map(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def kept_rows(docs: DataFrame, column: str, judge: Callable[[pa.Array], np.ndarray], most: int = 1 << 22) -> DataFrame:
    """Rows of ``docs``, with all their columns, for which ``judge`` says True of the value in ``column``.

    Every row goes by its own verdict, so rows that share an id or have none do not decide for each other.
    """
    at = docs.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at, most):
            yield batch.filter(pa.array(judge(batch.column(at)), pa.bool_()))

    return arrow_map(docs, run, docs.schema)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the cluster; one of our own only where none is set, as in tests."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: no lineage to repeat, and a known size.

    Spark broadcasts such a table in a join only if its size is below its own threshold.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """One round of an iteration; Spark's cleaner removes its files once nothing refers to them."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the id as text; NULL ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a whole batch and the offsets of its texts; NULL is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(offsets) == 0:
        offsets = np.zeros(1, np.int64)
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``most`` bytes in ``column``; a longer text is a slice alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start, filled = 0, 0
        for row, size in enumerate(sizes):
            if row > start and filled + size > most:
                yield batch.slice(start, row - start)
                start, filled = row, 0
            filled += size
        if start < batch.num_rows:
            yield batch.slice(start)


def raw_texts(column: pa.Array) -> Iterator[bytes]:
    """The texts as bytes, one at a time; NULL is an empty text."""
    values, offsets = byte_view(column)
    data = values.tobytes()
    for start, end in zip(offsets[:-1], offsets[1:]):
        yield data[start:end]


def batch_of(schema: pa.Schema, **columns: Any) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in schema], schema=schema
    )


def bounded_sample(labelled: DataFrame, columns: Sequence[str], most: int) -> DataFrame:
    """All rows if there are no more than ``most``, else ``most`` different ones: the same in every run.

    Rows are chosen one by one, by a hash of all ``columns``, so ids that repeat or are NULL neither
    break the bound nor empty the sample. Of rows that agree in all ``columns`` one is enough.
    """
    hashed = labelled.withColumn("_hash", F.xxhash64(*columns, F.lit(7)))
    first = hashed.groupBy("_hash").count().orderBy("_hash").limit(most)
    found = first.agg(F.max("_hash").alias("last"), F.count("*").alias("n"), F.sum("count").alias("rows")).first()
    if found.n == 0 or found.n < most and found.rows <= most:
        return labelled
    return hashed.where(F.col("_hash") <= found["last"]).dropDuplicates(["_hash"]).drop("_hash")


def labelled_sample(docs: DataFrame, marks: DataFrame, most: int) -> DataFrame:
    """``bounded_sample`` of the (doc_id, text, label) that documents and ``marks`` (doc_id, label 0 or 1) join to.

    What is joined, counted and sorted are ids and hashes; texts leave the scan for the chosen rows alone,
    which are few enough to be broadcast.
    """
    texts = docs.select("doc_id", "text")
    hashes = [F.xxhash64("doc_id", "text", F.lit(y), F.lit(7)).alias(f"_hash{y}") for y in (0, 1)]
    counted = marks.select("doc_id", F.col("label").cast("int")).groupBy("doc_id", "label").agg(F.count("*").alias("copies"))
    hashed = texts.select("doc_id", *hashes).join(counted, "doc_id").withColumn(
        "_hash", F.when(F.col("label") == 1, F.col("_hash1")).otherwise(F.col("_hash0"))
    )
    groups = hashed.groupBy("_hash", "doc_id", "label", "copies").agg(F.sum("copies").alias("rows"))
    chosen = stored(groups.orderBy("_hash").limit(most))
    found = chosen.agg(F.count("*").alias("n"), F.sum("rows").alias("rows")).first()
    own = F.xxhash64("doc_id", "text", "label", F.lit(7)) == F.col("_hash")
    rows = texts.join(F.broadcast(chosen.drop("rows")), "doc_id").where(own)
    if found.n < most and (found.rows or 0) <= most:
        rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    else:
        rows = rows.dropDuplicates(["_hash"])
    return rows.select("doc_id", "text", "label")
