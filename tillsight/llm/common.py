"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tillsight.session import discard, ensure_checkpoint_dir, shuffles_removed  # noqa: F401

# Vocabulary files and rule tables are shipped to tasks as broadcasts; both have a fixed size
# that does not depend on the corpus, and this is the largest one accepted.
MAX_BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the shared checkpoint folder and read it back: cuts the
    lineage, survives lost executors, and later steps read only the columns they use."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_stored_at"] = path
    return out


def vocabulary_bytes(path: str) -> bytes:
    """A tokenizer's file as bytes, to be broadcast; refused beyond MAX_BROADCAST_BYTES."""
    if os.path.getsize(path) > MAX_BROADCAST_BYTES:
        raise ValueError(f"vocabulary {path} is larger than {MAX_BROADCAST_BYTES} bytes")
    with open(path, "rb") as f:
        return f.read()


def whole_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty ones; other columns are not read."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def ascii_lower(col):
    """A-Z to a-z and nothing else, whatever the locale."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def byte_slices(items, sizes, limit):
    """Consecutive (start, end) slices of ``items`` of about ``limit`` bytes each, one item at least."""
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(items):
        yield start, len(items)


def in_parts(run, rows=512):
    """``run`` over Arrow batches of at most ``rows`` rows, for functions that look at whole texts or sets: what a task
    holds as Python objects follows the part, not Spark's batch. At its end the task gives freed memory back to the
    system; the worker process is used again and would keep it beside that of the tasks after."""
    def parts(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)

    def wrapped(batches):
        yield from run(parts(batches))
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped
