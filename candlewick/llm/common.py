"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is configured and all run in one process."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not hasattr(spark, "_cw_shared"):
        spark._cw_shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return spark._cw_shared


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/candlewick-{name}-{uuid.uuid4().hex}"


def pin(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it again.

    A lost executor then costs the running stage only, and the rows can no
    longer differ between two uses of the result.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(run):
    """``run``, a function over Arrow batches, that at its end gives back what Arrow and the C library hold for it unused.

    Python workers outlive their tasks, so this memory would lie beside whatever runs next.
    """

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)

    return tidied


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for a row, not once for each element of a lambda inside."""
    return F.element_at(F.transform(F.array(value), body), 1)


def boxed(docs: DataFrame, **keys: Column) -> DataFrame:
    """``docs`` as one column ``row`` beside the given keys, whose names so cannot clash with theirs; ``row.*`` gives the columns back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in keys.items()])


def text_key(text: str | Column = "text") -> Column:
    """128-bit digest of a text as a string; null stays apart from the empty text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.md5(text.cast("binary")), F.lit("null"))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the rows that classifiers must not learn from: crc32 of the id as text, modulo 5, is 0."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
