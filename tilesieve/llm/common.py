"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only if its counted rows are at most this many.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus; only Spark's readers open the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder.

    The folder is the one that the cluster names in spark.checkpoint.dir. A folder of our own is set
    only where that is unset, as in tests on one machine.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the bound, else df for a shuffled join.

    df should come from cut_lineage, so that counting it costs nothing.
    """
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def with_id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that an operator reads, under fixed names: other columns can't clash with results."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def id_text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Of each Arrow batch (doc_id, text): the ids and the texts as UTF-8; a null text is empty."""
    for batch in batches:
        yield batch.column(0), [b or b"" for b in batch.column(1).cast(pa.binary()).to_pylist()]
