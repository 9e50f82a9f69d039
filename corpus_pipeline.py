"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage works on all that its predecessor kept, and its result is written and read again before
the next one starts, so that a lost executor costs one stage at most.

Defined results, in every stage: an empty table gives an empty one, and columns beside doc_id, text,
source and n_chars are kept as they are, whatever their names; the last stage drops them. What nulls,
empty and very long texts and repeated rows give is said at each stage.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tilesieve.llm import mixing, packing, quality_rules, sentence_spans, simhash_pivots
from tilesieve.llm.common import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Of texts, so many bytes go to a Python worker at once; Spark's own bound of 64 MB is held by each task's buffers and its worker. Results don't depend on it.
BATCH_BYTES = 4 << 20


def _in_small_batches(stage: Stage) -> Stage:
    """The stage, in a session that then hands over batches of at most that size; its result is computed later, so the setting stays."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


@_in_small_batches
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects.

    Null and empty texts have too few words and go; a null id or source changes nothing; repeated rows
    are judged alike; a text of any length is judged as a whole.
    """
    return quality_rules.filter_quality(docs)


@_in_small_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id: shingles of five words, similarity 0.8 or more.

    Null and empty texts are alike, so that one of them stays. Rows with a null id all stay. Rows that
    share an id are one document and stay or go together. A text of any length is compared as a whole.
    """
    return simhash_pivots.keep_one_similar(docs)


@_in_small_batches
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the sentences of repeated spans.

    Null and empty texts stay as they are, rows with a null id too. Rows that share an id are not
    compared with each other. Documents of which nothing is left go.
    """
    return sentence_spans.remove_repeats(docs)


@_in_small_batches
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for.

    Texts without words, null ones too, count nothing and are not taken. A null source is a source of
    its own. Rows are drawn on their own, those with a null id or a repeated one too.
    """
    return mixing.mix(docs)


@_in_small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences.

    A null or empty text is a piece of the end id alone; every row is packed, repeated ones each; a
    text longer than a sequence is cut into pieces.
    """
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mixing", mix),
    ("best_fit_packing", pack),
]

#: SQL can't express tokenisation, evolution or the seeded draws; tests/llm compares with brute force.
ORACLE_SQL: str | None = None


def _folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder that the cluster names; one of our own only where none is, as in tests on one machine."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(shared or tempfile.gettempdir()).rstrip('/')}/pipeline-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the table `documents`; a stage's table goes once the next one's is written."""
    top = _folder(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(out := f"{top}/{k}_{name}")
        docs = spark.read.parquet(out)
        if before:
            _remove(spark, before)
        before = out
    return docs
