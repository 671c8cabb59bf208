"""A pipeline over documents: each stage applies one corpus operator to all that the stage before has kept.

All stages but the last return the columns of documents, whatever others there are and however they are named. Documents keep their ids; the mix may
repeat or leave out rows. An empty table passes through all stages and gives no rows.
"""

from __future__ import annotations

import functools
import threading

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import bpe, minhash, mixing, quality_rules, suffix_dedup
from lodestar.llm.common import MADE, drop, materialize
from lodestar.llm.queries import vocabulary_path


class _Left(threading.local):
    """Scratch tables of the stage before, in this thread."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_left = _Left()


def stage(f):
    """A stage begins when the one before is written: that one's scratch tables go."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop(spark, *_left.paths)
        before = set(MADE.tables)
        out = f(spark, docs, sf_dir)
        _left.paths = [p for p in MADE.tables if p not in before]
        return out

    return run_stage


#: Bytes of a repeated passage: about 40 words and more.
PASSAGE = 200


@stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null and empty texts too, as they have no words. Rows that repeat are judged alike, one by one."""
    return quality_rules.filter_quality(docs)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one with the least id; of rows that agree in id and text one. Rows without an id or words stay."""
    return minhash.drop_near_duplicates(docs)


@stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of PASSAGE bytes and more that stand elsewhere too are cut out; every document stays, if need be empty. Null text is empty; copies of a text are all cut."""
    return suffix_dedup.remove_repeats(docs, PASSAGE)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand as often as the mix of sources takes them, rows that repeat each on its own; null is a source of its own."""
    return mixing.mix_documents(docs)


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, tokens (little-endian unsigned 32-bit ids) and the text decoded from them, a row for each row; null text is empty."""
    return bpe.encode_decode(docs, vocabulary_path())


STAGES = [
    ("quality rules", keep_quality),
    ("MinHash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: Compression ratios, near-duplicate classes and tokens are beyond SQL; the tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{i}")
    return docs
