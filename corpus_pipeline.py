"""Five stages from raw documents to packed sequences; counted as part of ``ohmgraph.llm``."""

from __future__ import annotations

import functools
from collections.abc import Callable
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

from ohmgraph.llm import line_dedup, mixing, near_dedup, packing, quality
from ohmgraph.llm.common import Scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold go. The classifier is fitted on the labelled ones among ``docs``."""
    return quality.passing(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from all documents but the first; no document goes."""
    return line_dedup.deduped(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return near_dedup.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequences and offsets."""
    return packing.pack(docs)


#: Tables that the stages returned last and nobody may need any more.
_made: list[DataFrame] = []


def _cleaning(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``stage``, which first removes what an earlier one has returned, unless its input still reads it: with texts these tables are as large as the corpus."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles() if _made else []
        for old in list(_made):
            name = urlsplit(old._ohm_path).path
            if not any(name in urlsplit(f).path for f in read):
                Scratch(spark, "pipeline").drop(old)
                _made.remove(old)
        spark._jvm.System.gc()  # generated classes and buffers of earlier stages leave the driver, whose memory is the scarcest
        out = stage(spark, docs, sf_dir)
        if hasattr(out, "_ohm_path"):
            _made.append(out)
        return out

    return run_stage


STAGES = [
    ("10 quality classifier", _cleaning(quality_stage)),
    ("1 line dedup", _cleaning(line_stage)),
    ("4 MinHash near-dedup", _cleaning(near_stage)),
    ("5 mixing", _cleaning(mixing_stage)),
    ("3 best-fit packing", _cleaning(packing_stage)),
]
#: SQL cannot express the classifier, the signatures and the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each written as Parquet and read again."""
    tmp = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    last = None
    for _, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        now = tmp.keep(made, "stage")
        tmp.drop(made)
        if last is not None:
            tmp.drop(last)
        docs = last = now
    return docs
