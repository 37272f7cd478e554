"""A corpus pipeline of five of the corpus operators; each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkernels.llm import decontaminate, mixing, quality, simhash, wavelet
from sparkernels.llm.common import Table, documents, made
from sparkernels.llm.queries import tokenizer


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it is fitted on the labelled rows of these documents.

    Null and empty texts are scored by the bias, repeated rows alike; an empty table or no labels reject nothing.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest doc_id, once if rows repeat it.

    Null and empty texts are copies of each other; rows without a doc_id stay; an empty table gives none.
    """
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and empty texts, and all if there is no benchmark, stay."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come in their target weights: rows are repeated or left out. A null source is a source; texts without words go."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all that is left, in wavelet-matrix files; the result, a row for each of docs, is read back from them.

    Null and empty texts are one end id; rows that repeat each other follow each other; an empty table gives none.
    """
    return wavelet.digest(docs, tokenizer())


STAGES = [
    ("quality classifier", classify),
    ("SimHash near-dedup", deduplicate),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", tokens),
]

#: SQL expresses neither the trained classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written before the next begins; what a stage wrote on the way then goes."""
    docs, before = documents(spark, sf_dir), None
    for k, (_, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with made() as tables:
            kept = Table(stage(spark, docs, sf_dir), f"stage{k}")
        for table in tables:
            if table is not kept:
                table.release()
        if before:
            before.release()
        before, docs = kept, kept.df
    return docs
