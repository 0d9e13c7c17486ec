"""A training-data pipeline over `documents`: quality, near duplicates, benchmark text, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next
stage's docs. All but the last return the columns they got, whatever these are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmatch.llm import decontaminate, minhash, packing, resample
from quillmatch.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards good labelled text selects; the others go.

    Each row is judged by its text: null and empty texts have no features and a log weight of 0, repeated rows are drawn
    each, ties at the last place stay. Rows without a doc_id have no label. An empty table stays one.
    """
    model, _ = resample.fit(docs, resample.good_labels(table(spark, sf_dir, "labels")))
    return resample.keep(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingle sets link at a similarity of 0.8 or more: the smallest doc_id.

    Repeated rows are one document. Texts without words are linked with nothing and stay; so do rows without both a
    doc_id and words. An empty table stays one.
    """
    return minhash.deduplicate(docs, words=5, percent=80)


def benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in 13-word windows of benchmark items.

    Each row is judged by itself; null and empty texts have no words and stay. An empty benchmark or table changes nothing.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=13, share=20)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens; null and empty texts are one piece, the end id. Repeated rows are packed each."""
    return packing.pack_documents(docs, length=2048, end_id=1)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark_text", benchmark_text), ("pack", pack)]

#: The second and third stage could be said in SQL, the first and last cannot; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
