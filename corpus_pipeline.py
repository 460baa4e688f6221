"""From raw documents to packed training bins, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and reread as the next one's docs. The first four return the columns of documents;
the last returns the pieces of documents in their bins.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm.common import table
from helixframe.llm.exact_dedup import drop_copies
from helixframe.llm.mixing import mixed_documents
from helixframe.llm.packing import pack
from helixframe.llm.simhash import drop_near_copies
from helixframe.llm.toxicity import accepted, train
from helixframe.scratch import remove, scratch_folder


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go."""
    return accepted(docs, train(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, white space aside, the document of smallest doc_id stays."""
    return drop_copies(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (0.8 of their five-word shingles in common), the document of smallest doc_id stays."""
    return drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the one at a source's cut in part."""
    return mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins that hold no source and no text twice."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: A trained classifier decides the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir, each one's rows written to the shared scratch folder and reread."""
    folder = f"{scratch_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:  # what the stage read is of no more use
            remove(spark, before)
        before = f"{folder}/{name}"
    bins = STAGES[-1][1](spark, docs, sf_dir)
    remove(spark, folder)  # packing has settled what it needs of its input
    return bins
