"""A corpus pipeline over ``documents``: five stages, each one of the operators
of ``driftline.llm``.  Every stage works on all rows that its predecessor kept;
all but the last return the columns of ``documents``.

Stages: language ID (documents of no language go), the n-gram Jaccard join (one
document of each class of near duplicates stays), benchmark decontamination
(documents with ten consecutive words of a test item go), mixing (each document
as often as its source's target says) and sharding (equal texts together, equal
bytes per shard).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from driftline.llm.common import save
from driftline.llm.decontaminate import decontaminate
from driftline.llm.language_id import accepted
from driftline.llm.mixing import apply_mix
from driftline.llm.ngram_join import one_per_class
from driftline.llm.sharding import shard

ROOT = os.path.dirname(os.path.abspath(__file__))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a learned language; null texts, texts without
    letters, and texts that every language's model codes worse than letters
    drawn evenly go."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    return accepted(docs)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each class of texts whose five-word
    shingles are linked by a Jaccard similarity of 0.8 or more."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    return one_per_class(docs, k=5, similarity=0.8)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten benchmark words."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=10, mode="documents")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once per copy that the mix takes: sources weigh 5, 2, 1 in
    turn, share 150 % of all words, and none passes twice its own."""
    return apply_mix(docs, weights=(5, 2, 1), share=(3, 2), most=2)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each row that the mix took."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    return shard(docs, shards=8)


STAGES = [
    ("language ID", keep_known_languages),
    ("n-gram Jaccard join", keep_one_of_each_class),
    ("benchmark decontamination", drop_benchmark_copies),
    ("mixing sources to target weights", mix_sources),
    ("sharding", assign_shards),
]

#: Language ID learns a model, which SQL cannot express; a test compares run()
#: with plain Python versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each one's rows are written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = save(docs, f"stage{k}")
    return docs
