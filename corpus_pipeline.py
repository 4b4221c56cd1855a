"""From raw documents to sharded training text, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and
read again as the next one's input. All but the last return the columns of documents.
Nulls, empty texts and repeated rows are treated as the operators' docstrings say:
rows without an id or text pass the two near-duplicate and benchmark stages, rows
that share an id stay or go together, and an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from openstat.llm.decontaminate import decontaminate
from openstat.llm.jaccard_join import jaccard_join
from openstat.llm.mixing import mix_sources
from openstat.llm.quality import score_quality
from openstat.llm.queries import SHARDS, fold, n_words, source_path, source_weights, table
from openstat.llm.sharding import SlotMaps, assign_shards, growth_map, rebalance, slot_weights
from openstat.session import shared_dir

#: Share of the tokens that the mix may hold, without repeating any document.
MIX_SHARE = 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.5 or more."""
    scored = score_quality(
        docs, table(spark, sf_dir, "labels"), learn=fold(F.col("doc_id"), 3) != 1, name="_quality"
    )
    return scored.filter("_quality >= 0.5").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group linked by a similarity of 0.8 or more."""
    groups = jaccard_join(docs, k=5, top=80, bottom=100)
    gone = groups.filter("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents up to the budgets of their sources, each once."""
    mixed = mix_sources(
        docs, source_path(), source_weights(), n_words(F.col("text")), share=MIX_SHARE, epochs=1
    )
    return mixed.select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and their place in it.

    The stored slot map gets a second version, rebalanced by the bytes measured per slot.
    """
    maps = SlotMaps.create(spark).publish(growth_map(SHARDS), 1)
    maps.publish(rebalance(maps.owner(), slot_weights(docs), SHARDS), 2)
    return assign_shards(docs, maps.read())


STAGES = [
    ("quality classifier", quality),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("mixing", mix),
    ("sharding", shard),
]

#: The classifier has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
