"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet in the shared folder and read again as the next one's docs,
so a lost executor or a restart costs one stage at most.  All stages but the last
return the columns of ``documents``; the last adds ``shard`` and ``slot``.

1. quality rules: documents that fail a rule of the full policy go;
2. MinHash near-dedup: of the documents that are linked (five-word shingles,
   Jaccard 0.8), directly or through others, the one with the smallest id stays;
3. benchmark decontamination: documents that hold an item go;
4. mixing: sources are brought to their target weights, longer documents before
   shorter ones; a row is there as often as the mix takes it;
5. sharding: rows go to 16 shards of near equal bytes.

Defined results: null, empty and blank texts fail the quality rules; a null id is
near-deduplicated with nothing and counts as one key in the mix; repeated rows of
one id are judged alike, and copies that a mix takes are rows of their own; ties
are broken by id; texts are read whole, however long; columns beside those of
``documents``, whatever their names, are carried along; an empty table gives an
empty table.

SQL can express neither the latent space nor signatures; the tests hold every
stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattiq.llm import decontaminate, minmax_dedup, mixing, quality_rules, sharding
from lattiq.llm.common import read, remove, scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.apply_policy(docs, quality_rules.FULL)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minmax_dedup.keep_one(docs, width=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs, propensity=mixing.by_length)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs, keep=True)


STAGES = [
    ("quality_rules", quality),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminated),
    ("source_mixing", mixed),
    ("sharding", sharded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, applied to ``documents``."""
    docs, last = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)
        last = path
    return docs
