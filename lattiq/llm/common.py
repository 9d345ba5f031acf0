"""What the training-data operators share: words, checkpoints and small helpers.

A *word* is a maximal run of characters other than ASCII white space
(``[^\\x20\\x09-\\x0D]+``).  On UTF-8 bytes that is exactly ``bytes.split()``,
which is why the Python kernels take the text as binary: nothing is decoded,
and malformed UTF-8 cannot stop a task.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_SPLIT = "[\\x20\\x09-\\x0D]+"
MASK64 = (1 << 64) - 1


def words(text: Column) -> Column:
    """The words of a text as ``array<string>``; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_SPLIT), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words, as a long, without keeping them."""
    return F.size(words(text)).cast("long")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(word_hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of ``width`` consecutive words; empty if there are too few."""
    n = len(word_hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    factor = 1
    for k in range(width):
        factor = factor * 0x9E3779B97F4A7C15 & MASK64
        out += word_hashes[k : k + n] * np.uint64(factor | 1)
    return mix(out)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names.

    Where none is set, a local session gets one of its own; on a cluster that is
    an error, as executors share no temporary folder.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if not found:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir is not set: it has to name a folder that all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "lattiq-checkpoints"))
        found = sc.getCheckpointDir()
    _delete_at_exit(spark, found)
    return found


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    """Have the driver's file system remove a folder of this session when it closes."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)


def scratch_path(spark: SparkSession, stem: str) -> str:
    """A new path in the shared checkpoint folder; it goes when the session's driver ends, if not before."""
    return f"{ensure_checkpoint_dir(spark)}/{stem}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of this session that is no longer read."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files.

    Lineage ends there, so an executor that is lost later costs no recomputation
    of what stands above; rows and their order within partitions are then fixed.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have yet."""
    have = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in have:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows, else as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
