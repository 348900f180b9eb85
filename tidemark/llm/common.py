"""Shared helpers of the training-data operators."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder with the vocabulary files of the public tokenizers; a parameter of every operator that reads them.
TOKENIZER_DIR = os.environ.get("TIDEMARK_TOKENIZERS", "/opt/tokenizers")


def spread(df: DataFrame) -> DataFrame:
    """Repartition a scan that has fewer splits than the cluster has cores (a single small file or row group)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: A hot key of a join is spread over so many keys.
SPREAD = 32


def join_spread(many: DataFrame, one: DataFrame, keys: str | list[str], by: str, how: str = "inner") -> DataFrame:
    """A join whose left side may have a hot key: its rows are spread by ``by``, the right side (one row a key) is written ``SPREAD`` times."""
    left = many.withColumn("__s", F.pmod(F.xxhash64(by), F.lit(SPREAD)).cast("int"))
    right = one.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return left.join(right, [*([keys] if isinstance(keys, str) else keys), "__s"], how).drop("__s")
