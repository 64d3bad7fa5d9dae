"""Shared plumbing of the corpus operators: tables, shared scratch space, word splitting."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave.scratch import written as durable  # noqa: F401

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bytes of text that one shuffle partition stands for.
PARTITION_BYTES = 32 << 20


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts, counted."""
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def partitions(spark: SparkSession, size: int) -> int:
    """Number of shuffle partitions for so many bytes of text: they grow in number, not in size."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))


#: Size of the filters below; full ones let more pass, they never lose a key.
FILTER_BITS = 1 << 26


def key_filter(keys: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A one-hash Bloom filter (64-bit words) of the long column of keys; at most bits / 64 rows are collected, whatever the input."""
    slot = F.col(keys.columns[0]).bitwiseAND(F.lit(bits - 1))
    words = keys.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast(`{keys.columns[0]}` & 63 as int))").alias("bit")).groupBy("word").agg(F.expr("bit_or(bit)").alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def in_filter(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys.astype(np.int64) & (len(filter_) * 64 - 1)
    return (filter_[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) != 0


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)
