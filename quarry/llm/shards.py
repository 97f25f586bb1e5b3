"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows get gapless numbers in doc_id order, a keyed permutation of [0, N) shuffles the numbers, and shard and slot
follow by arithmetic: shard = p mod shards, slot = p div shards. Shard sizes differ by at most one row, and anybody
who knows N, the key and a row number can compute the row's place.

Defined results: a null text has size 1 and the checksum of no bytes; null doc_ids come first; rows that tie on
doc_id are told apart by their text, and fully equal rows take neighbouring numbers; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import numbered

ROUNDS = 6


def _round(half: np.ndarray, key: int, turn: int, mask: np.uint64) -> np.ndarray:
    """The keyed round function: multiply, shift and fold."""
    salt = np.uint64((key * 0x9E3779B97F4A7C15 + (turn + 1) * 0xD1B54A32D192ED03) & (2**64 - 1))
    x = (half + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9) ^ salt
    x = (x ^ x >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
    return (x ^ x >> np.uint64(32)) & mask


def permute(numbers: np.ndarray, total: int, key: int) -> np.ndarray:
    """The permutation of [0, total) at `numbers`; values that fall outside walk on until they are inside."""
    bits = max(1, (max(total - 1, 1).bit_length() + 1) // 2)
    shift, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    out = np.asarray(numbers, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for turn in range(ROUNDS):
            left, right = right, left ^ _round(right, key, turn, mask)
        out[todo] = left << shift | right
        todo = todo[out[todo] >= total]
    return out.astype(np.int64)


def unpermute(places: np.ndarray, total: int, key: int) -> np.ndarray:
    """The inverse of permute: which row number sits at each place."""
    bits = max(1, (max(total - 1, 1).bit_length() + 1) // 2)
    shift, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    out = np.asarray(places, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for turn in reversed(range(ROUNDS)):
            left, right = right ^ _round(left, key, turn, mask), left
        out[todo] = left << shift | right
        todo = todo[out[todo] >= total]
    return out.astype(np.int64)


def feistel_shards(docs: DataFrame, shards: int = 16, key: int = 7) -> DataFrame:
    """Place every row of (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard, row_no."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_tie"),
    )
    rows, total = numbered(narrow, ["doc_id", "size", "text_crc32", "_tie"], "shards")

    @F.pandas_udf("long")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), total, key))

    return rows.withColumn("_place", place("row_no")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("_place") % shards).cast("int").alias("shard"),
        F.expr(f"_place div {int(shards)}").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_no",
    )
