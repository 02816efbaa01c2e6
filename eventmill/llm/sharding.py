"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered 0..n-1 in the order of id, checksum and size. A balanced Feistel
network permutes 0..4^k-1 with 4^k >= n; a value of n or more goes through the network
again until it falls below n (cycle walking), which permutes 0..n-1. Place p is slot
p // shards of shard p % shards, so shard counts differ by one at most, slots have no
gaps, and both follow from the row number alone and back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventmill.operators.ordering import global_rank
from eventmill.session import stage

ROUNDS = 6
SEED = 20250
# Odd multipliers of the round function, below 2**31 so that products fit a signed long.
MIX_A = 0x2C1B3C6D
MIX_B = 0x297A2D39


def round_keys(seed: int = SEED) -> list[int]:
    keys, x = [], seed & 0x7FFFFFFF
    for _ in range(ROUNDS):
        x = (x * 1103515245 + 12345) & 0x7FFFFFFF
        keys.append(x)
    return keys


def half_bits(n: int) -> int:
    """Bits of each half; both halves together number at least n values."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _mix(half: np.ndarray, key: int, mask: int) -> np.ndarray:
    t = (half ^ key) & 0x7FFFFFFF
    t = t * MIX_A
    t = (t ^ (t >> 29)) & 0x7FFFFFFF
    t = t * MIX_B
    return (t ^ (t >> 17)) & mask


def _network(x: np.ndarray, bits: int, keys: list[int], back: bool) -> np.ndarray:
    mask = (1 << bits) - 1
    left, right = x >> bits, x & mask
    for key in reversed(keys) if back else keys:
        if back:
            left, right = right ^ _mix(left, key, mask), left
        else:
            left, right = right, left ^ _mix(right, key, mask)
    return (left << bits) | right


def permute(rows: np.ndarray, n: int, seed: int = SEED, back: bool = False) -> np.ndarray:
    """Places of row numbers below ``n`` (``back``: row numbers of places)."""
    bits, keys = half_bits(n), round_keys(seed)
    out = _network(np.asarray(rows, np.int64), bits, keys, back)
    while len(over := np.flatnonzero(out >= n)):
        out[over] = _network(out[over], bits, keys, back)
    return out


def place(n: int, seed: int = SEED):
    """Column function: row number to place."""

    @F.pandas_udf("long")
    def placed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series(permute(rows.to_numpy(), n, seed))

    return placed


def shard_rows(
    docs: DataFrame, shards: int = 8, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard, slot for every row.

    Size is the text's UTF-8 bytes plus 1; NULL text has none, its checksum is that of
    the empty text. NULL ids come first. Rows equal in id, checksum and size are
    interchangeable: their places go to them in any order. Only ids, checksums and sizes
    are sorted, never texts. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    slim = stage(slim, "shard-input")
    n = slim.count()
    order: list[Column] = [F.col(c).asc_nulls_first() for c in ("doc_id", "text_crc32", "size")]
    ranked = global_rank(slim, order, "row_number")
    spot = ranked.withColumn("place", place(n, seed)("row_number"))
    return spot.select(
        "doc_id",
        "size",
        "text_crc32",
        "row_number",
        (F.col("place") % shards).cast("int").alias("shard"),
        F.expr(f"place div {int(shards)}").alias("slot"),
    )


def write_shards(placed: DataFrame, path: str, block: int = 1_000_000) -> None:
    """Write rows with ``shard`` and ``slot`` below shard=K, in slot order inside each file of ``block`` slots."""
    part = F.floor(F.col("slot") / F.lit(block))
    (
        placed.withColumn("block", part)
        .repartition("shard", "block")
        .sortWithinPartitions("shard", "block", "slot")
        .write.partitionBy("shard", "block")
        .parquet(path)
    )


def oracle(shards: int = 8, seed: int = SEED) -> str:
    """The same permutation in DuckDB SQL."""

    def crc_table() -> str:
        """Table of the reflected polynomial 0xEDB88320, one byte at a time."""
        sql = "SELECT b, b::BIGINT AS v FROM range(256) AS r(b)"
        for _ in range(8):
            sql = f"SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM ({sql})"
        return sql

    def network(value: str, source: str, keep: str) -> list[str]:
        steps = [f"SELECT {keep}, n, half, mask, {value} >> half AS l, {value} & mask AS r FROM {source}"]
        for key in round_keys(seed):
            inner = f"((xor(r, {key}) & 2147483647) * {MIX_A})"
            again = f"((xor({inner}, {inner} >> 29) & 2147483647) * {MIX_B})"
            mixed = f"(xor({again}, {again} >> 17) & mask)"
            steps.append(f"SELECT {keep}, n, half, mask, r AS l, xor(l, {mixed}) AS r FROM (%s)")
        return steps

    def nested(value: str, source: str, keep: str) -> str:
        sql, *more = network(value, source, keep)
        for step in more:
            sql = step % sql
        return f"SELECT {keep}, n, half, mask, (l << half) | r AS p FROM ({sql})"

    return f"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY b) AS crc FROM ({crc_table()})),
slim AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
      string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1 ', 'g'), ' ')[:-2],
      lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS text_crc32
  FROM documents, crc_table),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS g FROM slim),
total AS (
  SELECT n, half, (1::BIGINT << half) - 1 AS mask FROM (
    SELECT n, greatest(1, (length(bin(greatest(n - 1, 1))) + 1) // 2)::INTEGER AS half
    FROM (SELECT count(*) AS n FROM documents))),
walk AS (
  SELECT g, n, half, mask, p FROM ({nested("g", "(SELECT g, n, half, mask FROM numbered, total)", "g")})
  UNION ALL
  SELECT g, n, half, mask, p FROM ({nested("p", "(SELECT * FROM walk WHERE p >= n)", "g")}))
SELECT doc_id, size, text_crc32, 'rows' AS law, (p % {shards})::INTEGER AS shard,
  (p // {shards})::BIGINT AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM numbered JOIN walk USING (g) WHERE p < n"""
