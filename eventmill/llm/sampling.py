"""Bounded samples of labelled rows for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

_SPAN = 1 << 30


def sample_rows(rows: DataFrame, chance: Column, limit: int) -> list[Row]:
    """About ``limit`` rows, never more, chosen by the hash ``chance`` and in its order.

    A count sets the share of hashes that is read, half as many again as needed, so that
    tasks send the driver their part of the sample and not ``limit`` rows each.
    """
    total = rows.count()
    drawn = F.pmod(chance, F.lit(_SPAN))
    share = min(1.0, (1.5 * limit + 20) / max(1, total))
    picked = rows.withColumn("_drawn", drawn).filter(F.col("_drawn") < int(share * _SPAN) + 1)
    return picked.orderBy("_drawn", *rows.columns).limit(limit).drop("_drawn").collect()
