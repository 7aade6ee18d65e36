"""Join helper for bounded top-k tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def lookup_small(small: DataFrame, big: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """``small`` left-joined with ``big`` when ``small`` is a bounded top-k.

    A broadcast hint on the preserved side of a left join is ignored, so the
    big side would be shuffled.  Instead ``big`` is first cut to the keys of
    ``small`` by an inner join that builds ``small`` (big is only streamed),
    and the result -- at most one row per key of ``small`` when ``key`` is
    unique in ``big`` -- is broadcast into the left join.
    """
    keys = F.broadcast(small.select(key).distinct())
    hits = big.select(key, *cols).join(keys, key)
    return small.join(F.broadcast(hits), key, "left")
