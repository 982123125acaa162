"""Reproducible random numbers by key: the same on every cluster, partitioning
and retry, and in any engine that has md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: str, *keys: Column) -> Column:
    """A number in (0, 1) by the seed and the keys."""
    h = F.md5(F.concat_ws(":", F.lit(seed), *[k.cast("string") for k in keys]).cast("binary"))
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)


def uniform_sql(seed: str, *keys: str) -> str:
    return f"((('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(keys)})), 1, 8))::bigint::double + 0.5) / 4294967296.0::double)"
