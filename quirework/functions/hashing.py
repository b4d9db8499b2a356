"""Hashes that come out alike in every engine, run and layout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 2**32


def position(*parts: Column | str, salt: str = "408") -> Column:
    """The first 32 bits of SHA-256 over salt and parts, joined by ':'; null if a part is null."""
    texts = [F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]
    joined = F.concat(F.lit(salt), *(F.concat(F.lit(":"), t) for t in texts))
    return F.conv(F.substring(F.sha2(joined, 256), 1, 8), 16, 10).cast("bigint")


def position_sql(*parts: str, salt: str = "408") -> str:
    """The same in DuckDB's SQL."""
    return f"('0x' || substr(sha256('{salt}'" + "".join(f" || ':' || CAST({p} AS VARCHAR)" for p in parts) + "), 1, 8))::BIGINT"
