"""Joins against small or per-application tables that stay balanced when one application is hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALT = "_salt"


def spread_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", spread: Sequence[str] = (), ways: int = 16
) -> DataFrame:
    """Join on `on`, with each key's left rows spread over `ways` tasks by the `spread` columns.

    Every right row is repeated once per salt value, so each left row still meets exactly the right rows of its key.
    No broadcast is forced: while the right side is below the session's broadcast limit Spark picks that by size and
    beyond it the shuffle is on (key, salt). Right must be small per key (a per-application or per-executor table).
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"join type {how!r} would repeat right rows")
    salted_left = left.withColumn(SALT, F.pmod(F.xxhash64(*spread), F.lit(ways)))
    salted_right = right.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(ways - 1)).cast("array<bigint>")))
    return salted_left.join(salted_right, [*on, SALT], how).drop(SALT)
