"""Where queries and their SQL are put under their names."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:  # small literals are 32-bit in SQL, ids are not
            SQL[name] = re.sub(r"\b(1000000000|2000000000|100000000|0(?= AS sample_id))\b", r"CAST(\1 AS BIGINT)", sql)
        return f

    return put


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})
