"""Lookups against a unique table when the looking side may repeat one key millions of times.

A sketch pass finds the keys that hold more than a given share of the rows (at most 1 / share of
them). Rows with such a key get a salt, the unique side is repeated per salt for these keys only,
and every other row is joined as usual. The sketch only decides where to put rows, so the result
does not depend on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Rows that one task sorts or groups at a time.
ROWS_PER_TASK = 500_000
SALT = "_salt"
SALTS = 1_024
HOT_SHARE = 0.001


def tasks_for(*tables: DataFrame) -> int:
    """Tasks that share the rows of the tables, so that a task's memory does not grow with them.

    Partitions of a stated number are not joined again by adaptive execution, whose bytes are those
    of compressed rows, and grouping after the shuffle holds no keys of a whole file split.
    """
    session = tables[0].sparkSession
    counts = [t.agg(F.count("*").alias("n")) for t in tables]
    rows = counts[0]
    for more in counts[1:]:
        rows = rows.union(more)
    n = rows.agg(F.sum("n")).first()[0]
    return max(session.sparkContext.defaultParallelism, -(-n // ROWS_PER_TASK))


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> Column:
    """Array of the values of `key` that may hold more than `share` of the rows."""
    most = int(1 / share)
    sketch = df.where(F.col(key).isNotNull()).agg(
        F.expr(f"approx_top_k(`{key}`, {most}, {most * 50})").alias("top"),
        F.count("*").alias("n"),
    )
    frequent = F.filter("top", lambda t: (t["count"] > F.col("n") * share) & (t["count"] > 1))
    return sketch.select(F.transform(frequent, lambda t: t["item"])).scalar()


def salt_rows(df: DataFrame, key: str, hot: Column, by: str, salts: int = SALTS) -> DataFrame:
    """Looking side: rows of hot keys are spread over `salts` values."""
    spread = F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")
    is_hot = F.array_contains(hot, F.col(key))
    return df.withColumn(SALT, F.when(is_hot, spread).otherwise(F.lit(0)))


def repeat_rows(df: DataFrame, key: str, hot: Column, salts: int = SALTS) -> DataFrame:
    """Unique side: rows of hot keys are repeated once per salt."""
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    is_hot = F.array_contains(hot, F.col(key))
    return df.withColumn(SALT, F.explode(F.when(is_hot, every).otherwise(F.array(F.lit(0)))))


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread_by: str,
    how: str = "left",
    hot: Column | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """`left` joined to `right`, which holds each key once; hot keys of `left` are salted.

    Pass `hot` when a cheaper table than `left` shows the same hot keys.
    """
    hot = hot_keys(left, key) if hot is None else hot
    return salt_rows(left, key, hot, spread_by, salts).join(
        repeat_rows(right, key, hot, salts), [key, SALT], how
    ).drop(SALT)
