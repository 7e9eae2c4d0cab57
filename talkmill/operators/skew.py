"""Joins that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most this many keys are hot; the side that is broadcast has no more rows than this.
MOST_HOT = 1000


def lookup_join(rows: DataFrame, dim: DataFrame, key: str, how: str = "inner", count_col: str = "n", most_hot: int = MOST_HOT, total: int | None = None) -> DataFrame:
    """``rows`` joined with ``dim``, which has one row a ``key`` and in ``count_col`` how many of ``rows`` have it.

    Keys that hold more than 1/most_hot of all counted rows are at most ``most_hot`` in number: their part of
    ``dim`` is broadcast and their rows never shuffle. All other keys go through an ordinary shuffle join, in
    which no key has more than that share. ``how``: inner or left. Rows with a null key match nothing. ``total`` is how
    many rows are counted, or more, where that is known already.
    """
    total = dim.agg(F.coalesce(F.sum(count_col), F.lit(0))).first()[0] if total is None else total
    limit = max(total / most_hot, 10_000)
    values = [c for c in dim.columns if c not in (key, count_col)]
    hot = dim.filter(F.col(count_col) > limit).select(key, F.struct(*values).alias("_hot"))
    cold = dim.filter(F.col(count_col) <= limit).select(key, F.struct(*values).alias("_cold"))
    if total <= limit:  # no key can be hot
        out = rows.join(cold, key, how)
        return out.select(*rows.columns, *[F.col(f"_cold.{v}").alias(v) for v in values])
    marked = rows.join(F.broadcast(hot), key, "left")
    # A hot row gets a null key for the second join, which sends it nowhere near the others' partition.
    second = marked.withColumn("_k", F.when(F.col("_hot").isNull(), F.col(key)))
    spread = F.when(F.col("_k").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(997)).cast("int")).otherwise(F.lit(-1))
    out = second.withColumn("_s", spread).join(cold.withColumnRenamed(key, "_k").withColumn("_s", F.lit(-1)), ["_k", "_s"], "left")
    out = out.withColumn("_v", F.coalesce("_hot", "_cold"))
    if how == "inner":
        out = out.filter(F.col("_v").isNotNull())
    return out.select(*rows.columns, *[F.col(f"_v.{v}").alias(v) for v in values])
