"""A join that no frequent key can slow: what is told of such keys is broadcast, and there are few of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key is frequent when more than one in so many of the counted rows have it; so there are fewer frequent keys than this.
FEW = 1000


def with_facts(rows: DataFrame, key: str, facts: DataFrame, count: str, spread: list[str]) -> DataFrame:
    """``rows`` left-joined with ``facts``: one row for each value of the string column ``key``, which ``count`` of the rows have.  Rows whose
    key is null or frequent go to tasks by their columns ``spread``.  ``facts`` should be a written table: it is read three times."""
    named = [c for c in facts.columns if c not in (key, count)]
    total = facts.agg(F.sum(count)).first()[0] or 0
    hot = facts.filter(F.col(count) * FEW > total).select(F.col(key).alias("_hot"), *(F.col(c).alias(f"_hot_{c}") for c in named))
    rest = facts.filter(F.col(count) * FEW <= total).select(F.col(key).alias("_key"), *(F.col(c).alias(f"_rest_{c}") for c in named))
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    elsewhere = F.concat(F.lit("-"), F.xxhash64(*spread).cast("string"))
    out = out.withColumn("_at", F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(elsewhere))
    out = out.join(rest, F.col("_at") == F.col("_key"), "left")
    return out.select(*rows.columns, *(F.coalesce(f"_hot_{c}", f"_rest_{c}").alias(c) for c in named))
