"""Joins and running sums that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.session import checkpointed

# A key is hot when it holds at least this share of all rows, so there are at
# most 1 / HOT_SHARE hot keys and a table of them is always small.
HOT_SHARE = 1e-4
HOT_MIN_ROWS = 1_000_000
BROADCAST_ROWS = 1_000_000
SALTS = 64


def hot_keys(df: DataFrame, keys: Sequence[str], share: float = HOT_SHARE,
             min_rows: int = HOT_MIN_ROWS) -> DataFrame | None:
    """Keys holding at least `share` of the rows (and `min_rows`), or None when there are none."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    total, largest = counts.agg(F.sum("_rows"), F.max("_rows")).first()
    floor = max(min_rows, int((total or 0) * share))
    if not total or largest < floor:
        return None
    hot = counts.filter(F.col("_rows") >= floor).select(*keys)
    return df.sparkSession.createDataFrame(hot.collect(), hot.schema)


def split_hot(df: DataFrame, keys: Sequence[str], min_rows: int = HOT_MIN_ROWS,
              counted_on: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary keys, and rows of hot keys (None when no key is hot).

    `counted_on` is a cheaper table with the same keys, such as the rows before a window.
    """
    hot = hot_keys(df if counted_on is None else counted_on, keys, min_rows=min_rows)
    if hot is None:
        return df, None
    few = F.broadcast(hot)
    return df.join(few, list(keys), "left_anti"), df.join(few, list(keys), "left_semi")


def lookup_join(fact: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "left",
                broadcast_rows: int = BROADCAST_ROWS, salts: int = SALTS,
                hot_rows: int | None = HOT_MIN_ROWS) -> DataFrame:
    """Join a lookup with unique `keys` to a skewed fact table.

    The lookup is broadcast when its counted size is within `broadcast_rows`. Beyond
    that both sides shuffle, and the hot keys of the fact are spread over `salts`. With
    `hot_rows` None the fact is not counted first and splitting is left to the adaptive
    skew join. A semi join may have repeated keys in the lookup.
    """
    keys = list(keys)
    lookup = lookup.persist()
    if lookup.count() <= broadcast_rows:
        return fact.join(F.broadcast(lookup), keys, how)
    hot = None if hot_rows is None else hot_keys(fact, keys, min_rows=hot_rows)
    if hot is None:
        return fact.join(lookup, keys, how)
    flags = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    spread = F.when(F.col("_hot"), F.pmod(F.xxhash64(*fact.columns), F.lit(salts))).otherwise(F.lit(0))
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = fact.join(flags, keys, "left").withColumn("_salt", spread.cast("int")).drop("_hot")
    right = lookup.join(flags, keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right, keys + ["_salt"], how).drop("_salt")


def running_before(df: DataFrame, order_by: Sequence[str], sums: Sequence[str],
                   within: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """Add `before_<c>`: the sum of c over the rows that precede this one in its `within` group.

    Rows must be distinct on `within` + `order_by`. The order is cut into ranges, so a
    group of any size spans as many tasks as it needs; each range is summed on its own
    and the sums of the ranges before it are added. The range number is checkpointed
    because both steps have to see the same cut. At most one group per range started
    in an earlier range, which bounds the broadcast offsets by the number of ranges.
    """
    within, order_by = list(within), list(order_by)
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(
        df.repartitionByRange(n, *within, *order_by).withColumn("_range", F.spark_partition_id()))
    earlier = W.partitionBy(*within).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = (ranged.groupBy(*within, "_range").agg(*[F.sum(c).alias(c) for c in sums])
               .select(*within, "_range", *[F.sum(c).over(earlier).alias(f"_offset_{c}") for c in sums])
               .filter(F.col(f"_offset_{sums[0]}").isNotNull()))
    inside = W.partitionBy(*within, "_range").orderBy(*order_by).rowsBetween(W.unboundedPreceding, -1)
    local = ranged.select("*", *[F.sum(c).over(inside).alias(f"_local_{c}") for c in sums])
    joined = local.join(F.broadcast(offsets), within + ["_range"], "left")
    zero = F.lit(0)
    return joined.select(*df.columns, *[
        (F.coalesce(f"_local_{c}", zero) + F.coalesce(f"_offset_{c}", zero)).alias(f"before_{c}") for c in sums])
