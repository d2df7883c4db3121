"""As-of join: for each row the last row of the other side before it, in its own key.

Both sides are put in one line by key and order, and the last value is carried along.  The line is cut by range into
stretches of even size, so a key that holds a third of all rows is spread over many; what a stretch ends with is
carried into the next ones of its key through a small table: only keys that a cut goes through are in it, at most two rows a cut.
Nothing is paired and then filtered.

Defined cases: rows without a key or an order find nothing and are found by none; at equal orders the other side counts if
``equal`` says so; of its rows at one order the greatest ``tie`` is the last; rows that find nothing keep null values;
repeated rows each find theirs; an empty other side gives null values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import cut


def last_before(rows: DataFrame, events: DataFrame, key: str, order: str, values: Sequence[str], tie: str | None = None, equal: bool = False, stretches: int | None = None) -> DataFrame:
    """rows with the ``values`` of the last of events (key, order, values[, tie]) before each, null where there is none."""
    spark = rows.sparkSession
    n = stretches or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = [c for c in rows.columns if c not in values]
    usable = F.col(key).isNotNull() & F.col(order).isNotNull()
    side = F.lit(0 if equal else 2)  # events first at an equal order if those count
    asks = rows.filter(usable).select(F.col(key).alias("_k"), F.col(order).alias("_o"), F.lit(1).alias("_s"), F.struct(*own).alias("_row"), F.lit(None).cast(events.select(F.struct(*values)).schema[0].dataType).alias("_v"), F.lit(None).cast(events.schema[tie or order].dataType).alias("_t"))
    told = events.filter(usable).select(F.col(key).alias("_k"), F.col(order).alias("_o"), side.alias("_s"), F.lit(None).cast(asks.schema["_row"].dataType).alias("_row"), F.struct(*values).alias("_v"), F.col(tie or order).alias("_t"))
    line = cut(asks.unionByName(told).repartitionByRange(n, "_k", "_o").withColumn("_p", F.spark_partition_id()))
    here = W.partitionBy("_p", "_k").orderBy("_o", "_s", "_t").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = line.withColumn("_last", F.last("_v", ignorenulls=True).over(here)).filter("_row is not null")
    ends = line.groupBy("_k", "_p").agg(F.max(F.when(F.col("_v").isNotNull(), F.struct("_o", "_t", "_v"))).alias("_e"))
    cutted = ends.groupBy("_k").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_k")
    before = W.partitionBy("_k").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    # keys that lie in more than one stretch: at most one ends and one begins at each cut
    carried = ends.join(F.broadcast(cutted), "_k", "left_semi").withColumn("_c", F.last("_e._v", ignorenulls=True).over(before)).select(F.col("_k").alias("_ck"), F.col("_p").alias("_cp"), "_c")
    joined = found.join(F.broadcast(carried), (F.col("_k") == F.col("_ck")) & (F.col("_p") == F.col("_cp")), "left")
    done = joined.withColumn("_w", F.coalesce("_last", "_c")).select("_row.*", *(F.col(f"_w.{v}").alias(v) for v in values))
    none = rows.filter(~usable).select(*own, *(F.lit(None).cast(events.schema[v].dataType).alias(v) for v in values))
    return done.unionByName(none)
