"""Packing under a character budget."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lineage import cut


def first_fit(items: Column, cost: Callable[[Column], Column], budget: Column | int, separator: int = 0) -> Column:
    """The items of an ordered array that fit: one that does not is passed over and takes nothing.

    separator: extra cost of every item after the first.
    """
    budget = F.lit(budget) if isinstance(budget, int) else budget
    start = F.struct(F.lit(0).cast("long").alias("used"), F.slice(items, 1, 0).alias("took"))

    def step(acc: Column, x: Column) -> Column:
        price = cost(x).cast("long") + F.when(F.size(acc["took"]) > 0, separator).otherwise(0)
        fits = acc["used"] + price <= budget
        return F.struct(F.when(fits, acc["used"] + price).otherwise(acc["used"]).alias("used"), F.when(fits, F.array_append(acc["took"], x)).otherwise(acc["took"]).alias("took"))

    return F.aggregate(items, start, step, lambda acc: acc["took"])


#: Candidates of a group that one task passes through; larger groups are packed in rounds over many tasks first.
TASK_ROWS = 200_000


def _sequential(rows: DataFrame, own: list[str], order: list[Column]) -> DataFrame:
    """own columns and pack_rank of what fits: rows carry _g, _cost, _left and _rank (taken before).

    A group passes through its task in order, batch by batch, and only what is left is kept of it.
    """
    dealt = rows.select(*own, "_g", "_cost", "_left", "_rank").repartition("_g").sortWithinPartitions("_g", *order)
    schema = T.StructType([*(dealt.schema[c] for c in own), T.StructField("pack_rank", T.IntegerType())])
    n = len(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, left, count = None, 0, 0
        for batch in batches:
            names, prices, lefts, ranks = (batch.column(n + k).to_pylist() for k in range(4))
            took, places = [], []
            for i, name in enumerate(names):
                if name != group:
                    group, left, count = name, lefts[i], ranks[i]
                if prices[i] <= left:
                    left, count = left - prices[i], count + 1
                    took.append(i)
                    places.append(count)
            kept = batch.take(pa.array(took, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns[:n], pa.array(places, pa.int32())], schema.names)

    return dealt.mapInArrow(run, schema)


def running(rows: DataFrame, order: list[Column], value: str, into: str = "_run") -> DataFrame:
    """rows (with _g, _p) with the running sum of value in each _g; _p numbers stretches that hold a range of the order each.

    Stretches sum side by side; what lies before a stretch comes from a row a stretch and group.
    """
    inside = W.partitionBy("_p", "_g").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy("_tg").orderBy("_tp").rowsBetween(W.unboundedPreceding, -1)
    ends = rows.groupBy(F.col("_p").alias("_tp"), F.col("_g").alias("_tg")).agg(F.sum(value).alias("_sum"))
    ends = ends.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    summed = rows.withColumn(into, F.sum(value).over(inside)).join(ends, (F.col("_p") == F.col("_tp")) & (F.col("_g") == F.col("_tg")))
    return summed.withColumn(into, F.col(into) + F.col("_before")).drop("_tp", "_tg", "_before")


def stretched(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows (with _g) dealt out by ranges of group and order, stored, with _p, the number of the range."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartitionByRange(n, "_g", *order).withColumn("_p", F.spark_partition_id()))


def pack_groups(rows: DataFrame, keys: list[str], order: list[Column], cost: Column, budget: Column | int, separator: int = 0, task_rows: int = TASK_ROWS) -> DataFrame:
    """rows that fit their group's budget in order, with pack_rank, their place in it; costs are not negative, order is total in a group.

    Groups of up to task_rows candidates pass through a task each.  Larger ones are packed in rounds, exactly: of the candidates
    (what fits the rest at all) the longest run from the first one whose sum fits is taken, by running sums over stretches of the
    order; what follows it did not fit, so the rest shrinks below it and most candidates go, until few are left.
    """
    own = rows.columns
    limit = F.lit(budget) if isinstance(budget, int) else budget
    # a separator before every item but the first is one behind every item with one more to spend
    some = rows.withColumns({"_cost": cost.cast("long") + separator, "_left": limit.cast("long") + separator, "_g": F.struct(*keys), "_rank": F.lit(0)}).filter("_cost <= _left")
    if some.groupBy("_g").count().filter(F.col("count") > task_rows).isEmpty():
        return _sequential(some, own, order)
    line, taken, finished = stretched(some, order), [], []
    while True:
        size = line.groupBy(F.col("_g").alias("_h")).count()
        sized = line.join(size, F.col("_g") == F.col("_h")).drop("_h")
        finished.append(sized.filter(F.col("count") <= task_rows))
        large = sized.filter(F.col("count") > task_rows).drop("count")
        if large.isEmpty():
            break
        summed = running(large.withColumn("_one", F.lit(1).cast("long")), order, "_cost")
        fits = running(summed.filter("_run <= _left"), order, "_one", "_n")
        fits = cut(fits.withColumn("pack_rank", (F.col("_rank") + F.col("_n")).cast("int")))
        taken.append(fits.select(*own, "pack_rank"))
        last = fits.groupBy(F.col("_g").alias("_h")).agg(F.max("_run").alias("_spent"), F.max("pack_rank").alias("_now"))
        rest = summed.filter("_run > _left").drop("_run", "_one").join(last, F.col("_g") == F.col("_h"))
        line = cut(rest.withColumns({"_left": F.col("_left") - F.col("_spent"), "_rank": F.col("_now")}).filter("_cost <= _left").select(*line.columns))
    out = reduce(DataFrame.unionByName, taken) if taken else None
    more = _sequential(reduce(DataFrame.unionByName, finished), own, order)
    return more if out is None else out.unionByName(more)


def stop_at_overflow(rows: DataFrame, keys: list[str], order: list[Column], cost: Column, budget: int, spread: bool = False) -> DataFrame:
    """rows up to the first that would go over the budget: a running sum, no array; spread: over stretches, for groups of any size."""
    if spread:
        line = stretched(rows.withColumns({"_g": F.struct(*keys), "_cost": cost.cast("long")}), order)
        return running(line, order, "_cost").filter(F.col("_run") <= budget).select(rows.columns)
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("_used", F.sum(cost).over(w)).filter(F.col("_used") <= budget).drop("_used")
