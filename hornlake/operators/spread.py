"""Joins whose result can grow with the product of their sides, dealt out evenly."""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pairs of a key that one block makes.  A key with more is cut into blocks, however few keys there are.
PAIRS = 1 << 24
#: Tasks of one join at most; beyond them a task takes several blocks.
TASKS = 1 << 15
#: Keys with several blocks that are fetched; more of them are counted again where they are broadcast.
FETCHED = 10_000


def _tasks(df: DataFrame) -> int:
    """A number of partitions that adaptive execution, which knows the size of what they read only, leaves alone."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def _tasks_for(df: DataFrame, pairs: float) -> int:
    """Two for each block of `pairs`, so that few blocks meet in a task and the longest one does not grow with the pairs."""
    return max(_tasks(df), min(TASKS, 2 * ceil(pairs / PAIRS)))


def _dealt(df: DataFrame, own: Column, other: Column, at: str, to: str) -> DataFrame:
    """Each row in one of `own` parts, `other` times."""
    code = F.xxhash64(*(F.col(c) for c in df.columns)) if df.columns else F.lit(0)
    rows = df.withColumn(at, F.pmod(code, own.cast("long")).cast("int"))
    return rows.withColumn(to, F.explode(F.sequence(F.lit(0), other.cast("int") - 1)))


def spread_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """An inner join where a key may repeat on both sides: n and m rows of a key meet in blocks of about PAIRS pairs.

    The exact counts are taken while the query is built, as the number of tasks follows the number of pairs.  A key with k
    blocks deals its rows about sqrt(k n m) times on each side; only keys with several blocks are broadcast.
    """
    whole = {"byte", "short", "integer", "long"}
    for c in on:
        types = {df.schema[c].dataType.typeName() for df in (left, right)}
        if len(types) > 1 and types <= whole:
            left, right = left.withColumn(c, F.col(c).cast("long")), right.withColumn(c, F.col(c).cast("long"))
        elif len(types) > 1:
            return left.join(right, on)
    n, m = F.col("__n").cast("double"), F.col("__m").cast("double")
    both = left.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")).join(right.groupBy(*on).agg(F.count(F.lit(1)).alias("__m")), on)
    pairs, several = both.agg(F.coalesce(F.sum(n * m), F.lit(0.0)), F.count_if(n * m > PAIRS)).first()
    if pairs <= PAIRS:
        return left.join(right, on)
    tasks = _tasks_for(left, pairs)
    if not several:
        return left.repartition(tasks, *on).join(right.repartition(tasks, *on), on)
    hot = both.where(n * m > PAIRS).withColumn("__k", F.ceil(n * m / PAIRS))
    hot = hot.withColumn("__a", F.least(F.col("__k"), F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("__k") * n / m)))))
    hot = hot.select(*on, F.col("__a").cast("int"), F.ceil(F.col("__k") / F.col("__a")).cast("int").alias("__b"))
    if several <= FETCHED:
        hot = left.sparkSession.createDataFrame(hot.collect(), hot.schema)
    hot = F.broadcast(hot)

    def dealt(df: DataFrame, own: str, other: str, at: str, to: str) -> DataFrame:
        rows = df.join(hot, on, "left")
        rows = _dealt(rows, F.coalesce(F.col(own), F.lit(1)), F.coalesce(F.col(other), F.lit(1)), at, to)
        return rows.select(*df.columns, "__i", "__j").repartition(tasks, *on, "__i", "__j")

    keys = [*on, "__i", "__j"]
    return dealt(left, "__a", "__b", "__i", "__j").join(dealt(right, "__b", "__a", "__j", "__i"), keys).drop("__i", "__j")


def crossed(left: DataFrame, right: DataFrame) -> DataFrame:
    """A product in blocks of about PAIRS pairs, each an equi-join's; a single block's is a product whose sides are in enough partitions."""
    n, m = left.count(), right.count()
    if n * m <= PAIRS:
        return left.repartition(_tasks(left)).crossJoin(right.repartition(_tasks(right)))
    k = ceil(n * m / PAIRS)
    a = min(k, max(1, ceil(sqrt(k * n / m))))
    b, tasks = ceil(k / a), _tasks_for(left, n * m)
    keys = ["__i", "__j"]
    left, right = _dealt(left, F.lit(a), F.lit(b), "__i", "__j"), _dealt(right, F.lit(b), F.lit(a), "__j", "__i")
    return left.repartition(tasks, *keys).join(right.repartition(tasks, *keys), keys).drop(*keys)


#: Bytes of the largest table read for each task that makes a join's rows distinct.
BYTES = 4 << 20


def distinct_rows(df: DataFrame) -> DataFrame:
    """distinct() in a number of tasks that grows with the input, so the memory of one does not."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    largest = max((int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())), default=0)
    wanted = largest // BYTES if largest < 1 << 50 else 0  # Spark's word for an unknown size is larger
    return df.repartition(max(_tasks(df), min(wanted, 1 << 13)), *df.columns).distinct()
