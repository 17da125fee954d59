"""Operator 9: minimax contiguous partition of atomic groups into shards of nearly equal bytes.

Groups of equal texts are ordered by content hash.  The smallest feasible shard capacity is found by binary search;
each capacity is checked greedily on prefix sums, and the shards are cut where the greedy check cuts.
Prefix sums are computed in parallel: hash buckets, of which there are BUCKETS whatever the input, then inside each.
The driver never sees the groups: it searches a bounded table of prefix sums, which shrinks to the windows in which
the cuts can still lie and is read again there, finer each time, until the answer is exact.
DataFrame functions only.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, text_of

#: Hash buckets in which prefix sums run in parallel.
BUCKETS = 4096
#: Sub-groups that the rows of one group are dealt to, so that no task gets a large group whole.
SALTS = 256
#: Rows of the prefix table that the driver reads at once.
TABLE_ROWS = 50_000


class _Starts:
    """What is known of the sorted group starts: disjoint blocks (first, last start), exact where both are equal."""

    def __init__(self, blocks: list[tuple[int, int]], total: int):
        self.low, self.high, self.total = [b[0] for b in blocks], [b[1] for b in blocks], total

    def last_start(self, x: int, most: bool) -> int:
        """The largest start at or below x: an upper bound if `most`, else a lower bound."""
        if x >= self.total:
            return self.total
        i = bisect_right(self.low, x) - 1
        if self.high[i] <= x:
            return self.high[i]
        return x if most else self.low[i]

    def cuts(self, capacity: int, shards: int, most: bool) -> list[int]:
        out, at = [], 0
        for _ in range(shards):
            at = self.last_start(at + capacity, most)
            out.append(at)
        return out

    def feasible(self, capacity: int, shards: int, most: bool) -> bool:
        return self.cuts(capacity, shards, most)[-1] >= self.total

    def least(self, low: int, high: int, shards: int, most: bool) -> int:
        return low + bisect_left(range(low, high), True, key=lambda c: self.feasible(c, shards, most))


def minimax_cuts(starts: DataFrame, total: int, largest: int, shards: int, table_rows: int = TABLE_ROWS) -> list[int]:
    """The ends of the first shards - 1 shards, as group starts; `starts` has a column `start` of distinct group starts."""
    windows, blocks, width = [(0, total)], [], 2 * total
    while True:
        inside = F.lit(False)
        for a, b in windows:
            inside = inside | F.col("start").between(a, b)
        width = max(1, min(width // 2, sum(b - a + 1 for a, b in windows) // table_rows))  # finer each time
        rows = starts.filter(inside).groupBy(F.floor(F.col("start") / F.lit(width)).alias("block")).agg(F.min("start").alias("a"), F.max("start").alias("b")).collect()
        kept = [x for x in blocks if not any(a <= x[0] <= b or a <= x[1] <= b or x[0] <= a <= x[1] for a, b in windows)]
        blocks = sorted({*kept, *((r["a"], r["b"]) for r in rows)})
        known = _Starts(blocks, total)
        low = max(largest, -(-total // shards))
        high = low + largest + 1
        sure = known.least(low, high, shards, most=False)
        hoped = known.least(low, high, shards, most=True)
        if sure == hoped and known.cuts(sure, shards, False) == known.cuts(sure, shards, True):
            return known.cuts(sure, shards, False)[:-1]
        ends = zip(known.cuts(hoped, shards, False), known.cuts(sure, shards, True), strict=True)
        touched = {i for a, b in ends for i in range(max(0, bisect_right(known.low, a) - 1), bisect_right(known.low, b)) if known.low[i] < known.high[i]}
        spans: list[list[int]] = []
        for i in sorted(touched):
            if spans and spans[-1][2] == i - 1:
                spans[-1][1:] = [known.high[i], i]
            else:
                spans.append([known.low[i], known.high[i], i])
        windows = [(a, b) for a, b, _ in spans]


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row; equal texts share a shard.

    Null texts are equal to empty ones.  The largest shard is as small as whole groups in hash order allow; shards may
    be empty when groups are few.  Slots follow hash order, then doc_id (nulls first); repeated rows get slots of their own.
    """
    spark = docs.sparkSession
    text = text_of()
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("sig"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    bucket = F.conv(F.substring(F.hex("sig"), 1, 3), 16, 10).cast("int")
    cells = stage(rows.groupBy("sig", "size", "salt").agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", bucket), "cells")
    sums = sorted((r["bucket"], r["n"], r["bytes"]) for r in cells.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("bytes")).collect())
    before, n_before, bytes_before = [], 0, 0
    for b, n, size in sums:
        before.append((b, n_before, bytes_before))
        n_before, bytes_before = n_before + n, bytes_before + size
    schema = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"
    if not sums:
        return spark.createDataFrame([], schema)
    offsets = F.broadcast(spark.createDataFrame(before, "bucket int, n_before long, bytes_before long"))

    order = Window.partitionBy("bucket").orderBy("sig", "size")
    group = Window.partitionBy("bucket", "sig", "size")
    so_far = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cell_order = Window.partitionBy("bucket").orderBy("sig", "size", "salt").rowsBetween(Window.unboundedPreceding, -1)
    held = F.col("n") * F.col("size")
    placed = cells.select("*", F.sum(held).over(so_far).alias("end"), F.sum(held).over(group).alias("bytes"), F.coalesce(F.sum("n").over(cell_order), F.lit(0)).alias("n_here"))
    placed = placed.join(offsets, "bucket").select("sig", "size", "salt", "bytes", (F.col("bytes_before") + F.col("end") - F.col("bytes")).alias("start"), (F.col("n_before") + F.col("n_here")).alias("place"))
    placed = stage(placed, "placed")
    largest = placed.agg(F.max("bytes")).first()[0]
    cuts = minimax_cuts(placed.select("start").distinct(), bytes_before, largest, shards)

    shard = F.lit(0)
    for cut in cuts:
        shard = shard + F.when(F.col("start") >= F.lit(cut), 1).otherwise(0)
    placed = placed.select("sig", "size", "salt", "place", shard.cast("int").alias("shard"))
    first = spark.createDataFrame([(r["shard"], r["place"]) for r in placed.groupBy("shard").agg(F.min("place").alias("place")).collect()], "shard int, first long")
    placed = placed.join(F.broadcast(first), "shard")
    within = Window.partitionBy("sig", "size", "salt").orderBy("doc_id")
    met = rows.join(placed, ["sig", "size", "salt"]).withColumn("rank", F.row_number().over(within))
    return met.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
