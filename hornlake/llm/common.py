"""Helpers shared by the training-data operators: staged tables, skew-proof joins, text batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import storage
from ..sources.storage import new_dir, release, shared_dir  # noqa: F401  the operators' way to the shared folder

#: A key is hot when it holds at least 1/HOT of all rows, so there are at most HOT hot keys.
HOT = 1000

#: The ASCII white space that the contracts name, `[\x20\x09-\x0D]`.
WHITE = " \t\n\x0b\x0c\r"


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends there, and a lost executor costs one read."""
    path, out = storage.stage(df, name, codec)
    out._staged = path  # noqa: SLF001
    return out


def stage_counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """stage(), and the number of rows, which the write itself counts."""
    path, out, n = storage.stage_counted(df, name)
    out._staged = path  # noqa: SLF001
    return out, n


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing will read again."""
    storage.delete(df.sparkSession, df._staged)  # noqa: SLF001


def text_of(name: str = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` has it; names are compared without case, as Spark does."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def without_white(column: Column) -> Column:
    return F.translate(column, WHITE, "")


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], n: str, total: int, spread: str) -> DataFrame:
    """Left join where `right` is unique by `keys` and its column `n` counts the rows of `left` that have the key.

    Keys with at least total/HOT rows, at most HOT of them whatever the input, are broadcast;
    rows that matched one are spread over all partitions by column `spread`; the others meet by shuffle.
    """
    payload = [c for c in right.columns if c not in keys]
    is_hot = F.col(n) * HOT >= F.lit(max(1, total))
    hot = right.filter(is_hot).select(*keys, F.struct(*payload).alias("__hot"))
    cold = right.filter(~is_hot).select(*keys, F.lit(0).cast("long").alias("__spread"), F.struct(*payload).alias("__cold"))
    away = F.pmod(F.xxhash64(F.col(spread)), F.lit(1 << 30)) + 1
    met = left.join(F.broadcast(hot), keys, "left").withColumn("__spread", F.when(F.col("__hot").isNull(), F.lit(0).cast("long")).otherwise(away))
    met = met.join(cold, [*keys, "__spread"], "left")
    both = F.coalesce(F.col("__hot"), F.col("__cold"))
    return met.select(*left.columns, *[both[c].alias(c) for c in payload])
