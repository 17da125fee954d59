"""Operator 8: exact duplicates by a 128-bit content hash, with the bytes compared inside each group.

DataFrame functions only.  Map-side aggregation collapses copies before the one shuffle of texts, so a group that
holds a third of all rows costs a row per task.  Grouping on (hash, text) compares the bytes: texts that collide on
the hash fall into different classes.  Documents then meet their class on narrow keys, hot classes by broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, join_counted, stage, text_of, without_white


def _hash128(norm: Column) -> Column:
    return F.unhex(F.md5(norm.cast("binary")))


def _sha256(norm: Column) -> Column:
    return F.unhex(F.sha2(norm.cast("binary"), 256))


def classes(docs: DataFrame) -> DataFrame:
    """sig, sha, n, keep_id, best_chars for each class of texts that are equal without white space.

    The row with the most code points stays, then the smallest doc_id; a null doc_id loses ties.
    """
    norm = without_white(text_of())
    rows = docs.select("doc_id", F.char_length(text_of()).alias("chars"), norm.alias("norm")).withColumn("sig", _hash128(F.col("norm")))
    best = F.max(F.struct("chars", F.bitwise_not("doc_id").alias("id")))
    groups = rows.groupBy("sig", "norm").agg(F.count(F.lit(1)).alias("n"), best.alias("best"))
    return groups.select("sig", _sha256(F.col("norm")).alias("sha"), "n", F.bitwise_not("best.id").alias("keep_id"), F.col("best.chars").alias("best_chars"))


def _classified(docs: DataFrame) -> DataFrame:
    """doc_id, sig, sha, chars, n, keep_id, best_chars of every row."""
    found = stage(classes(docs), "classes")
    total = found.agg(F.sum("n")).first()[0] or 0
    norm = without_white(text_of())
    rows = docs.select("doc_id", F.char_length(text_of()).alias("chars"), norm.alias("norm")).select("doc_id", "chars", _hash128(F.col("norm")).alias("sig"), _sha256(F.col("norm")).alias("sha"))
    return join_counted(rows, found.select("sig", "sha", "n", "keep_id", "best_chars"), ["sig", "sha"], "n", total, "doc_id")


def exact_classes(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row, dropped ones too.

    Null texts count as empty and are equal to texts of white space alone; texts of any length are read whole.  Rows that
    share doc_id and class share the decision.  A null doc_id is kept only where its class has no other row (keep_id null
    then).  An empty table gives no rows; other columns are not read, so their names may clash with ours.
    """
    met = _classified(docs)
    return met.select("doc_id", "keep_id", F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def filter_rows(docs: DataFrame, decided: DataFrame, tags: list[str], tagged: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """The rows of `docs`, in its columns, that narrow decisions keep.

    decided: doc_id, the tags, which tell texts apart, and keep, a row for each row of docs.  A doc_id of one row is
    decided by itself, so documents meet only the ids to leave out.  Rows that share a doc_id, or have none, are judged by
    their tags, which tagged(rows, names) adds under the given names; of those alike one stays, the first by text.
    """
    decided = stage(decided, "decided")
    ids = decided.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and("keep").alias("keep")).filter("n > 1 or not keep")
    ids = stage(ids.select("doc_id", "n"), "ids")
    key = fresh(docs, "__id")
    others = docs.join(ids.select(F.col("doc_id").alias(key)), docs["doc_id"] == F.col(key), "left_anti").filter(docs["doc_id"].isNotNull())
    shared = ids.filter("n > 1").select(F.col("doc_id").alias(key))
    if shared.isEmpty() and decided.filter("doc_id is null").isEmpty():
        return others
    loose = docs.join(shared, docs["doc_id"] == F.col(key), "left_semi").union(docs.filter("doc_id is null"))
    names = [fresh(docs, f"__t{i}") for i in range(len(tags))]
    keepers = decided.filter("keep").select("doc_id", *tags).distinct().toDF(key, *[f"{n}k" for n in names])
    loose = tagged(loose, names)
    on = [loose["doc_id"].eqNullSafe(keepers[key]), *(loose[n].eqNullSafe(keepers[f"{n}k"]) for n in names)]
    met = loose.join(keepers, on, "left_semi")
    n = fresh(met, "__n")
    first = Window.partitionBy("doc_id", *names).orderBy("text")
    return others.union(met.withColumn(n, F.row_number().over(first)).filter(F.col(n) == 1).select(*[met[f"`{c}`"] for c in docs.columns]))


def drop_copies(docs: DataFrame) -> DataFrame:
    """One row of each class, with all columns of `docs`: the row with the most code points, then the smallest doc_id.

    Null texts count as empty.  Of repeated rows one stays; rows that share a doc_id but not a class are judged apart; a
    null doc_id loses ties.  An empty table stays empty; other columns may have any names.
    """
    met = _classified(docs)
    keep = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("best_chars"))

    def tagged(rows: DataFrame, names: list[str]) -> DataFrame:
        norm = without_white(text_of())
        return rows.withColumns(dict(zip(names, (_hash128(norm), _sha256(norm), F.char_length(text_of())), strict=True)))

    return filter_rows(docs, met.select("doc_id", "sig", "sha", "chars", keep.alias("keep")), ["sig", "sha", "chars"], tagged)


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
g AS (
  SELECT norm, count(*) AS n, arg_min(doc_id, (-chars, doc_id)) AS keep_id FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.n AS group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
"""
