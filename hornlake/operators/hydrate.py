"""Bindings with whole entities in place of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import named


def hydrated(df: DataFrame, entities: dict, table) -> DataFrame:
    """Each column of a known entity type becomes a struct: `pk`, then the entity's columns, null if there is none."""
    out = df
    for name in df.columns:
        if (entity := entities.get(name)) is None:
            continue
        rows = table(entity)
        side = rows.select(named(entity.key).alias(f"__{name}"), F.struct(*map(named, rows.columns)).alias(f"__{name}_row"))
        out = out.join(side, F.col(name) == F.col(f"__{name}"), "left")
    shown = []
    for name in df.columns:
        if (entity := entities.get(name)) is None:
            shown.append(F.col(name))
        else:
            fields = [F.col(f"__{name}_row")[c].alias(c) for c in table(entity).columns if c != "pk"]
            shown.append(F.struct(F.col(name).alias("pk"), *fields).alias(name))
    return out.select(*shown)
