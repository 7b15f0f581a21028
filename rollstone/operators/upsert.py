"""Writes as joins: Parquet has no MERGE, so a new version of a table is computed and swapped in after it succeeded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: list[str], now: Column, only_new: bool = False) -> DataFrame:
    """old with new's rows put in by key; old's columns, created_at and updated_at included.

    A supplied column replaces the stored one, also by null; columns that new lacks keep their value. A new key gets created_at and updated_at now, a changed row updated_at,
    an unchanged one nothing. Of several new rows with one key the largest counts (by all columns); old rows are made unique likewise. Null keys are equal to each other.
    only_new: stored keys aren't changed.
    """
    cols = [c for c in old.columns if c not in (*key, "created_at", "updated_at")]
    supplied = [c for c in cols if c in new.columns]
    # every aggregate is one struct, so a row isn't mixed from several
    one = lambda df, cs, s: df.groupBy(*key).agg(F.max(F.struct(*(F.struct(F.col(c).isNotNull().alias("known"), F.col(c).alias("v")).alias(c) for c in cs), F.lit(1))).alias(s)) if cs else df.select(*key).distinct().withColumn(s, F.lit(None))
    stored = one(old, [*cols, "created_at", "updated_at"], "o").select(*(F.col(k).alias(f"_o_{k}") for k in key), F.lit(True).alias("_old"), *(F.col(f"o.{c}.v").alias(f"_o_{c}") for c in [*cols, "created_at", "updated_at"]))
    given = one(new, supplied, "n").select(*(F.col(k).alias(f"_n_{k}") for k in key), F.lit(True).alias("_new"), *(F.col(f"n.{c}.v").alias(f"_n_{c}") for c in supplied))
    on = None
    for k in key:
        c = F.col(f"_o_{k}").eqNullSafe(F.col(f"_n_{k}"))
        on = c if on is None else on & c
    both = stored.join(given, on, "full")
    is_old, is_new = F.coalesce("_old", F.lit(False)), F.coalesce("_new", F.lit(False))
    takes = is_new & ~is_old if only_new else is_new
    changed = F.lit(False)
    for c in supplied:
        changed = changed | ~F.col(f"_o_{c}").eqNullSafe(F.col(f"_n_{c}"))
    value = lambda c: F.when(takes, F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")) if c in supplied else F.col(f"_o_{c}")
    created = F.when(is_old, F.col("_o_created_at")).otherwise(now)
    updated = F.when(takes & is_old & changed, now).when(is_old, F.col("_o_updated_at")).otherwise(now)
    out = {k: F.coalesce(f"_o_{k}", f"_n_{k}") for k in key} | {c: value(c) for c in cols} | {"created_at": created, "updated_at": updated}
    return both.select(*(out[c].alias(c) for c in old.columns))


def update_where(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Rows for which the condition holds get the values; a null condition doesn't hold."""
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition doesn't hold; where it is null they stay."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def pull(df: DataFrame, column: str, value: Column, condition: Column | None = None) -> DataFrame:
    """The list column without a value, in rows for which the condition holds."""
    gone = F.array_remove(column, value)
    return df.withColumn(column, gone if condition is None else F.when(condition, gone).otherwise(F.col(column)))


def cascade(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of child whose parent still exists; a null key has no parent."""
    return child.join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_semi")


def pull_missing(df: DataFrame, key: str, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """The list column reduced to values whose parent exists, in their order; empty lists stay."""
    each = df.select(key, F.posexplode(column).alias("_i", "_v")).join(parent.select(F.col(parent_key).alias("_v")).distinct(), "_v", "left_semi")
    kept = each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda x: x["_v"]).alias("_kept"))
    empty = F.array().cast(df.schema[column].dataType)
    out = df.join(kept, key, "left").withColumn(column, F.when(F.col(column).isNotNull(), F.coalesce("_kept", empty)))
    return out.select(*df.columns)


def export_lines(rows: DataFrame, key: list[str], member: str, least: int = 4) -> DataFrame:
    """value: lines key,member,member,... (sorted, distinct) of the keys with at least least members; null members don't count."""
    per = rows.where(F.col(member).isNotNull()).groupBy(*key).agg(F.array_sort(F.collect_set(member)).alias("m")).where(F.size("m") >= least)
    return per.select(F.concat_ws(",", *key, F.array_join("m", ",")).alias("value"))
