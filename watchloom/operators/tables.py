"""Changes to tables as new tables: inserts, upserts, updates, deletes, latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in ``order``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def insert_new(target: DataFrame, rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """``target`` and those of ``rows`` whose keys it lacks, the first of each key."""
    return target.unionByName(latest(rows, keys, *order).join(target.select(*keys), keys, "left_anti"))


def _order(rows: DataFrame, keys: list[str], order: tuple[Column, ...]) -> list[Column]:
    """``order``, or all columns that aren't keys."""
    return list(order) or [F.col(c) for c in rows.columns if c not in keys] or [F.lit(0)]


def insert_with_parent(target: DataFrame, rows: DataFrame, key: str, parent: DataFrame, ref: str, parent_key: str, *order: Column) -> DataFrame:
    """``target`` and those of ``rows`` that have a parent and whose key is new, the first of each key."""
    has = latest(rows, [key], *_order(rows, [key], order)).join(parent.select(F.col(parent_key).alias(ref)), ref, "left_semi").select(*rows.columns)
    return target.unionByName(has.join(target.select(key), key, "left_anti").select(*rows.columns))


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], change: list[str], *order: Column) -> DataFrame:
    """``target`` with the columns ``change`` of rows that meet a key, and the rows that meet none; of
    several rows with a key the first in ``order``."""
    t, r = target.alias("t"), latest(rows, keys, *_order(rows, keys, order)).withColumn("_new", F.lit(True)).alias("r")
    both = t.join(r, [F.col(f"t.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys], "full_outer")
    met = F.col("r._new").isNotNull() & F.coalesce(*[F.col(f"t.{k}").isNotNull() for k in keys])
    columns = []
    for c in target.columns:
        if c in keys:
            columns.append(F.coalesce(f"t.{c}", f"r.{c}").alias(c))
        elif c in change:
            columns.append(F.when(F.col("r._new"), F.col(f"r.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
        else:
            columns.append(F.when(met | F.col("r._new").isNull(), F.col(f"t.{c}")).otherwise(F.col(f"r.{c}")).alias(c))
    return both.select(*columns)


def replace_keys(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` without the keys of ``rows``, and ``rows``."""
    return target.join(rows.select(*keys).distinct(), keys, "left_anti").select(*target.columns).unionByName(rows)


def update(target: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """``target`` with ``column`` taken from ``changes`` where it has the key and a value, the greatest of several."""
    c = changes.groupBy(F.col(key).alias("_k")).agg(F.max(column).alias("_v"))
    return target.join(c, target[key] == c["_k"], "left").withColumn(column, F.coalesce("_v", column)).drop("_k", "_v")


def activate(target: DataFrame, name_column: str, name: str, flag: str = "active") -> DataFrame:
    """``target`` with ``flag`` set on the named row alone; a name it lacks is an error."""
    if target.filter(F.col(name_column) == name).limit(1).count() == 0:
        raise KeyError(name)
    return target.withColumn(flag, F.col(name_column) == name)


def delete_where(target: DataFrame, gone: Column, locked: DataFrame, key: str) -> DataFrame:
    """``target`` less the rows for which ``gone`` holds and whose key isn't locked."""
    keep = locked.select(F.col(key).alias("_locked")).distinct()
    marked = target.join(keep, target[key] == keep["_locked"], "left")
    return marked.filter(~(F.coalesce(gone, F.lit(False)) & F.col("_locked").isNull())).drop("_locked")


def first_arrivals(rows: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """The first row of each key by ``arrival``: one aggregate, of which each task sends on its own first rows only."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), arrival).alias("_r")).select(*keys, "_r.*")


def typed(rows: DataFrame, schema: str) -> DataFrame:
    """``rows`` as a table of ``schema`` takes them: its columns in order, cast, those that are missing null. A column
    that the table doesn't have is an error, a value that doesn't fit its type null."""
    spark = rows.sparkSession
    fields = spark.createDataFrame([], schema).schema.fields
    odd = set(rows.columns) - {f.name for f in fields}
    if odd:
        raise ValueError(f"the table has no {', '.join(sorted(odd))}")
    kind = lambda f: f.dataType.simpleString()
    plain = ("array", "map", "struct")
    cell = lambda f: F.lit(None).cast(kind(f)) if f.name not in rows.columns else F.col(f.name).cast(kind(f)) if kind(f).startswith(plain) else F.col(f.name).try_cast(kind(f))
    return rows.select(*[cell(f).alias(f.name) for f in fields])


def append_typed(rows: DataFrame, schema: str, path: str) -> None:
    typed(rows, schema).write.mode("append").parquet(path)


def gathered(rows: DataFrame, by: list[str], key: str, most: int = 1024) -> DataFrame:
    """(by, keys): the keys of rows that are alike in ``by``, up to ``most`` in a row, so that a large group is many rows."""
    number = F.row_number().over(Window.partitionBy(*by).orderBy(key))
    return rows.select(*by, key, F.floor((number - 1) / most).alias("_part")).groupBy(*by, "_part").agg(F.collect_list(key).alias("keys")).drop("_part")
