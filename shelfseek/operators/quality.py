"""Integrity reports and cascading deletes over the whole catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from shelfseek import schema
from shelfseek.operators.joins import are_small, lookup_join, split_join
from shelfseek.sources.tables import stored

Tables = dict[str, DataFrame]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _whole(tables: Tables, keys: bool = True) -> None:
    """Refuse a catalogue without a table, or a table without its key columns."""
    lost = sorted(set(schema.REQUIRED) - set(tables))
    if keys and not lost:
        wanted = [(t, c) for t, c, *_ in schema.REFERENCES] + [
            (t, c) for t, columns in schema.UNIQUE_KEYS for c in columns]
        lost = sorted({f"{t}.{c}" for t, c in wanted if c not in tables[t].columns})
    if lost:
        raise ValueError(f"the catalogue lacks {', '.join(lost)}")


def orphans(tables: Tables) -> DataFrame:
    """(table_name, column_name, missing_key, n_rows) for keys that refer to nothing.

    Keys are counted before they are looked up, so a key shared by many rows
    travels once.
    """
    _whole(tables)
    parts = []
    for table, column, parent, key, _ in schema.REFERENCES:
        used = (tables[table].filter(F.col(column).isNotNull())
                .groupBy(F.col(column).alias("missing_key")).agg(F.count("*").alias("n_rows")))
        known = tables[parent].select(F.col(key).alias("missing_key"))
        parts.append(used.join(known, "missing_key", "left_anti").select(
            F.lit(table).alias("table_name"), F.lit(column).alias("column_name"),
            "missing_key", "n_rows"))
    return _union(parts)


def duplicate_keys(tables: Tables) -> DataFrame:
    """(table_name, key_columns, key_value, n_rows) for unique keys held by several rows."""
    _whole(tables)
    parts = []
    for table, columns in schema.UNIQUE_KEYS:
        rows = tables[table].dropna(subset=columns).groupBy(*columns).agg(
            F.count("*").alias("n_rows")).filter("n_rows > 1")
        parts.append(rows.select(
            F.lit(table).alias("table_name"), F.lit(",".join(columns)).alias("key_columns"),
            F.concat_ws(",", *[F.col(c).cast("string") for c in columns]).alias("key_value"),
            "n_rows"))
    return _union(parts)


def null_violations(tables: Tables) -> DataFrame:
    """(table_name, column_name, n_rows) for required columns, one pass per table.

    A column that is not there is NULL in every row.
    """
    _whole(tables, keys=False)
    parts = []
    for table, columns in schema.REQUIRED.items():
        have = tables[table].columns
        counts = tables[table].agg(*[
            (F.count_if(F.col(c).isNull()) if c in have else F.count("*")).alias(c) for c in columns])
        parts.append(counts.select(F.inline(F.array(*[
            F.struct(F.lit(table).alias("table_name"), F.lit(c).alias("column_name"),
                     F.col(c).alias("n_rows")) for c in columns]))).filter("n_rows > 0"))
    return _union(parts)


PRIMARY_KEYS = {table: columns[0] for table, columns in reversed(schema.UNIQUE_KEYS)
                if len(columns) == 1}


def delete_cascade(tables: Tables, table: str, keys: DataFrame) -> Tables:
    """All tables after deleting rows of ``table`` by key (column ``key``).

    Children follow their reference: deleted with it, or set to NULL. Deletes
    that other rows restrict are left to the orphan report.
    """
    out = dict(tables)
    keys = keys.select("key").distinct()
    _delete(out, table, keys, are_small(keys)[0])
    return out


def _met(rows: DataFrame, keys: DataFrame, column: str, how: str, spread: list[str], small: bool) -> DataFrame:
    if small:
        return lookup_join(rows, keys, [column], how, spread, True)
    return split_join(rows, keys, [column], how, spread)


def _delete(out: Tables, table: str, keys: DataFrame, small: bool) -> None:
    """``small`` tells whether the keys were measured to be few; others meet rows by
    shuffle, heavy parents in parts."""
    before = dict(out)
    out[table] = _drop(out[table], PRIMARY_KEYS[table], keys, small, own=True)
    for child, column, parent, _, action in schema.REFERENCES:
        if parent != table or child not in before or column not in before[child].columns:
            continue
        own = PRIMARY_KEYS[child]
        if action == "cascade" and any(r[2] == child and r[0] in before for r in schema.REFERENCES):
            named = keys.withColumnRenamed("key", column)
            gone = _met(before[child], named, column, "left_semi", [own], small)
            # Written once: several tables refer to them, and each level builds on the last.
            gone = stored(gone.select(F.col(own).alias("key")), "deleted")
            _delete(out, child, gone, are_small(gone)[0])
        elif action == "cascade":
            out[child] = _drop(out[child], column, keys, small)
        elif action == "set null":
            mark = keys.select(F.col("key").alias(column), F.lit(True).alias("_gone"))
            rows = _met(out[child], mark, column, "left", [own], small)
            out[child] = rows.withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))
                                         ).select(*before[child].columns)


def _drop(rows: DataFrame, column: str, keys: DataFrame, small: bool, own: bool = False) -> DataFrame:
    """Rows without the ``keys``. A table's ``own`` keys differ from row to row, so none is looked for as heavy."""
    named = keys.withColumnRenamed("key", column)
    if own and not small:
        return rows.join(named, column, "left_anti").select(*rows.columns)
    return _met(rows, named, column, "left_anti", rows.columns[:4], small).select(*rows.columns)
