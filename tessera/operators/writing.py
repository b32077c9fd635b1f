"""New data files of a table, with the ranges of its keys and indexed columns."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import DuplicateKey
from tessera.sources.catalog import DataFile, Store, Table, scan, stored_schema

#: Rows in a file of a rewrite at most.
FILE_ROWS = 5_000_000


def write_files(store: Store, table: Table, df: DataFrame, sort_by: list[int] = ()) -> tuple[DataFile, ...]:
    """Write rows in a new folder, by the clustering columns if there are any; one pass over the result for the key ranges."""
    folder = f"data/{table.name}-{uuid.uuid4().hex}"
    if sort_by:
        df = df.sortWithinPartitions(*[f"c{k}" for k in sort_by])
    df.write.option("maxRecordsPerFile", FILE_ROWS).parquet(store.full(folder))
    names = [n for n, size in store.names(folder) if n.endswith(".parquet") and size]
    if not names:
        return ()
    keys = table.ranged_columns
    read = store.spark.read.schema(stored_schema(table.columns)).parquet(store.full(folder))
    ranges = [x for k in keys for x in (F.min(f"c{k}").alias(f"a{k}"), F.max(f"c{k}").alias(f"b{k}"), F.count_if(F.col(f"c{k}").isNull()).alias(f"n{k}"))]
    found = read.groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name")).agg(F.count("*").alias("n"), *ranges).collect()  # a row for each file
    return tuple(
        DataFile(f"{folder}/{r['name']}", r["n"], {str(k): [r[f"a{k}"], r[f"b{k}"]] for k in keys if r[f"a{k}"] is not None}, {str(k): r[f"n{k}"] for k in keys})
        for r in sorted(found, key=lambda r: r["name"])
    )


def holds(file: DataFile, k: int, values: set) -> bool:
    """Whether a file's range of a key column has room for one of the values."""
    if str(k) not in file.keys:
        return False
    lo, hi = file.keys[str(k)]
    return any(lo <= v <= hi for v in values)


def overlapping(table: Table, files: tuple[DataFile, ...], k: int) -> tuple[DataFile, ...]:
    """The table's files whose range of a key column meets that of one of the new files."""
    mine = [f.keys[str(k)] for f in files if str(k) in f.keys]
    return tuple(f for f in table.files if str(k) in f.keys and any(f.keys[str(k)][0] <= hi and lo <= f.keys[str(k)][1] for lo, hi in mine))


def check_new_files(store: Store, table: Table, files: tuple[DataFile, ...]) -> None:
    """Raise if a key in new files repeats in them or in the table's. Files whose key ranges lie apart aren't compared."""
    for k in table.key_columns:
        check_unique(table, scan(store, replace(table, files=files)), [k])
        if not (old := overlapping(table, files, k)):
            continue
        c = F.col(f"c{k}")
        mine = [f.keys[str(k)] for f in files if str(k) in f.keys]
        between = c.between(min(lo for lo, _ in mine), max(hi for _, hi in mine))
        there = scan(store, replace(table, files=old)).filter(between).select(c)
        hit = scan(store, replace(table, files=files)).filter(c.isNotNull()).select(c).join(there, f"c{k}", "left_semi").first()
        if hit is not None:
            raise DuplicateKey(table.columns[k].name, hit[0])


def check_new_keys(store: Store, table: Table, rows: list[tuple], buffered: list[tuple] = ()) -> None:
    """Raise if a key of literal rows repeats among them, among buffered ones, or in the table; NULL is exempt.

    Only files whose key range has room for a value are read, with the values as a pushed-down filter.
    """
    for k in table.key_columns:
        seen: set = {r[k] for r in buffered if r[k] is not None}
        mine = [r[k] for r in rows if r[k] is not None]
        for v in mine:
            if v in seen:
                raise DuplicateKey(table.columns[k].name, v)
            seen.add(v)
        values = set(mine)
        files = tuple(f for f in table.files if holds(f, k, values))
        if not files:
            continue
        old = scan(store, replace(table, files=files)).select(f"c{k}")
        if len(values) <= 1000:
            hit = old.filter(F.col(f"c{k}").isin(list(values))).first()
        else:
            new = store.spark.createDataFrame([(v,) for v in values], stored_schema((table.columns[k],))).withColumnRenamed("c0", f"c{k}")
            hit = old.join(new, f"c{k}", "left_semi").first()
        if hit is not None:
            raise DuplicateKey(table.columns[k].name, hit[0])


def check_unique(table: Table, df: DataFrame, columns: list[int]) -> None:
    """Raise if a column of a whole table repeats a value."""
    for k in columns:
        c = f"c{k}"
        hit = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).filter("n > 1").first()
        if hit is not None:
            raise DuplicateKey(table.columns[k].name, hit[0])
