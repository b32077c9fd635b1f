"""INSERT, UPDATE and DELETE as new snapshots of a table.

Snapshots are immutable: a statement writes new files and names them in a new catalog, so what it
reads doesn't change under it. UPDATE and DELETE rewrite only the files that hold affected rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import CatalogReadOnly, DuplicateName, NotNullViolation, ReservedName, UnsupportedError
from tessera.operators.writing import check_new_files, check_new_keys, overlapping, write_files
from tessera.plans.analyzer import ROW_ID, assignable, insert_rows, output_columns, predicate
from tessera.plans.ast import Delete, Expr, Insert, Update
from tessera.plans.compiler import compiled, projected, spark_type
from tessera.sources.catalog import MASTER, Catalog, DataFile, Store, Table, pruned, scan, stored_schema

#: Literal rows of a transaction that wait in memory, for one file instead of many.
BUFFER_ROWS = 10_000
#: Small files after which an insert folds them into one.
SMALL_FILES, SMALL_ROWS = 32, 100_000


@dataclass
class Effect:
    """What a statement did: the new table, rows affected, and rows returned if it asked for any."""

    table: Table
    count: int
    rows: DataFrame | None = None
    buffered: list[tuple] | None = None


def writable(catalog: Catalog, name: str) -> Table:
    if name == MASTER:
        raise CatalogReadOnly
    table = catalog.table(name)
    if table.external:
        raise UnsupportedError(f'table "{name}" is a registered file and read-only')
    return table


def local_rows(store: Store, table: Table, rows: list[tuple]) -> DataFrame:
    return store.spark.createDataFrame(rows, stored_schema(table.columns))


def insert(store: Store, catalog: Catalog, s: Insert, buffered: list[tuple]) -> Effect:
    """The rows are literals; they are checked here and written by ``flushed``."""
    table = writable(catalog, s.table)
    rows = insert_rows(table.columns, s.columns, s.rows)
    returned = output_columns(s.returning, table.scope, keep_parens=True) if s.returning else None
    check_new_keys(store, table, rows, buffered)
    out = projected(local_rows(store, table, rows), returned, table.scope) if returned else None
    return Effect(table, len(rows), out, rows)


def flushed(store: Store, table: Table, rows: list[tuple]) -> Table:
    """The table with buffered rows as one more file; many small files become one."""
    if not rows:
        return table
    files = (*table.files, *write_files(store, table, local_rows(store, table, rows).coalesce(1)))
    small = [f for f in files if f.rows < SMALL_ROWS]
    if len(small) > SMALL_FILES:
        merged = write_files(store, table, scan(store, replace(table, files=tuple(small))).coalesce(1), clustered(table))
        files = (*[f for f in files if f.rows >= SMALL_ROWS], *merged)
    return replace(table, files=files)


def affected_files(store: Store, table: Table, where: Expr | None) -> tuple[tuple[DataFile, ...], int]:
    """Files with rows that meet the condition, and how many rows those are. Only files whose ranges allow it are read; one aggregated row for each comes back."""
    table = pruned(table, where)
    if not table.files or where is None:
        return table.files, sum(f.rows for f in table.files)
    df = scan(store, table)
    # the name before the filter: it belongs to the scan
    df = df.withColumn("_file", F.input_file_name())
    df = df.filter(compiled(where, table.scope))
    hits = {"/".join(r["_file"].split("/")[-3:]): r["n"] for r in df.groupBy("_file").agg(F.count("*").alias("n")).collect()}
    return tuple(f for f in table.files if f.path in hits), sum(hits.values())


def clustered(table: Table) -> list[int]:
    """Columns to sort a rewrite by: the newest index's, by which its creation has laid the files out."""
    return [table.scope.find(i.column)[0] for i in table.indexes[-1:]]


def update(store: Store, catalog: Catalog, s: Update) -> Effect:
    table = writable(catalog, s.table)
    scope = table.scope
    names = [n for n, _ in s.assignments]
    if ROW_ID in names:
        raise ReservedName
    if len(set(names)) < len(names):
        raise DuplicateName("a column is assigned twice")
    new = {scope.find(n)[0]: assignable(scope.find(n)[1], e, scope) for n, e in s.assignments}
    where = predicate(s.where, scope)
    returned = output_columns(s.returning, scope, keep_parens=True) if s.returning else None
    files, count = affected_files(store, table, where)
    if not count:
        empty = store.spark.createDataFrame([], stored_schema(table.columns))
        return Effect(table, 0, projected(empty, returned, scope) if returned else None)
    hit = compiled(where, scope) if where is not None else F.lit(True)
    old = scan(store, replace(table, files=files))
    # one select, so that all assignments see the old row and the condition is the old row's
    value = lambda k: compiled(new[k], scope).cast(spark_type(table.columns[k].type))
    changed = [F.when(hit, value(k)).otherwise(F.col(f"c{k}")).alias(f"c{k}") if k in new else F.col(f"c{k}") for k in range(len(table.columns))]
    written = write_files(store, table, old.select(*changed), clustered(table))
    after = replace(table, files=(*[f for f in table.files if f not in files], *written))
    for k in new:
        if not table.columns[k].nullable and scan(store, replace(table, files=written)).filter(F.col(f"c{k}").isNull()).first() is not None:
            raise NotNullViolation(table.columns[k].name)
    if any(k in new for k in table.key_columns):
        check_new_files(store, replace(after, files=tuple(f for f in after.files if f not in written)), written)
    rows = None
    if returned:
        image = old.filter(hit).select(*[value(k).alias(f"c{k}") if k in new else F.col(f"c{k}") for k in range(len(table.columns))])
        rows = projected(image, returned, scope)
    return Effect(after, count, rows)


def delete(store: Store, catalog: Catalog, s: Delete) -> Effect:
    table = writable(catalog, s.table)
    scope = table.scope
    where = predicate(s.where, scope)
    returned = output_columns(s.returning, scope, keep_parens=True) if s.returning else None
    files, count = affected_files(store, table, where)
    old = scan(store, replace(table, files=files))
    rows = None
    if returned:
        rows = projected(old if where is None else old.filter(compiled(where, scope)), returned, scope)
    if not count:
        return Effect(table, 0, rows)
    kept = tuple(f for f in table.files if f not in files)
    if where is not None and count < sum(f.rows for f in files):
        kept += write_files(store, table, old.filter(~F.coalesce(compiled(where, scope), F.lit(False))), clustered(table))
    return Effect(replace(table, files=kept), count, rows)


def without_keys(store: Store, table: Table, files: tuple[DataFile, ...]) -> Table:
    """The table without rows whose first key column has a value that is in new files; only files with such rows are rewritten."""
    for k in table.key_columns[:1]:
        near = overlapping(table, files, k)
        if not near:
            break
        new = scan(store, replace(table, files=files)).select(f"c{k}")
        found = scan(store, replace(table, files=near)).withColumn("_file", F.input_file_name()).join(new, f"c{k}", "left_semi")
        hit = {"/".join(r[0].split("/")[-3:]) for r in found.select("_file").distinct().collect()}  # a row for each file
        near = tuple(f for f in near if f.path in hit)
        if near:
            rest = scan(store, replace(table, files=near)).join(new, f"c{k}", "left_anti").select(*[f"c{i}" for i in range(len(table.columns))])
            return replace(table, files=(*[f for f in table.files if f not in near], *write_files(store, table, rest, clustered(table))))
    return table


def append(store: Store, table: Table, df: DataFrame, replacing: bool = False) -> Effect:
    """Bulk insert of a DataFrame with the table's columns, by name; types must be those of the table once integers are widened.

    With ``replacing``, rows of the table whose first key column has a value among the new rows go; among themselves, those must differ.
    """
    from tessera.errors import ColumnNotFound, TypeMismatch
    from tessera.sources.parquet import WIDENED

    by_name = {f.name: f for f in df.schema.fields}
    for c in table.columns:
        if c.name not in by_name:
            raise ColumnNotFound(c.name)
        if WIDENED.get(type(by_name[c.name].dataType)) != c.type:
            raise TypeMismatch(f"column {c.name} takes {c.type}, not {by_name[c.name].dataType.simpleString()}")
    rows = df.select(*[F.col(f"`{c.name}`").cast(spark_type(c.type)).alias(f"c{k}") for k, c in enumerate(table.columns)])
    files = write_files(store, table, rows, clustered(table))
    new = scan(store, replace(table, files=files))
    gaps = [k for k, c in enumerate(table.columns) if not c.nullable]
    if gaps and files:
        missing = new.agg(*[F.count(F.when(F.col(f"c{k}").isNull(), 1)).alias(f"c{k}") for k in gaps]).first()
        for k in gaps:
            if missing[f"c{k}"]:
                raise NotNullViolation(table.columns[k].name)
    if replacing:
        table = without_keys(store, table, files)
    check_new_files(store, table, files)
    return Effect(replace(table, files=(*table.files, *files)), sum(f.rows for f in files))
