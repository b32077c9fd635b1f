"""CREATE TABLE, CREATE INDEX and DROP TABLE."""

from __future__ import annotations

from dataclasses import replace

from tessera.errors import IndexExists, TableExists
from tessera.operators.dml import writable
from tessera.operators.writing import check_unique, write_files
from tessera.plans.analyzer import table_columns
from tessera.plans.ast import CreateIndex, CreateTable
from tessera.sources.catalog import MASTER, Catalog, Index, Store, Table, scan


def create_table(catalog: Catalog, s: CreateTable) -> Table:
    if s.table == MASTER or s.table in catalog.tables:
        raise TableExists(s.table)
    columns = table_columns(s.columns)
    body = ", ".join(" ".join((d.name, d.type, *d.constraints)) for d in s.columns)
    return Table(s.table, tuple(columns), f"CREATE TABLE {s.table} ({body});")


def create_index(store: Store, catalog: Catalog, s: CreateIndex) -> Table:
    """An index clusters the table's files by its column, so that row groups are skipped by their ranges; results never change."""
    table = writable(catalog, s.table)
    k, _ = table.scope.find(s.column)
    if any(i.name == s.name for i in table.indexes):
        raise IndexExists(s.name)
    if s.unique:
        check_unique(table, scan(store, table), [k])
    made = Index(s.name, s.column, s.unique, f"CREATE{' UNIQUE' * s.unique} INDEX {s.name} ON {s.table} ({s.column});")
    new = replace(table, indexes=(*table.indexes, made))
    if table.files:
        rows = scan(store, table)
        if len(table.files) > 1:
            rows = rows.repartitionByRange(f"c{k}")
        new = replace(new, files=write_files(store, new, rows, [k]))
    return new
