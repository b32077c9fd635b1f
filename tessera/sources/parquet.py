"""Registration of Parquet files as read-only tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from tessera.plans.analyzer import Column
from tessera.sources.catalog import Table

WIDENED = {T.LongType: "INT", T.IntegerType: "INT", T.ShortType: "INT", T.ByteType: "INT", T.StringType: "TEXT", T.BooleanType: "BOOL", T.BinaryType: "BLOB"}


def registered(spark: SparkSession, name: str, path: str, not_null: Iterable[str] = ()) -> Table:
    """Integers become INT; types without literals pass through under their Spark names.

    ``not_null`` are columns known to hold no NULL; comparisons with them need no NULL terms.
    Registered tables carry no key: their columns may repeat.
    """
    sure = set(not_null)
    fields = spark.read.parquet(path).schema.fields
    columns = tuple(Column(f.name, WIDENED.get(type(f.dataType), f.dataType.simpleString()), f.name not in sure) for f in fields)
    body = ", ".join(f"{c.name} {c.type.upper()}" for c in columns)
    return Table(name, columns, f"CREATE TABLE {name} ({body});", external=path)
