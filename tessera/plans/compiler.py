"""Typed expressions to Spark columns. A table's columns are ``c0``, ``c1`` ... inside plans, so that
neither letter case nor repeated names matter; output names are put on last."""

from __future__ import annotations

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import AnalysisError
from tessera.functions import semantics
from tessera.plans.analyzer import ARITHMETIC, COMPARISONS, Scope, order_keys, output_columns, predicate, typed
from tessera.plans.ast import Binary, Expr, IsNull, Literal, Name, Nested, Select, Unary, display

SPARK_TYPES = {"INT": "bigint", "TEXT": "string", "BOOL": "boolean", "BLOB": "binary", "NULL": "string"}


def spark_type(kind: str) -> str:
    return SPARK_TYPES.get(kind, kind)


def literal(v: object, kind: str | None = None) -> SparkColumn:
    if isinstance(v, int) and not isinstance(v, bool):
        return F.lit(v).cast("bigint")
    return F.lit(v).cast(spark_type(kind or "NULL")) if v is None else F.lit(v)


def compiled(e: Expr, scope: Scope) -> SparkColumn:
    match e:
        case Literal(v):
            return literal(v)
        case Name(n):
            return F.col(f"c{scope.find(n)[0]}")
        case Nested(of):
            return compiled(of, scope)
        case Unary("NOT", of):
            return ~compiled(of, scope)
        case Unary("+", of):
            return compiled(of, scope)
        case Unary("-", Literal(v)):
            return literal(-v)
        case Unary("-", of):
            return -compiled(of, scope)
        case IsNull(of, negated):
            c = compiled(of, scope)
            return c.isNotNull() if negated else c.isNull()
        case Binary(a, op, b):
            x, y = compiled(a, scope), compiled(b, scope)
            if op in ARITHMETIC:
                return semantics.arithmetic(op, x, y)
            x_null, y_null = typed(a, scope)[1], typed(b, scope)[1]
            return (semantics.compare if op in COMPARISONS else semantics.logic)(op, x, y, x_null, y_null)
    raise AnalysisError(f"{display(e)} has no value here")


def projected(df: DataFrame, outputs: list[tuple[str, Expr]], scope: Scope) -> DataFrame:
    columns = [compiled(e, scope).alias(f"p{k}") for k, (_, e) in enumerate(outputs)]
    return df.select(*columns).toDF(*[n for n, _ in outputs])


def select(df: DataFrame, s: Select, scope: Scope) -> DataFrame:
    """Scan, filter, sort, limit, project. Sort keys are expressions over the table, so top-k stays one operator."""
    outputs = output_columns(s.items, scope)
    where = predicate(s.where, scope)
    keys = order_keys(s.order, outputs, scope)
    if where is not None:
        df = df.filter(compiled(where, scope))
    if keys:
        df = df.orderBy(*[compiled(e, scope).desc_nulls_last() if down else compiled(e, scope).asc_nulls_first() for e, down in keys])
    if s.limit is not None:
        df = df.limit(s.limit)
    return projected(df, outputs, scope)
