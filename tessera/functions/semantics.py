"""The engine's operators as Spark columns.

Comparisons are two-valued: NULL equals NULL and is less than anything else. For operands that
can't be NULL they are the plain ones; else forms are used that still reach the Parquet reader as filters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def less(a: Column, b: Column, a_null: bool, b_null: bool) -> Column:
    out = a < b
    if a_null:
        out = a.isNull() | out
    return (b.isNotNull() & out) if b_null else out


def less_or_equal(a: Column, b: Column, a_null: bool, b_null: bool) -> Column:
    out = a <= b
    if b_null:
        out = b.isNotNull() & out
    return (a.isNull() | out) if a_null else out


def compare(op: str, a: Column, b: Column, a_null: bool, b_null: bool) -> Column:
    if op in ("=", "!="):
        same = a.eqNullSafe(b) if a_null or b_null else a == b
        return same if op == "=" else ~same
    if op == "<":
        return less(a, b, a_null, b_null)
    if op == "<=":
        return less_or_equal(a, b, a_null, b_null)
    return compare({">": "<", ">=": "<="}[op], b, a, b_null, a_null)


def logic(op: str, a: Column, b: Column, a_null: bool, b_null: bool) -> Column:
    """AND and OR have no third value: a NULL operand is an error."""
    out = a & b if op == "AND" else a | b
    gaps = [x.isNull() for x, null in ((a, a_null), (b, b_null)) if null]
    if not gaps:
        return out
    gap = gaps[0] if len(gaps) == 1 else gaps[0] | gaps[1]
    return F.when(gap, F.raise_error(F.lit(f"{op} needs two BOOL values, not NULL")).cast("boolean")).otherwise(out)


def arithmetic(op: str, a: Column, b: Column) -> Column:
    """64-bit, truncating towards zero; NULL where an operand is. ANSI mode raises overflow and division by zero."""
    if op == "/":
        return F.call_function("div", a, b)
    return a + b if op == "+" else a - b if op == "-" else a * b if op == "*" else a % b
